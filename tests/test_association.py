import itertools
import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica import schema
from lattica.operators import assignment, conditioning, exact, lbp, metrics, mixtures, stats
from lattica.operators import hypotheses as hy

NO = float("-inf")
#: Five tracks (missed, measurement 1, measurement 2), two clusters that share measurement 2, and their exact results.
F1 = [[-0.60, 3.0, NO], [-0.56, 3.2, NO], [-0.46, -3.0, 1.2], [-0.62, NO, 3.0], [-0.55, NO, -0.4]]
F1_HYPOS = [(0, 0, [1, 2], 0.5), (0, 1, [1, 3], 0.5), (1, 0, [4], 0.5), (1, 1, [5], 0.5)]
F1_Z = 228.5276770589719
F1_P = [[0.34079521, 0.65920479, 0, 0], [0.28200107, 0.32212954, 0, 0.39586939], [0.31165938, 0.00065374, 0.08355627, 0.60413061], [0.06285782, 0, 0.84163842, 0.09550376], [0.06741553, 0, 0.02808823, 0.90449624]]
F1_THETA = {(0, 0): 0.604131, (0, 1): 0.395869, (1, 0): 0.904496, (1, 1): 0.0955038}
F1_BETHE_Z = 222.9445842156695


def tables(spark, matrix, hypos, frame=1):
    reward = [(frame, t + 1, j, x) for t, row in enumerate(matrix) for j, x in enumerate(row) if x > NO]
    return spark.createDataFrame(reward, schema.REWARD), spark.createDataFrame([(frame, *h) for h in hypos], schema.HYPOTHESIS)


@pytest.fixture(scope="module")
def f1(spark):
    return tables(spark, F1, F1_HYPOS)


def table_of(rows, n, m):
    out = np.zeros((n, m + 2))
    for r in rows:
        out[r.track - 1, m + 1 if r.meas is None else r.meas] = r.p
    return out


def test_exact_results_of_the_fixture(f1):
    r, h = f1
    cm = hy.merge_map(r, h)
    assert sorted(map(tuple, cm.collect())) == [(1, 0, 0, True), (1, 1, 0, False)]
    j = exact.joint(r, h, cm)
    e = exact.evidence(j).first()
    assert e.z == pytest.approx(F1_Z, abs=1e-9) and e.n_joint == 28
    got = table_of(exact.marginals(j, exact.members(h, cm)).collect(), 5, 2)
    assert np.abs(got - np.array(F1_P)).max() < 1e-8
    assert {(x.cluster, x.hypo): x.p for x in exact.theta_posteriors(j).collect()} == pytest.approx(F1_THETA, abs=1e-6)


def test_lineage_and_links(f1):
    r, h = f1
    cm = hy.merge_map(r, h)
    m = hy.merged(h, cm).orderBy("hypo").collect()
    assert [[tuple(x) for x in row.labels] for row in m] == [[(0, 0), (1, 0)], [(0, 0), (1, 1)], [(0, 1), (1, 0)], [(0, 1), (1, 1)]]
    assert [row.tracks for row in m] == [[1, 2, 4], [1, 2, 5], [1, 3, 4], [1, 3, 5]]
    assert [(x.meas, x.clusters) for x in hy.linking_measurements(r, h, cm).collect()] == [(2, [0, 1])]
    assert hy.unmerging_clusters(cm).count() == 0


def test_conditioning_forced_equals_exact_and_unforced_counts_more(f1):
    r, h = f1
    cm = hy.merge_map(r, h)
    assert conditioning.conditioned_evidence(r, h, cm).first().z == pytest.approx(F1_Z, abs=1e-9)
    assert conditioning.conditioned_evidence(r, h, cm, forced=False).first().z == pytest.approx(249.8799730814644, abs=1e-8)


def test_loopy_bethe_of_the_fixture(f1):
    rows = lbp.lbp(*f1, frames=1).collect()
    assert rows[0].iterations == 5 and rows[0].bethe_iterations == 4 and rows[0].message_iterations == 5
    assert math.exp(rows[0].log_z) == pytest.approx(F1_BETHE_Z, rel=1e-9)
    got = table_of([r for r in rows if r.kind in ("missed", "detection", "nonexistence")], 5, 2)
    assert np.abs(got.sum(1) - 1).max() < 1e-9


def test_loopy_is_exact_on_a_tree(spark):
    """One cluster with one hypothesis and one measurement has no loop."""
    r, h = tables(spark, [[-0.6, 3.0], [-0.5, NO]], [(0, 0, [1, 2], 1.0)])
    row = lbp.lbp(r, h, 1).first()
    assert row.log_z == pytest.approx(exact.evidence(exact.joint(r, h)).first().log_z, abs=1e-9)


F4_GATES = {1: [1], 2: [1], 3: [1, 2], 4: [2], 5: [3], 6: [3, 4], 7: [4], 8: [3, 4, 5], 9: [5], 10: [], 11: [1], 12: [6]}
F4_HYPOS = [(0, 0, [1], 0.5), (0, 1, [2], 0.5), (1, 0, [3], 0.5), (1, 1, [4], 0.5), (2, 0, [5], 0.3), (2, 1, [6], 0.3), (2, 2, [7], 0.4), (3, 0, [8], 0.3), (3, 1, [9], 0.3), (3, 2, [10], 0.4), (4, 0, [11], 0.9), (4, 1, [], 0.1), (5, 0, [12], 0.9), (5, 1, [], 0.1)]


def by_force(matrix, hypos):
    """Evidence over all joint hypotheses and associations."""
    clusters = [[h for h in hypos if h[0] == c] for c in sorted({h[0] for h in hypos})]
    total = 0.0
    for hs in itertools.product(*clusters):
        tracks, prior = [t for h in hs for t in h[2]], math.prod(h[3] for h in hs)
        for picks in itertools.product(*[[j for j, x in enumerate(matrix[t - 1]) if x > NO] for t in tracks]):
            used = [j for j in picks if j]
            if len(used) == len(set(used)):
                total += prior * math.exp(sum(matrix[t - 1][j] for t, j in zip(tracks, picks, strict=True)))
    return total


def test_links_of_six_clusters_with_empty_hypotheses(spark):
    matrix = [[0.1, *[1.0 if j in g else NO for j in range(1, 7)]] for g in F4_GATES.values()]
    r, h = tables(spark, matrix, F4_HYPOS)
    cm = hy.merge_map(r, h)
    assert {x.cluster: x.master for x in cm.collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 0, 5: 5}
    assert {x.meas: x.clusters for x in hy.linking_measurements(r, h, cm).collect()} == {1: [0, 1, 4], 3: [2, 3], 4: [2, 3]}
    assert [x.cluster for x in hy.unmerging_clusters(cm).collect()] == [5]
    want = by_force(matrix, F4_HYPOS)
    assert exact.evidence(exact.joint(r, h, cm)).first().z == pytest.approx(want, rel=1e-9)
    parts = {x.master: x.z for x in conditioning.conditioned_evidence(r, h, cm).collect()}
    alone = {x.master: x.z for x in exact.evidence_by_master(exact.joint(r, h, cm)).collect()}
    assert parts == pytest.approx({k: alone[k] for k in (0, 2)}, rel=1e-9)


def test_algebra(spark, f1):
    _, h = f1
    assert {(x.track, x.n_hypos): x.p for x in hy.track_probability(h).collect()} == {(1, 2): 1.0, (2, 1): 0.5, (3, 1): 0.5, (4, 1): 0.5, (5, 1): 0.5}
    assert sorted(x.tracks for x in hy.reindexed(h).filter("cluster = 1").collect()) == [[1], [2]]
    one = spark.createDataFrame([(1, 1)], "frame long, track int")
    assert hy.containing(h, one).count() == 2
    assert hy.shared_tracks(h).count() == hy.duplicate_hypotheses(h).count() == hy.mixed_cardinalities(h).count() == 0
    few = spark.createDataFrame([(1, 0, k, [k], p) for k, p in enumerate([0.9, 0.0995, 0.0004, 0.0001])], schema.HYPOTHESIS)
    assert hy.pruned(few).count() == 2 and hy.pruned(few, limit=1).first().prob == 1.0
    assert [x.children for x in hy.proportional_children(few, 100).orderBy("hypo").collect()] == [90, 10, 1, 1]
    t = spark.createDataFrame([(1, 1, [1, 0], 0.5, 0.0, 1.0, 0.8), (1, 2, [1, 0], 0.5, 2.0, 1.0, 0.4), (1, 3, [2], 1.0, 5.0, 1.0, 1.0)], "frame long, track int, history array<int>, weight double, x double, p double, exi double")
    m = {x.track: (x.x, x.p, x.exi, x.n_merged) for x in hy.merged_by_history(t).collect()}
    assert m == {1: (1.0, 2.0, pytest.approx(0.6), 2), 3: (5.0, 1.0, 1.0, 1)}


def test_metrics_and_stats(f1):
    r, h = f1
    cm = hy.merge_map(r, h)
    j = exact.joint(r, h, cm)
    approx = lbp.lbp(r, h, 1).filter("kind in ('missed', 'detection', 'nonexistence')")
    err = metrics.errors(exact.marginals(j, exact.members(h, cm)), approx)
    assert {x.kind for x in metrics.by_kind(err).collect()} == {None, "missed", "detection", "nonexistence"}
    assert metrics.largest_per_track(err).count() == 5
    assert metrics.survival(err).agg(F.max("share")).first()[0] == 1.0
    assert metrics.histogram(err).agg(F.sum("n")).first()[0] == metrics.heatmap(err).agg(F.sum("n")).first()[0] == err.count()
    s = stats.scenario(r, h, cm).first()
    assert (s.n_prior, s.n_posterior, s.n_hypos_prior, s.n_hypos_posterior, s.n_linking, s.n_gated) == (2, 1, 4, 4, 1, 2)
    kept = [x.x for x in metrics.thinned(err.sparkSession.range(100).select((F.col("id") / 100).alias("x")), "x", 0.1).orderBy("x").collect()]
    assert all(b - a > 0.1 for a, b in itertools.pairwise(kept)) and len(kept) == 10


def matrices(seed, forbid=0.2):
    rng = np.random.default_rng(seed)
    for _ in range(25):
        n, m = rng.integers(1, 6), rng.integers(1, 5)
        a = rng.normal(size=(n + m, m))
        a[:n][rng.random((n, m)) < forbid] = -np.inf
        yield a


def all_matchings(reward):
    items, customers = reward.shape
    out = [sum(reward[i, c] for c, i in enumerate(p)) for p in itertools.permutations(range(items), customers)]
    return sorted((x for x in out if np.isfinite(x)), reverse=True)


def test_parts_of_a_matching_share_its_matrix():
    a = np.random.default_rng(0).exponential(size=(240, 120))
    found = assignment.first_matching(a)
    tracemalloc.start()
    parts = assignment.parts_without(found, 120)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(parts) == 120 and held < 2 * a.nbytes
    got = [x for _, x in assignment.murty(a, 30)]
    assert got == sorted(got, reverse=True) and got[0] == pytest.approx(found[0])
    best = [assignment.solved_part(a, p) for p in parts]
    assert got[1] == pytest.approx(max(x[0] for x in best)) and all(x[0] <= p[0] + 1e-9 for x, p in zip(best, parts, strict=True))
    for x in best[::17]:  # potentials stay those of an optimum
        d = x[2]
        spare = d.cost - d.u[:, None] - d.v
        assert abs(spare[np.arange(120), x[1]]).max() < 1e-9


def test_assignment_solvers_equal_brute_force():
    for a in matrices(1):
        want = all_matchings(a)
        assert assignment.best(a)[1] == pytest.approx(want[0])
        assert [x for _, x in assignment.murty(a, 12)] == pytest.approx(want[:12])
        got = assignment.auction(a, 1e-4)
        assert len(set(got.tolist())) == a.shape[1] and a[got, np.arange(a.shape[1])].sum() >= want[0] - 1e-3 * a.shape[1]
    for a in matrices(2, 0):
        cost, n = a.T, a.shape[1]
        best = min(max(cost[r, c] for r, c in enumerate(p)) for p in itertools.permutations(range(cost.shape[1]), n))
        assert assignment.bottleneck(cost)[1] == pytest.approx(best)
        for k in range(1, n + 1):
            least = min(sum(cost[r, c] for r, c in zip(rows, cols, strict=True)) for rows in itertools.combinations(range(n), k) for cols in itertools.permutations(range(cost.shape[1]), k))
            assert assignment.k_cardinality(cost, k)[1] == pytest.approx(least)


def test_other_assignments():
    cost = np.array([[1.0, 5], [2, 1], [4, 4]])
    assert assignment.semi_assignment(cost, [2, 1]).tolist() == [0, 1, 0]
    assert assignment.semi_assignment(cost, [1, 1]) is None
    assert assignment.hungarian(np.array([[np.inf, np.inf]])) is None
    assert assignment.transportation(cost[:2], [2, 1], [1, 2]).sum() == 3
    rows, cols = np.array([[3.0, 1], [3, 2]]), np.array([[1.0, 2], [1, 2]])
    assert assignment.stable_matching(rows, cols).tolist() == [1, 0]
    value, local, missed, false = assignment.gospa(np.array([[1.0, 50], [60, 70]]))
    assert (local, missed, false) == (1.0, 1, 1) and value == pytest.approx(math.sqrt(1 + 100))
    assert assignment.gospa(np.zeros((0, 2)))[2:] == (0, 2)


def test_single_hypothesis_messages():
    w, w0 = np.exp(np.array([[3.0, -3.0], [3.2, 1.2]])), np.exp(np.array([-0.6, -0.56]))
    p, k = assignment_free(w, w0)
    assert np.abs(p.sum(1) - 1).max() < 1e-9 and k < 300


def assignment_free(w, w0):
    return lbp.single_hypothesis(w, w0, tol=1e-9)


def test_mixture_reduction_keeps_mass_and_mean():
    rng = np.random.default_rng(3)
    w, mean = rng.random(12), rng.normal(size=(12, 2))
    cov = np.stack([np.eye(2) * (1 + k / 10) for k in range(12)])
    a, b, c = mixtures.reduce_mixture(w, mean, cov, 4)
    assert len(a) == 4 and a.sum() == pytest.approx(w.sum()) and np.allclose(a @ b, w @ mean)
    second = lambda w, m, p: sum(x * (q + np.outer(y, y)) for x, y, q in zip(w, m, p, strict=True))
    assert np.allclose(second(a, b, c), second(w, mean, cov))


def test_rows_alike_are_passed_together(monkeypatch):
    """Sixty copies of three tracks compete for fifty copies of three measurements; each may be missed, too."""
    rng = np.random.default_rng(12)
    n, b = 180, 150
    reward = np.full((b + n, n), -np.inf)
    reward[:b] = np.repeat(np.repeat(rng.normal(size=(3, 3)) + 3, 50, 0), 60, 1)
    reward[b + np.arange(n), np.arange(n)] = np.repeat(rng.normal(size=3), 60)
    steps = []
    scan = assignment._scan
    monkeypatch.setattr(assignment, "_scan", lambda *x: steps.append(1) or scan(*x))
    match, u, v = assignment.matching(-reward.T, assignment.alike(-reward.T))
    assert len(steps) < 5 * n  # each by itself: 7,321
    # potentials prove that it is the best
    cost = -reward.T
    assert len(set(match.tolist())) == n and (cost - u[:, None] - v).min() > -1e-9
    assert cost[np.arange(n), match] == pytest.approx(u + v[match])
    assert (v <= 1e-12).all() and not np.delete(v, match).any()


def test_best_matchings_of_copies_equal_those_listed():
    rng = np.random.default_rng(13)
    for _ in range(6):
        n, b = 8, 3
        reward = np.full((b + n, n), -np.inf)
        reward[:b] = rng.normal(size=(2, 3))[rng.integers(0, 2, b)][:, rng.integers(0, 3, n)]
        reward[b + np.arange(n), np.arange(n)] = rng.normal(size=n)
        assert assignment.alike(-reward.T) is not None
        ways = [(0.0, frozenset())]
        for t in range(n):
            ways = [(x + reward[j, t], used | {j}) for x, used in ways for j in (*range(b), b + t) if j not in used]
        want = sorted((x for x, _ in ways), reverse=True)[:30]
        assert [x for _, x in assignment.murty(reward, 30)] == pytest.approx(want)
