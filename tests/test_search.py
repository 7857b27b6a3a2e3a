"""Search with bounds, and junction trees, against enumeration."""

import itertools
import math
import random

import numpy as np
import pytest

from lattica import schema
from lattica.operators import exact, factors, search


def all_joint(clusters, weights):
    """Every joint association of every choice of hypotheses, best first."""
    out = []
    for hs in itertools.product(*clusters):
        tracks = sorted(t for h in hs for t in h[2])
        for picks in itertools.product(*(sorted(weights.get(t, {}).items()) for t in tracks)):
            taken = [j for j, _ in picks if j]
            if len(set(taken)) == len(taken):
                out.append(sum(h[3] for h in hs) + sum(w for _, w in picks))
    return sorted(out, reverse=True)


def random_problem(rng, clusters, tracks, meas, hypos, density=0.5, missed=0.9):
    hs, t0 = [], 0
    for c in range(clusters):
        own = range(t0 + 1, t0 + tracks + 1)
        t0 += tracks
        hs.append([(c, k, sorted(rng.sample(own, rng.randrange(0, tracks + 1))), math.log(rng.random() + 1e-3)) for k in range(hypos)])
    weights = {t: ({0: -rng.random()} if rng.random() < missed else {}) | {j: rng.gauss(0, 2) for j in range(1, meas + 1) if rng.random() < density} for t in range(1, t0 + 1)}
    return hs, weights


@pytest.mark.parametrize("seed", range(12))
def test_best_joint_equals_enumeration(seed):
    rng = random.Random(seed)
    hs, weights = random_problem(rng, rng.randrange(1, 4), rng.randrange(1, 4), rng.randrange(0, 5), rng.randrange(1, 5))
    want = all_joint(hs, weights)
    for k in (1, 7, 10_000):
        got, solved, parents = search.best_joint(hs, weights, k)
        assert [x for *_, x in got] == pytest.approx(want[:k])
        assert parents <= math.prod(map(len, hs)) and (not got or solved >= 1)
        for labels, picks, ll in got:
            own = [next(h for h in cluster if h[1] == x) for cluster, (_, x) in zip(hs, labels, strict=True)]
            assert sorted(t for t, _ in picks) == sorted(t for h in own for t in h[2])
            assert ll == pytest.approx(sum(h[3] for h in own) + sum(weights[t][j] for t, j in picks))
            taken = [j for _, j in picks if j]
            assert len(set(taken)) == len(taken)


@pytest.mark.parametrize("seed", range(6))
def test_listed_joint_equals_the_search(seed):
    clusters, weights = random_problem(random.Random(seed), 1 + seed % 3, 3, 4, 3)
    want, got = search.best_joint(clusters, weights, 40)[0], search.listed_joint(clusters, weights, 40, 10**6)
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want]) and len(got) == len(want)
    assert {(tuple(a), tuple(b)) for a, b, _ in got} == {(tuple(a), tuple(b)) for a, b, _ in want}
    assert search.listed_joint(clusters, weights, 40, 1) is None


def test_large_problem_opens_few_parents():
    """20 tracks and measurements, 100 parents: the 150 best without opening all parents, or solving more than a few problems for each."""
    rng = random.Random(3)
    hs, weights = random_problem(rng, 2, 10, 20, 10, 0.4, 1.0)
    got, solved, parents = search.best_joint(hs, weights, 150)
    values = [x for *_, x in got]
    assert len(values) == 150 and values == sorted(values, reverse=True)
    assert parents < 100 and solved < 150 * 10
    # the best of each parent that wasn't opened lies below the last
    for a, b in itertools.product(*hs):
        matrix, _ = search._matrix(sorted(a[2] + b[2]), weights)
        found = search.first_matching(matrix) if matrix.shape[1] else (0.0,)
        if found is not None and found[0] + a[3] + b[3] > values[-1] + 1e-9:
            assert any(labels == [(0, a[1]), (1, b[1])] for labels, *_ in got)


def test_tables_with_births_and_odd_rows(spark):
    r = [(1, 1, 0, -1.0), (1, 1, 1, 2.0), (1, 2, 1, 1.0), (1, 2, 2, 0.5), (2, 5, 1, 1.0), (2, 6, 1, 3.0), (3, 9, 0, -2.0)]
    h = [(1, 0, 0, [1, 2], 0.5), (1, 0, 1, [2], 0.5), (2, 0, 0, [5, 6], 1.0), (3, 0, 0, [], 0.4), (3, 0, 1, [9], 0.6)]
    reward, hypos = spark.createDataFrame(r, schema.REWARD), spark.createDataFrame(h, schema.HYPOTHESIS)
    births = spark.createDataFrame([(1, 1, 0.25), (1, 2, -0.5)], "frame long, meas int, ll double")
    got = search.best_associations(reward, hypos, 10, births=births).collect()
    one = {tuple((p.track, p.meas) for p in x.picks): x.ll for x in got if x.frame == 1}
    assert one[(1, 1), (2, 2)] == pytest.approx(math.log(0.5) + 2.5)
    assert one[(1, 0), (2, 1)] == pytest.approx(math.log(0.5) - 1.0 + 1.0 - 0.5)
    assert one[((2, 2),)] == pytest.approx(math.log(0.5) + 0.5 + 0.25)
    assert [x for x in got if x.frame == 2] == []  # both tracks need the one measurement
    assert {(len(x.picks), x.labels[0].hypo) for x in got if x.frame == 3} == {(0, 0), (1, 1)}
    plain = search.best_associations(reward, hypos, 10)
    z, p = search.truncated(plain)
    want = {(x.frame, x.master): x.log_z for x in exact.evidence_by_master(exact.joint(reward, hypos)).collect()}
    assert {(x.frame, x.master): x.log_z for x in z.collect()} == pytest.approx(want)
    assert {(x.frame, x.track): x.p for x in p.filter("meas = 0").collect()}[3, 9] == pytest.approx(0.6 * math.exp(-2) / (0.6 * math.exp(-2) + 0.4))
    assert search.best_associations(reward.limit(0), hypos.limit(0), 5).count() == 0


def test_junction_tree_equals_elimination_of_each_variable():
    for seed in range(15):
        rng = random.Random(seed)
        hs, weights = random_problem(rng, 3, 2, 4, 3, 0.5, 0.8)
        rows = [(t, j, ll) for t, w in weights.items() for j, ll in w.items()]
        hypos = [(c, k, ts, math.exp(lp)) for cluster in hs for c, k, ts, lp in cluster]
        domains, table = factors.graph(rows, hypos)
        beliefs, log_z = factors.JunctionTree(domains, table).calibrated()
        _, want_z = factors.eliminated(domains, table)
        assert log_z == pytest.approx(want_z)
        for v in domains:
            p, _ = factors.eliminated(domains, table, v)
            assert np.allclose(beliefs[v], p)
        # weights that vanish without shifting
        low, shifted_hypos, offset = factors.shifted([(t, j, ll - 900) for t, j, ll in rows if t <= 6], hypos)
        got, low_z = factors.JunctionTree(*factors.graph(low, shifted_hypos)).calibrated()
        assert math.isfinite(low_z + offset) == math.isfinite(want_z)
        assert all(np.isfinite(p).all() for p in got.values())


def test_work_of_the_tree_is_linear():
    """A chain of clusters, each sharing a measurement with the next."""

    def work(n):
        rows = [(t, j, 0.1) for t in range(1, n + 1) for j in (0, t, t + 1)]
        tree = factors.JunctionTree(*factors.graph(rows, [(t, 0, [t], 0.6) for t in range(1, n + 1)] + [(t, 1, [], 0.4) for t in range(1, n + 1)]))
        beliefs, log_z = tree.calibrated()
        assert math.isfinite(log_z) and all(b.sum() == pytest.approx(1) for b in beliefs.values())
        return tree.work

    assert work(80) < 2.2 * work(40) < 5 * work(20)


def test_infeasible_tree():
    domains, table = factors.graph([(1, 1, 0.0), (2, 1, 0.0)], [(0, 0, [1, 2], 1.0)])
    beliefs, log_z = factors.JunctionTree(domains, table).calibrated()
    assert log_z == -math.inf and all(not b.any() for b in beliefs.values())


def test_marginals_of_vanishing_weights(spark):
    """Tracks with weights of -500: z doesn't fit, log_z and shares do, by every way."""
    from lattica.operators import conditioning
    from lattica.operators import hypotheses as hy

    r = spark.createDataFrame([(1, 1, 0, -500.0), (1, 1, 1, -499.0), (1, 2, 0, -500.0), (1, 2, 1, -499.5)], schema.REWARD)
    h = spark.createDataFrame([(1, 0, 0, [1], 1.0), (1, 1, 0, [2], 1.0)], schema.HYPOTHESIS)
    cm = hy.merge_map(r, h)
    want = -1000 + math.log(1 + math.e + math.exp(0.5))
    j = exact.joint(r, h, cm)
    e = exact.evidence(j).first()
    assert e.z == 0 and e.log_z == pytest.approx(want)
    p = {(x.track, x.meas): x.p for x in exact.marginals(j, exact.members(h, cm)).collect()}
    assert p[1, 1] == pytest.approx(math.e / (1 + math.e + math.exp(0.5)))
    for solver in (conditioning.enumerated, conditioning.propagated):
        c = conditioning.Conditioned(r, h, cm, solver=solver)
        assert c.evidence().first().log_z == pytest.approx(want)
        assert {(x.track, x.meas): x.p for x in c.marginals().collect()} == pytest.approx(p, abs=1e-9)
    assert factors.by_elimination(r, h).first().log_z == pytest.approx(want)
    assert search.best_associations(r, h, 9, cm).count() == 3


def test_lineage_selection_and_numbers(spark):
    from lattica.operators import hypotheses as hy
    from lattica.operators import metrics, stats

    r = [(1, 1, 0, 0.0), (1, 1, 1, 1.0), (1, 2, 0, 0.0), (1, 2, 1, 1.0), (1, 3, 0, 0.0), (1, 3, 1, 0.5), (1, 3, 2, 0.5), (1, 4, 0, 0.0)]
    h = [(1, 0, 0, [2, 1], 0.3), (1, 0, 1, [], 0.1), (1, 0, 2, [1], 0.6), (1, 1, 0, [3], 1.0), (1, 2, 0, [4], 1.0), (2, 0, 0, [7], 1.0)]
    reward, hypos = spark.createDataFrame(r, schema.REWARD), spark.createDataFrame(h, schema.HYPOTHESIS)
    cm = hy.merge_map(reward, hypos)
    m = hy.merged(hypos, cm)
    rows = {(x.frame, x.master, x.merged_hypo): set() for x in hy.lineage(m).collect()}
    for x in hy.lineage(m).collect():
        rows[x.frame, x.master, x.merged_hypo].add((x.cluster, x.hypo))
    assert rows == {(1, 0, 0): {(0, 0), (1, 0)}, (1, 0, 1): {(0, 1), (1, 0)}, (1, 0, 2): {(0, 2), (1, 0)}, (1, 2, 0): {(2, 0)}, (2, 0, 0): {(0, 0)}}
    some = spark.createDataFrame([(1, 0, 2), (1, 1, 0), (1, 1, 0)], "frame long, cluster int, hypo int")
    assert sorted(x.hypo for x in hy.descending_from(m, some.limit(1)).collect()) == [2]
    assert sorted(x.hypo for x in hy.descending_from(m, some).collect()) == [0, 1, 2]
    picked = {(x.cluster, x.hypo): (x.prob, x.share) for x in hy.selected(hypos, spark.createDataFrame([(1, 0, 0), (1, 0, 1)], "frame long, cluster int, hypo int")).collect()}
    assert picked[0, 0] == pytest.approx((0.3, 0.75)) and picked[0, 1] == pytest.approx((0.1, 0.25))
    assert {(x.cluster, x.hypo): x.tracks for x in hy.numbered(hypos.filter("frame = 1")).collect()} == {(0, 0): [1, 2], (0, 1): [], (0, 2): [2], (1, 0): [1], (2, 0): [1]}
    assert [tuple(x) for x in stats.superclusters(reward, hypos, cm).collect()] == [(1, 0, 2, 4, 3, 1, 1, 1)]
    competing = {(x.master, x.hypo, x.meas): x.n_tracks for x in stats.competing_by_hypothesis(reward, m).collect()}
    assert competing == {(0, 0, 1): 3, (0, 0, 2): 1, (0, 1, 1): 1, (0, 1, 2): 1, (0, 2, 1): 2, (0, 2, 2): 1}
    p = spark.createDataFrame([(1, 1, "missed", 0, 0.5), (1, 1, "nonexistence", None, 0.5)], schema.MARGINAL)
    got = {(x.method, x.kind): (x["mean"], x.n) for x in metrics.by_method(p, {"same": p, "none": p.limit(0)}).collect()}
    assert got == {("same", "missed"): (0.0, 1), ("same", "nonexistence"): (0.0, 1), ("none", "missed"): (0.5, 1), ("none", "nonexistence"): (0.5, 1)}


def test_conditioning_lists_no_ownerships(spark):
    """Two clusters that share 14 measurements: 3 ** 14 ownerships, which used to raise, and 15 associations each."""
    from lattica.operators import conditioning
    from lattica.operators import hypotheses as hy

    r = spark.createDataFrame([(1, t, j, 0.1 * j * t if j else -1.0) for t in (1, 2) for j in range(15)], schema.REWARD)
    h = spark.createDataFrame([(1, 0, 0, [1], 1.0), (1, 1, 0, [2], 0.7), (1, 1, 1, [], 0.3)], schema.HYPOTHESIS)
    cm = hy.merge_map(r, h)
    c, j = conditioning.Conditioned(r, h, cm), exact.joint(r, h, cm)
    assert c.evidence().first().log_z == pytest.approx(exact.evidence(j).first().log_z)
    want = {(x.track, x.kind, x.meas): x.p for x in exact.marginals(j, exact.members(h, cm)).collect()}
    assert {(x.track, x.kind, x.meas): x.p for x in c.marginals().collect()} == pytest.approx(want, abs=1e-9)


def test_written_tables_are_not_broadcast_for_their_size_on_disk(spark, sf_dir):
    from lattica.plans import larger

    plan = larger.selected_hypotheses(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_tree_of_many_competing_tracks():
    """Eight tracks that all compete for eight measurements: the table of owners is too large, chains hold sets of measurements alone."""
    from lattica.operators import conditioning

    rng = random.Random(5)
    rows = [(t, j, rng.gauss(0, 1)) for t in range(1, 9) for j in range(9) if (t, j) != (5, 3)]
    hypos = [(0, 0, [1, 2, 3, 4], 0.7), (0, 1, [1, 2], 0.3), (1, 0, [5, 6, 7, 8], 0.5), (1, 1, [7], 0.5)]
    with pytest.raises(ValueError):
        factors.JunctionTree(*factors.graph(rows, hypos))
    domains, beliefs, log_z = factors.tree_beliefs(rows, hypos)
    weights = {t: [(j, ll) for s, j, ll in rows if s == t] for t in range(1, 9)}
    own = {0: [(0, 0.7, [1, 2, 3, 4]), (1, 0.3, [1, 2])], 1: [(0, 0.5, [5, 6, 7, 8]), (1, 0.5, [7])]}
    want = {(kind, a, b): p for kind, a, b, p in conditioning._sums(own, weights, conditioning.enumerated, True)}
    assert log_z == pytest.approx(want["all", None, None])
    for (kind, a, b), p in want.items():
        if kind != "all":
            v = ("track" if kind == "pick" else "hypothesis", a)
            assert beliefs[v][domains[v].index(b)] == pytest.approx(p)
    assert all(b.sum() == pytest.approx(1) for b in beliefs.values())
