"""Tracker stages in several dimensions, against brute force and on odd rows."""

import itertools
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica import schema
from lattica.operators import cardinality, cutting, gating, mixtures, resampling
from lattica.operators import hypotheses as hy


def spreads(rng, n, dims):
    out = []
    for k in range(n):
        a = rng.normal(size=(dims, dims)) * 10.0 ** rng.integers(-2, 2)
        out.append((k % 3, k, (rng.normal(size=dims) * 5).tolist(), (a @ a.T + 1e-6 * np.eye(dims)).ravel().tolist()))
    return out


@pytest.mark.parametrize("dims", [1, 2, 4])
def test_gates_on_grids_equal_all_pairs(spark, dims):
    rng = np.random.default_rng(dims)
    t, m = spreads(rng, 90, dims), [(k % 3, k, (rng.normal(size=dims) * 5).tolist()) for k in range(300)]
    bad = [(0, 900, [0.0] * dims, [0.0] * dims * dims), (0, 901, None, [1.0] * dims * dims), (0, 902, [math.nan] * dims, np.eye(dims).ravel().tolist()), (0, 903, [0.0] * dims, None)]
    tracks = spark.createDataFrame(t + bad, "frame long, track int, x array<double>, s array<double>").withColumn("level", F.lit("clash"))
    meas = spark.createDataFrame([*m, (0, 990, None), (1, 991, [None] * dims)], "frame long, meas int, z array<double>")
    want = {}
    for f, k, x, s in t:
        s = np.array(s).reshape(dims, dims)
        for g, j, z in m:
            d = np.array(z) - x
            if f == g and (q := float(d @ np.linalg.solve(s, d))) < 4.0:
                want[f, k, j] = (q, -0.5 * q - 0.5 * np.linalg.slogdet(s)[1] - dims / 2 * math.log(2 * math.pi))
    for on_grid in (True, False):
        got = {(r.frame, r.track, r.meas): (r.distance, r.ll) for r in gating.gated(tracks, meas, 4.0, dims, on_grid).collect()}
        assert got.keys() == want.keys()
        assert all(np.allclose(got[k], want[k], rtol=1e-6, atol=1e-6) for k in want)
    assert len(want) > 20
    good = tracks.filter("track < 900").drop("level")
    compared = gating.candidates(good, meas.filter("meas < 990"), 4.0, dims).count()
    assert compared < (0.8 if dims == 1 else 0.6) * sum(f == g for f, *_ in t for g, *_ in m)


def test_pairs_compared_grow_with_the_rows(spark):
    """Twice the area and rows at one density: about twice the pairs."""
    counts = []
    for n in (400, 800):
        side = math.sqrt(n)
        t = spark.range(n).selectExpr("0L as frame", "cast(id as int) as track", f"array(rand(1) * {side}, rand(2) * {side}) as x", "array(0.25D, 0D, 0D, 0.25D) as s")
        m = spark.range(n).selectExpr("0L as frame", "cast(id as int) as meas", f"array(rand(3) * {side}, rand(4) * {side}) as z")
        counts.append(gating.candidates(t, m, 1.0, 2).count())
    assert counts[1] < 2.5 * counts[0] < 2.5 * 400 * 12


def test_betweenness_by_all_paths():
    rng = random.Random(4)
    for _ in range(20):
        n = rng.randrange(2, 8)
        pairs = [(a, b) for a in range(n) for b in range(a) if rng.random() < 0.45]
        near = {v: [b if a == v else a for a, b in pairs if v in (a, b)] for v in range(n)}
        want = dict.fromkeys(near, 0.0)
        for s, t in itertools.combinations(range(n), 2):
            ways, todo = [], [[s]]
            while todo and not ways:
                ways = [w for w in todo if w[-1] == t]
                todo = [[*w, x] for w in todo for x in near[w[-1]] if x not in w]
            for w in ways:
                for v in w[1:-1]:
                    want[v] += 1 / len(ways)
        assert cutting.betweenness(near) == pytest.approx(want)


def chain(n):
    """Clusters 0..n-1, each sharing measurement k with the next; the link between 3 and 4 is worst."""
    return [e for k in range(n - 1) for e in ((k, k + 1, 2.0, False), (k + 1, k + 1, 1.5 - (5.0 if k == 3 else 0), False))]


def test_superclusters_get_small():
    rows = chain(8)
    cuts = cutting.small_cuts(rows, dict.fromkeys(range(8), 1), dict.fromkeys(range(8), 1), more_cardinality=99)
    assert cuts == {(4, 4)}  # 0-3 and 4-7 are left
    for clusters in (1, 2, 3):
        cuts = cutting.small_cuts(rows, dict.fromkeys(range(8), 1), dict.fromkeys(range(8), 1), clusters, 99)
        left = cutting._components([r for r in rows if (r[0], r[1]) not in cuts])
        assert max(list(left.values()).count(m) for m in left.values()) <= clusters
        # each measurement still has a cluster
        assert {j for _, j, *_ in rows} == {j for c, j, *_ in rows if (c, j) not in cuts}
    assert cutting.small_cuts(rows, dict.fromkeys(range(8), 4), {}, 99) != set()  # cardinalities sum to over 4 + 5
    assert cutting.small_cuts(rows, {}, dict.fromkeys(range(8), 60), 99) != set()  # hypotheses to over 60 + 100
    assert cutting.small_cuts(rows, {}, dict.fromkeys(range(8), 10), 99) == set()


def test_weak_edges_and_tables(spark):
    no = -9.0
    r = [(1, 1, 0, -0.5), (1, 1, 1, 3.0), (1, 2, 0, -0.5), (1, 2, 1, no), (1, 2, 2, no), (1, 3, 0, -0.5), (1, 3, 2, no + 1), (1, 4, 3, 1.0), (1, 5, 0, 0.0), (1, 5, 4, no)]
    h = [(1, k, 0, [k], 1.0) for k in range(1, 6)]
    reward, hypos = spark.createDataFrame(r, schema.REWARD), spark.createDataFrame(h, schema.HYPOTHESIS)
    cuts = sorted(map(tuple, cutting.cut_edges(reward, hypos).collect()))
    # measurement 1 loses track 2; measurement 2 would lose both and keeps track 3; measurement 4 lies between no clusters
    assert cuts == [(1, 2, 1, "weak"), (1, 2, 2, "weak")]
    left = cutting.without(reward, hypos, cutting.cut_edges(reward, hypos))
    assert left.count() == len(r) - 2
    assert {(x.cluster, x.master) for x in hy.merge_map(left, hypos).collect()} == {(k, k) for k in range(1, 6)}
    assert cutting.cut_edges(reward.limit(0), hypos.limit(0)).count() == 0


def test_bids_under_one_cap(spark):
    h = [(1, 0, 0, [1], 0.9), (1, 0, 1, [], 0.06), (1, 0, 2, [2], 0.04), (1, 1, 0, [3], 0.5), (1, 1, 1, [4], 0.3), (1, 1, 2, [5], 0.15), (1, 1, 3, [], 0.05)]
    hypos = spark.createDataFrame(h, schema.HYPOTHESIS)
    kept = lambda **a: sorted((x.cluster, x.hypo) for x in hy.bid_pruned(hypos, **a).collect())
    # doubtful: cluster 0 hypos 1, 2; cluster 1 hypos 2, 3; bids in turn: (1, 2), (0, 1), then (1, 3), (0, 2)
    assert kept(cap=3, tail=0.25, least=0.2) == [(0, 0), (1, 0), (1, 1)]
    assert kept(cap=4, tail=0.25, least=0.2) == [(0, 0), (1, 0), (1, 1), (1, 2)]
    assert kept(cap=5, tail=0.25, least=0.2) == [(0, 0), (0, 1), (1, 0), (1, 1), (1, 2)]
    assert kept(cap=6, tail=0.25, least=0.2) == [(0, 0), (0, 1), (1, 0), (1, 1), (1, 2), (1, 3)]
    assert len(kept(cap=99)) == 7 and kept(cap=1, tail=0.0) == [(0, 0), (1, 0)]
    exi = spark.createDataFrame([(1, 3, 1e-9), (1, 4, 0.5), (1, 1, 0.9)], "frame long, track int, exi double")
    assert (1, 0) not in kept(cap=3, tail=0.0, least=0.0, tracks=exi)
    assert hy.bid_pruned(hypos.limit(0)).count() == 0


def test_tracks_in_several_clusters_stay_in_one(spark):
    t = [(1, k, hist, [float(k)], [1.0], 0.1 * k) for k, hist in ((1, [1, 0]), (2, [1, 0]), (3, [2, 2]), (4, None), (5, [7, 7]))]
    tracks = spark.createDataFrame(t, "frame long, track int, history array<int>, x array<double>, p array<double>, exi double")
    h = [(1, 0, 0, [1, 3], 0.5), (1, 0, 1, [2, 3], 0.3), (1, 0, 2, [], 0.2), (1, 1, 0, [2, 4], 0.6), (1, 1, 1, [4], 0.4)]
    one, left = hy.histories_merged(tracks, spark.createDataFrame(h, schema.HYPOTHESIS), 1)
    assert sorted((x.cluster, x.hypo, x.tracks, round(x.prob, 9)) for x in left.collect()) == [(0, 0, [1, 2], 0.8), (0, 2, [], 0.2), (1, 1, [3], 1.0)]
    got = {x.track: x for x in one.collect()}
    assert sorted(got) == [1, 2, 3]  # track 5 has no hypothesis
    # old tracks 1 and 2 weigh 0.5 and 0.3 + 0.6
    a, b = 0.5 / 1.4, 0.9 / 1.4
    mean = a + 2 * b
    assert got[1].x[0] == pytest.approx(mean) and got[1].p[0] == pytest.approx(1 + a + 4 * b - mean**2) and got[1].exi == pytest.approx(0.1 * a + 0.2 * b)
    assert got[1].n_merged == 2


def test_cardinalities_by_subsets(spark):
    rng = random.Random(2)
    exi = {t: rng.random() for t in range(1, 9)}
    h = [(1, 0, 0, [1, 2, 3], 2.0), (1, 0, 1, [2], 1.0), (1, 0, 2, [], 1.0), (1, 1, 0, [4, 5], 1.0), (2, 0, 0, [], 1.0), (2, 1, 0, [6, 99], 1.0)]
    hypos = spark.createDataFrame(h, schema.HYPOTHESIS)
    tracks = spark.createDataFrame([(1 if t < 6 else 2, t, e) for t, e in exi.items()], "frame long, track int, exi double")
    law = lambda ts: np.array([sum(math.prod(exi[t] if t in s else 1 - exi[t] for t in ts) for s in itertools.combinations(ts, n)) for n in range(len(ts) + 1)])
    mix = np.zeros(4)
    for ts, p in (([1, 2, 3], 0.5), ([2], 0.25), ([], 0.25)):
        mix[: len(ts) + 1] += p * law(ts)
    want = np.convolve(mix, law([4, 5]))
    clusters = cardinality.by_cluster(hypos, tracks)
    got = cardinality.by_frame(clusters).orderBy("frame", "n").collect()
    assert [x.p for x in got if x.frame == 1] == pytest.approx(want)
    assert [x.p for x in got if x.frame == 2] == pytest.approx(law([6]))
    rate = spark.createDataFrame([(1, 0.7)], "frame long, rate double")
    poisson = np.array([math.exp(-0.7) * 0.7**k / math.factorial(k) for k in range(13)])
    more = [x.p for x in cardinality.by_frame(clusters, rate, 12).orderBy("frame", "n").collect() if x.frame == 1]
    assert more == pytest.approx(np.convolve(want, poisson))
    m = cardinality.moments(cardinality.by_frame(clusters), "frame").filter("frame = 1").first()
    assert m.mean == pytest.approx(sum(k * p for k, p in enumerate(want))) and m.likeliest == int(np.argmax(want))


def test_systematic_counts_are_fair(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice([0, 0, 1, 7, 50, 10**6 if k == 40 else 3])) for k in range(300)] + [(7, 12), (7, 12)]
    df = spark.createDataFrame(rows, "id long, w long").repartition(5)
    whole = sum(w for _, w in rows)
    for n, start in ((1, 0.0), (10, 0.3), (1000, 0.999), (5000, 0.5)):
        got = resampling.systematic(df, "id", "w", n, start).collect()
        assert sum(r["count"] for r in got) == n and len(got) == len(rows)
        assert all(abs(r["count"] - n * r.w / whole) < 1 for r in got)
    big = spark.createDataFrame([(k, 2**60 + k) for k in range(9)], "id long, w long")
    assert sorted(r["count"] for r in resampling.systematic(big, "id", "w", 9, 0.5).collect()) == [1] * 9
    assert {r["count"] for r in resampling.systematic(df.withColumn("w", F.lit(0).cast("long")), "id", "w", 5).collect()} == {0}
    assert resampling.systematic(df.limit(0), "id", "w", 5).count() == 0
    assert [r.u for r in spark.createDataFrame([(0.5,), (-1.0,), (math.nan,), (None,)], "w double").select(resampling.units(F.col("w"), 4).alias("u")).collect()] == [2, 0, 0, 0]


def test_roulette_follows_the_seed_and_weights(spark):
    rows = [(k, w, f"name{k}") for k, w in enumerate([0, 5, 0, 3, 200, 1, 0])]
    df = spark.createDataFrame(rows, "id long, w long, name string")
    one = sorted(map(tuple, resampling.roulette(df, "id", "w", 4000, 3).collect()))
    assert [d for d, *_ in one] == list(range(4000))
    assert one == sorted(map(tuple, resampling.roulette(df.repartition(3), "id", "w", 4000, 3).collect()))
    assert one != sorted(map(tuple, resampling.roulette(df, "id", "w", 4000, 4).collect()))
    share = {k: sum(i == k for _, i, *_ in one) / 4000 for k, *_ in rows}
    assert all(abs(share[k] - w / 209) < 0.02 for k, w, _ in rows) and share[0] == share[2] == share[6] == 0
    assert resampling.roulette(df.filter("w = 0"), "id", "w", 5, 1).count() == 0


def test_reduction_equals_the_plain_greedy(spark):
    rng = np.random.default_rng(3)
    n, d = 14, 2
    w, mean = rng.random(n) + 0.01, rng.normal(size=(n, d)) * 3
    cov = np.array([(a := rng.normal(size=(d, d))) @ a.T + 0.3 * np.eye(d) for _ in range(n)])

    def plain(most):
        parts = [([k], w[k], mean[k], cov[k]) for k in range(n)]
        cost = lambda p: np.linalg.slogdet(p[3])[1] * p[1] / 2

        def joined(p, q):
            t = p[1] + q[1]
            m = (p[1] * p[2] + q[1] * q[2]) / t
            return sorted(p[0] + q[0]), t, m, sum(x[1] / t * (x[3] + np.outer(x[2] - m, x[2] - m)) for x in (p, q))

        while len(parts) > most:
            p, q = min(itertools.combinations(parts, 2), key=lambda x: cost(joined(*x)) - cost(x[0]) - cost(x[1]))
            parts = [x for x in parts if x is not p and x is not q] + [joined(p, q)]
        return sorted((p[0], p[1], p[2].tolist()) for p in parts)

    for most in (1, 3, 8):
        got = sorted((own, x, m.tolist()) for x, m, _, own in mixtures.reduced(w, mean, cov, most))
        assert [x[0] for x in got] == [x[0] for x in plain(most)]
        assert np.allclose([x[1] for x in got], [x[1] for x in plain(most)])
    rows = [(k % 2, k, float(w[k]) if k else 1e-9, mean[k].tolist(), cov[k].ravel().tolist()) for k in range(n)]
    table = spark.createDataFrame(rows, "frame long, component int, weight double, x array<double>, p array<double>")
    out = mixtures.reduced_components(table, 2).collect()
    assert sorted(k for r in out for k in r.members) == list(range(1, n)) and sum(r.weight for r in out) == pytest.approx(w[1:].sum())
    assert mixtures.reduced_components(table.limit(0), 2).count() == 0
    assert len(mixtures.reduced(w, mean, cov, 1, dearest=-1.0)) == n and len(mixtures.reduced(w, mean, cov, n, always=1e9)) == 1


@pytest.mark.parametrize("name", ["gated_vectors", "node_betweenness", "weak_edges", "bid_hypotheses", "hypotheses_by_history", "tracks_by_history", "target_counts", "systematic_counts", "roulette_draws", "reduced_mixtures"])
def test_queries_equal_their_sql(spark, sf_dir, name):
    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in ("events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = con.sql(entry.oracle_sql()[name])
    out = entry.queries()[name](spark, sf_dir)
    names = sorted(out.columns)
    assert names == sorted(rel.columns)
    want = sorted(repr([r[rel.columns.index(c)] for c in names]) for r in rel.fetchall())
    assert sorted(repr([r[c] for c in names]) for r in out.collect()) == want
    assert want


def test_mixtures_of_one_size_are_reduced_together(spark):
    """Three hundred mixtures of five components, as by one, and thirty more with equal components, whose costs tie; a large one goes alone."""
    rng = np.random.default_rng(5)
    rows = [(f, c, float(rng.random() + 0.1) if f < 300 else 0.5, [float(v) for v in (rng.normal(size=2) * 3 if f < 300 else (c % 2, 0))], [2.0, 0.5, 0.5, 1.0]) for f in range(330) for c in range(5)]
    rows += [(400, c, 0.1, [float(c), 0.0], [1.0, 0.0, 0.0, 1.0]) for c in range(70)]
    table = spark.createDataFrame(rows, "frame long, component int, weight double, x array<double>, p array<double>")
    out = mixtures.reduced_components(table, 2)
    assert "MapInPandas" in out._jdf.queryExecution().executedPlan().toString()  # not a call for each frame
    got = {(r.frame, tuple(r.members)): r for r in out.collect()}
    want = {}
    for f in [*range(330), 400]:
        own = [r for r in rows if r[0] == f]
        for w, m, c, members in mixtures.reduced(np.array([r[2] for r in own]), np.array([r[3] for r in own]), np.array([r[4] for r in own]).reshape(-1, 2, 2), 2):
            want[f, tuple(members)] = (min(members), w, *m, *c.ravel())
    assert {k: (r.component, r.weight, *r.x, *r.p) for k, r in got.items()} == {k: pytest.approx(v) for k, v in want.items()}
