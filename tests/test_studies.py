import itertools
import math

import numpy as np
import pytest
from test_association import F1, F1_HYPOS, F1_P, F1_THETA, F1_Z, NO, table_of, tables

from lattica.operators import analytics, assignment, conditioning, exact, factors, lbp, single, tracking
from lattica.operators import hypotheses as hy
from lattica.sources import snapshots


def test_k_best_equal_all_sorted():
    rng = np.random.default_rng(1)
    for _ in range(150):
        n = int(rng.integers(1, 5))
        r = rng.normal(size=(int(rng.integers(n, n + 4)), n))
        r[rng.random(r.shape) < 0.3] = NO
        want = sorted((float(sum(r[p[c], c] for c in range(n))) for p in itertools.permutations(range(len(r)), n)), reverse=True)
        got = assignment.murty(r, 12)
        assert np.allclose([x for _, x in got], [x for x in want if x > NO][:12])
        assert len({tuple(x) for x, _ in got}) == len(got)


def test_nothing_to_transport():
    assert assignment.transportation(np.array([[np.inf]]), [1], [1]) is None


def test_evidence_of_a_frame_with_an_impossible_master(spark):
    """Two tracks that can only have measurement 1, and a free track elsewhere."""
    r, h = tables(spark, [[NO, 1.0], [NO, 1.0], [0.5, NO]], [(0, 0, [1, 2], 1.0), (1, 0, [3], 1.0)])
    cm = hy.merge_map(r, h)
    j = exact.joint(r, h, cm)
    e = exact.evidence(j, cm).first()
    assert e.z == 0 and e.log_z == NO and factors.by_elimination(r, h).first().log_z == NO
    p = {(x.track, x.kind): x.p for x in exact.marginals(j, exact.members(h, cm)).collect()}
    assert p == {(1, "nonexistence"): 0.0, (2, "nonexistence"): 0.0, (3, "missed"): 1.0, (3, "nonexistence"): 0.0}
    c = conditioning.Conditioned(r, h, cm)
    assert {x.master: x.z for x in c.evidence().collect()} == pytest.approx({0: 0.0, 1: math.exp(0.5)})
    assert {x.track: x.p for x in c.marginals().filter("kind = 'nonexistence'").collect()} == {1: 0.0, 2: 0.0, 3: 0.0}


def test_conditioned_results_equal_the_fixture(spark):
    r, h = tables(spark, F1, F1_HYPOS)
    c = conditioning.Conditioned(r, h, hy.merge_map(r, h))
    assert c.evidence().first().z == pytest.approx(F1_Z, abs=1e-9)
    assert np.abs(table_of(c.marginals().collect(), 5, 2) - np.array(F1_P)).max() < 1e-8
    assert {(x.cluster, x.hypo): x.p for x in c.theta().collect()} == pytest.approx(F1_THETA, abs=1e-6)


@pytest.mark.parametrize("forced", [True, False])
def test_loopy_solver_is_exact_without_loops(spark, forced):
    """Each hypothesis' tracks share one measurement at most; track 3 can't be missed, and measurement 2 links the clusters."""
    r, h = tables(spark, [[-0.6, 1.0, NO, NO], [-0.3, 0.2, 0.7, NO], [NO, NO, 0.4, 0.9]], [(0, 0, [1, 2], 0.7), (0, 1, [1], 0.3), (1, 0, [3], 0.6), (1, 1, [], 0.4)])
    cm = hy.merge_map(r, h)
    a, b = (conditioning.Conditioned(r, h, cm, forced, s) for s in (conditioning.enumerated, conditioning.propagated))
    assert b.evidence().first().z == pytest.approx(a.evidence().first().z)
    said = lambda rows: {(x.track, x.kind, x.meas): x.p for x in rows.collect()}
    assert said(b.marginals()) == pytest.approx(said(a.marginals()), abs=1e-9)
    post = lambda rows: {(x.cluster, x.hypo): x.p for x in rows.collect()}
    assert post(b.theta()) == pytest.approx(post(a.theta()), abs=1e-9)


def test_loopy_solver_leaves_out_what_cannot_be(spark):
    """Two tracks with one measurement, neither of which can be missed."""
    r, h = tables(spark, [[NO, 1.0], [NO, 1.0]], [(0, 0, [1, 2], 1.0)])
    c = conditioning.Conditioned(r, h, hy.merge_map(r, h), solver=conditioning.propagated)
    assert [x.z for x in c.evidence().collect()] == [0.0] and {x.p for x in c.theta().collect()} == {0.0}


def test_loopy_solver_is_near_the_fixture(spark):
    r, h = tables(spark, F1, F1_HYPOS)
    c = conditioning.Conditioned(r, h, hy.merge_map(r, h), solver=conditioning.propagated)
    assert c.evidence().first().z == pytest.approx(F1_Z, rel=0.1)
    assert np.abs(table_of(c.marginals().collect(), 5, 2) - np.array(F1_P)).max() < 0.05


def test_single_hypothesis_forms():
    rng = np.random.default_rng(3)
    w, w0 = rng.uniform(0.1, 2, (3, 1)), rng.uniform(0.2, 1, 3)
    want = w0.prod() + sum(w[i, 0] * np.delete(w0, i).prod() for i in range(3))  # one measurement: no loop
    mu, nu, _ = single.messages(w / w0[:, None], 1e-12, 300)
    assert single.bethe(w / w0[:, None], w0, mu, nu) == pytest.approx(math.log(want))
    p, log_z = single.clean(w, w0, 1e-14)
    assert log_z == pytest.approx(math.log(want))
    assert np.allclose(p, single.single_hypothesis(w, w0, 1e-12)[0])
    assert single.new_track_probability(mu)[0] == pytest.approx(w0.prod() / want)
    forced, _ = single.clean(np.array([[1.0], [1.0]]), np.array([0.0, 0.5]))
    assert np.allclose(forced, [[0, 1], [1, 0]], atol=1e-6)
    trace: list = []
    single.single_hypothesis(w, w0, 0.0, 4, trace=trace)
    assert [k for k, _, _ in trace] == [1, 2, 3, 4]


def test_numbers_of_tracks_need_no_room(spark):
    matrix, far = [[-0.6, 3.0], [-0.5, 2.0]], {1: 1, 2: 5_000_000}
    r, h = tables(spark, matrix, [(0, 0, [1, 2], 1.0)])
    wide = spark.createDataFrame([(x.frame, far[x.track], x.meas * 7_000_000, x.ll) for x in r.collect()], r.schema)
    hw = spark.createDataFrame([(1, 0, 0, [1, 5_000_000], 1.0)], h.schema)
    a, b = lbp.lbp(r, h, 1).collect(), lbp.lbp(wide, hw, 1).collect()
    said = lambda rows, t, j: sorted((x.kind, t.get(x.track), None if x.meas is None else x.meas // j, round(x.p, 12)) for x in rows if x.kind != "theta")
    assert said(a, {1: 1, 2: 2}, 1) == said(b, {1: 1, 5_000_000: 2}, 7_000_000)


def test_gospa_of_each_step(spark):
    a = spark.createDataFrame([(1, 0.0), (1, 100.0), (2, 5.0)], "frame long, x double")
    b = spark.createDataFrame([(1, 3.0), (3, 1.0)], "frame long, x double")
    got = {x.frame: (x.squared, x.localisation, x.missed, x.false) for x in assignment.gospa_per_step(a, b).collect()}
    assert got == {1: (pytest.approx(9 + 50), pytest.approx(9), 1, 0), 2: (pytest.approx(50), 0.0, 1, 0), 3: (pytest.approx(50), 0.0, 0, 1)}


def test_auction_and_truncated_results(spark, tmp_path):
    r, _ = tables(spark, [[-0.6, 3.0, NO], [-0.5, 3.2, 1.0]], [(0, 0, [1, 2], 1.0)])
    assert {x.track: x.meas for x in assignment.auctioned(r).collect()} == {1: 1, 2: 2}
    t = assignment.truncated_marginals(r, 10)
    assert t.first().log_z == pytest.approx(math.log(math.exp(-1.1) + math.exp(2.5) + math.exp(2.6) + math.exp(4) + math.exp(0.4)))
    t.write.parquet(str(tmp_path / "t"))
    assert snapshots.read_murty(spark, str(tmp_path / "t")).count() == t.count()
    t.filter("track = 1 AND meas = 0").write.parquet(str(tmp_path / "broken"))
    with pytest.raises(Exception, match="isn't whole"):
        snapshots.read_murty(spark, str(tmp_path / "broken")).collect()


def test_columns_of_doubles_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(k, k / 7) for k in range(100)], "k long, v double").repartition(5)
    snapshots.write_column(df, "v", str(tmp_path / "c"), "k")
    got = snapshots.read_column(spark, str(tmp_path / "c")).orderBy("place").collect()
    assert [x.x for x in got] == [k / 7 for k in range(100)] and [x.place for x in got] == list(range(100))
    (tmp_path / "raw").mkdir()
    np.arange(3.0).astype("<f8").tofile(tmp_path / "raw" / "a.bin")
    assert sorted(map(tuple, snapshots.read_column(spark, str(tmp_path / "raw"), raw=True).collect())) == [(0, 0.0), (1, 1.0), (2, 2.0)]


def test_weights_beyond_the_best(spark):
    keys = "frame long, track int, meas int, p double"
    loopy, best = spark.createDataFrame([(1, 1, 0, 0.4), (1, 1, 1, 0.6)], keys), spark.createDataFrame([(1, 1, 1, 1.0)], keys)
    z = spark.createDataFrame([(1, 10.0, 6.0)], "frame long, whole double, best double")
    assert {x.meas: x.weight for x in analytics.recycling_weights(loopy, best, z).collect()} == pytest.approx({0: 1.0, 1: -1.0})


def test_recycled_tracks(spark):
    tracks = spark.createDataFrame([(1, 1, 0.9, 0.0, 1.0), (1, 2, 0.05, 1.0, 1.0), (1, 3, 1e-7, 2.0, 1.0)], "frame long, track int, exi double, x double, p double")
    stay, weak = tracking.recycled(tracks)
    assert [x.track for x in stay.collect()] == [1] and [(x.component, x.weight) for x in weak.collect()] == [(2, 0.05)]


def test_columns_in_blocks_and_binary_files(spark, tmp_path):
    """Several blocks a part, files that numpy reads, repeated values, nulls, no rows."""
    rows = [(k, None if k % 50 == 3 else (k * 37 % 101) / 4) for k in range(200)]
    df = spark.createDataFrame(rows, "k long, v double").repartition(5)
    want = [(k, v) for k, v in rows]
    snapshots.write_column(df, "v", str(tmp_path / "t"), "k", block=7)
    same = lambda got: [(r.place, None if r.x != r.x else r.x) for r in got] == want
    assert same(snapshots.read_column(spark, str(tmp_path / "t")).orderBy("place").collect())
    assert spark.read.parquet(str(tmp_path / "t")).selectExpr("max(length(data))").first()[0] <= 56
    assert snapshots.write_binary(df, "v", str(tmp_path / "bin"), "k") == 200
    files = sorted((tmp_path / "bin").iterdir())
    assert [f.suffix for f in files] == [".bin"] * len(files)
    whole = np.concatenate([np.fromfile(f, "<f8") for f in files])
    assert [None if x != x else x for x in whole.tolist()] == [v for _, v in rows]
    assert same(snapshots.read_column(spark, str(tmp_path / "bin"), raw=True).orderBy("place").collect())
    assert snapshots.write_binary(df.limit(0), "v", str(tmp_path / "none"), "k") == 0
