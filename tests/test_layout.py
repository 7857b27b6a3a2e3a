import math
import struct
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica import schema
from lattica.operators import factors, histories, layout
from lattica.plans import catalog
from lattica.sources import matfile, snapshots

NEW = ["gating_tracks", "track_components", "square_layout", "measurement_form", "track_form", "existing_marginals", "open_associations", "eliminated_marginals", "split_clusters", "silences"]


@pytest.mark.parametrize("name", NEW)
def test_queries_equal_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet'")
    df, want = catalog.QUERIES[name](spark, sf_dir), con.sql(catalog.ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    assert sorted(map(key, df.select(*want.columns).collect())) == sorted(map(key, want.fetchall()))


def test_measurement_form_of_dense_links(spark):
    """Four tracks and four measurements, which link two clusters."""
    gates = {1: (1, 4), 2: (1, 2, 3), 3: (1, 2, 3), 4: (2, 4)}
    rows = [(1, t, 0, 0.1) for t in gates] + [(1, t, m, 1.0) for t, ms in gates.items() for m in ms]
    r = spark.createDataFrame(rows, schema.REWARD)
    got = {(x.meas, x.track): round(x.ll, 9) for x in layout.measurement_form(r).collect()}
    want = {(m, 0): 0.0 for m in (1, 2, 3, 4)} | {(m, t): 0.9 for t, ms in gates.items() for m in ms}
    assert got == want
    f = spark.createDataFrame([(1, 2), (1, 3)], "frame long, meas int")
    forbidden = spark.createDataFrame([(1, 1, 4)], "frame long, track int, meas int")
    got = {(x.meas, x.track) for x in layout.measurement_form(r, f, forbidden).collect()}
    assert got == {k for k in want if k not in {(2, 0), (3, 0), (4, 1)}}
    assert {x.component for x in layout.components(r).collect()} == {1}
    z = layout.track_evidence(spark.createDataFrame([(1, 2.0)], "frame long, z double"), r).first().z
    assert math.isclose(z, 2 * math.exp(0.4))
    kept = spark.createDataFrame([(1, 1)], "frame long, track int")
    assert layout.of_tracks(r, kept).count() == 3 and layout.of_tracks(r, kept, drop=True).count() == len(rows) - 3


def test_a_track_that_surely_does_not_exist_has_no_marginals(spark):
    m = spark.createDataFrame([(1, 1, "missed", 0, 0.0), (1, 1, "nonexistence", None, 1.0), (1, 2, "missed", 0, 0.2), (1, 2, "detection", 3, 0.6)], schema.MARGINAL)
    got = {(x.track, x.meas): x.p for x in layout.nonexistence_removed(m).collect()}
    assert got[1, 0] is None and math.isclose(got[2, 3], 0.75)


def test_open_associations_without_tracks_or_measurements(spark):
    got = spark.createDataFrame([(0, 5), (3, 0), (3, 3), (2, 5)], "n int, m int").select(layout.open_associations(F.col("n"), F.col("m")).alias("x")).collect()
    assert [r.x for r in got] == [1.0, 1.0, 34.0, 31.0]


def element(kind, data, order="<"):
    return struct.pack(order + "II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def array(name, a, order="<", kind=6, number=9, fmt="f8"):
    a = np.atleast_2d(np.asarray(a))
    data = a.astype(order + fmt).tobytes(order="F")
    parts = element(6, struct.pack(order + "II", kind, 0), order) + element(5, struct.pack(f"{order}{a.ndim}i", *a.shape), order) + element(1, name.encode(), order)
    return element(14, parts + element(number, data, order), order)


def small(name, value):
    """A scalar of one byte in the short form of an element."""
    parts = element(6, struct.pack("<II", 6, 0)) + element(5, struct.pack("<2i", 1, 1)) + struct.pack("<HH", 1, len(name)) + name.encode().ljust(4, b"\0") + struct.pack("<HH", 2, 1) + bytes([value, 0, 0, 0])
    return element(14, parts)


def file(*arrays, order="<", packed=True):
    body = b"".join(struct.pack(order + "II", 15, len(z)) + z for z in map(zlib.compress, arrays)) if packed else b"".join(arrays)
    return b"made by a test".ljust(124) + struct.pack(order + "H", 0x0100) + (b"IM" if order == "<" else b"MI") + body


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("packed", [True, False])
def test_mat_numbers(order, packed):
    cube = np.arange(24.0).reshape(2, 3, 4)
    data = file(array("a", cube, order), array("b", [[1, 2], [3, 4]], order, number=3, fmt="i2"), array("c", np.zeros((3, 0)), order), order=order, packed=packed)
    got = matfile.parse(data)
    assert (got["a"] == cube).all() and got["b"].tolist() == [[1, 2], [3, 4]] and got["c"].shape == (3, 0)
    assert list(matfile.parse(data, ["b"])) == ["b"]


def test_mat_other_classes():
    head = lambda kind, shape, name: element(6, struct.pack("<II", kind, 0)) + element(5, struct.pack("<2i", *shape)) + element(1, name)
    cell = element(14, head(1, (1, 2), b"cell") + array("", [[7.0]]) + element(14, b""))
    text = element(14, head(4, (1, 2), b"text") + element(16, b"hi"))
    record = element(14, head(2, (1, 1), b"rec") + element(5, struct.pack("<i", 4)) + element(1, b"x\0\0\0yy\0\0") + array("", [[1.0]]) + array("", [[2.0]]))
    sparse = element(14, head(5, (3, 2), b"sp") + element(5, struct.pack("<2i", 2, 0)) + element(5, struct.pack("<3i", 0, 1, 2)) + element(9, struct.pack("<2d", 5.0, 6.0)))
    got = matfile.parse(file(cell, text, record, sparse, small("s", 9)))
    assert got["cell"][0, 0].item() == 7 and got["cell"][0, 1].size == 0 and got["text"] == "hi" and got["s"].item() == 9
    assert {k: v.item() for k, v in got["rec"][0, 0].items()} == {"x": 1, "yy": 2} and got["sp"].tolist() == [[0, 6], [0, 0], [5, 0]]
    for bad in (b"", b"x" * 200, file(array("a", [[1.0]]), packed=False)[:-4]):
        with pytest.raises(ValueError):
            matfile.parse(bad)


def test_read_mat(spark, tmp_path):
    inf = -np.inf
    gain = np.array([[3.0, inf, -0.6, inf, 0], [3.2, 1.0, inf, -0.5, 0]])  # wider than n + m
    log = [0.0, 0.0, 0.0, math.log(3.0)]
    common = [array("trackFile", np.zeros((3, 2))), array("measurements", np.zeros((2, 2))), array("gainMatPostC", gain), array("unused", [[1.0]]), array("hypos", [[1, 2, 1, 2]]), array("hyposCard", [[2, 1, 1, 0]]),
              array("clusters", [[1, 2, 3, 4]]), array("clustersCard", [[2, 2]]), array("probLogHypos", [log]), array("assocLocal", [[1, 1], [1, 0]])]
    (tmp_path / "in").mkdir()
    (tmp_path / "run_0007.mat").write_bytes(file(*common, array("predX", np.ones((4, 2))), array("predP", np.ones((4, 4, 2)))))
    (tmp_path / "in" / "run_0008.mat").write_bytes(file(*common, packed=False))
    (tmp_path / "notes.txt").write_bytes(b"not read")
    s = matfile.read_mat(spark, str(tmp_path)).orderBy("frame")
    a, b = s.collect()
    assert (a.frame, b.frame, a.n_tracks, a.n_meas, b.pred_x) == (7, 8, 2, 2, None)
    assert (len(a.pred_x), len(a.pred_p), len(a.pred_p[0])) == (2, 2, 4)
    assert sorted(map(tuple, snapshots.to_reward(s.filter("frame = 7")).collect())) == [(7, 1, 0, -0.6), (7, 1, 1, 3.0), (7, 2, 0, -0.5), (7, 2, 1, 3.2), (7, 2, 2, 1.0)]
    h = snapshots.decode_hypotheses(s.filter("frame = 8")).orderBy("cluster", "hypo").collect()
    assert [(x.cluster, x.hypo, x.tracks, round(x.prob, 6)) for x in h] == [(0, 0, [1, 2], 0.5), (0, 1, [1], 0.5), (1, 0, [2], 0.25), (1, 1, [], 0.75)]
    assert sorted(map(tuple, matfile.cluster_map(s).collect())) == [(f, c, 0, c == 0) for f in (7, 8) for c in (0, 1)]
    (tmp_path / "run_0009.mat").write_bytes(b"x" * 300)
    with pytest.raises(Exception, match="run_0009"):
        matfile.read_mat(spark, str(tmp_path)).collect()


CANONICAL = {1: (-0.60, 3.0, None), 2: (-0.56, 3.2, None), 3: (-0.46, -3.0, 1.2), 4: (-0.62, None, 3.0), 5: (-0.55, None, -0.4)}
HYPOTHESES = [(0, 0, [1, 2], 0.5), (0, 1, [1, 3], 0.5), (1, 0, [4], 0.5), (1, 1, [5], 0.5)]


def canonical():
    return [(t, j, ll) for t, lls in CANONICAL.items() for j, ll in enumerate(lls) if ll is not None]


def test_elimination_of_the_canonical_problem():
    domains, table = factors.graph(canonical(), HYPOTHESES)
    assert math.isclose(math.exp(factors.eliminated(domains, table)[1]), 228.5276770589719)
    p, _ = factors.eliminated(domains, table, ("track", 3))
    assert dict(zip(domains["track", 3], p.round(8).tolist(), strict=True)) == {0: 0.31165938, 1: 0.00065374, 2: 0.08355627, -1: 0.60413061}
    p, _ = factors.eliminated(domains, table, ("hypothesis", 1))
    assert p.round(6).tolist() == [0.904496, 0.095504]


def test_messages_are_exact_on_a_tree_and_close_elsewhere():
    tree = [(1, 0, -0.5), (1, 1, 2.0), (2, 0, -0.5), (2, 2, 1.0)]
    domains, table = factors.graph(tree, [(0, 0, [1], 0.7), (0, 1, [2], 0.3)])
    beliefs, steps = factors.passed(domains, table)
    assert steps < 20 and all(np.allclose(beliefs[v], factors.eliminated(domains, table, v)[0]) for v in domains)
    domains, table = factors.graph(canonical(), HYPOTHESES)
    beliefs, _ = factors.passed(domains, table)
    assert max(np.abs(beliefs[v] - factors.eliminated(domains, table, v)[0]).max() for v in domains) < 0.1


def test_elimination_of_odd_frames(spark, monkeypatch):
    r = spark.createDataFrame([(1, 1, 0, 0.0), (1, 9, 0, 0.0)], schema.REWARD)
    h = spark.createDataFrame([(1, 0, 0, [1], 1.0), (2, 0, 0, [], 1.0), (3, 0, 0, [4], 1.0)], schema.HYPOTHESIS)
    got = {(x.frame, x.kind, x.key, x.value): (x.p, x.log_z) for x in factors.by_elimination(r, h).collect()}
    assert got[1, "track", 1, 0] == (1.0, 0.0) and got[2, "hypothesis", 0, 0] == (1.0, 0.0)  # track 9 is in no hypothesis
    assert got[3, "track", 4, 0] == (0.0, float("-inf"))  # without a weight nothing is possible
    assert factors.by_elimination(r.limit(0), h.limit(0)).count() == 0
    assert factors.by_messages(r, h).filter("frame = 1 and kind = 'track' and value = 0").first().p == 1.0
    monkeypatch.setattr(factors, "LIMIT", 1)
    with pytest.raises(ValueError):
        factors.eliminated(*factors.graph(canonical(), HYPOTHESES))


def test_messages_reach_the_fixed_point_of_propagation(spark, sf_dir):
    from lattica.operators import lbp
    from lattica.plans.problems import problem

    r, h = problem(spark, sf_dir)
    few = r.select("frame").distinct().orderBy("frame").limit(40)
    r, h = r.join(few, "frame"), h.join(few, "frame")
    want = {(x.frame, x.track, x.meas if x.kind != "nonexistence" else -1): x.p for x in lbp.lbp(r, h, 40).filter("kind IN ('missed', 'detection', 'nonexistence')").collect()}
    got = {(x.frame, x.key, x.value): x.p for x in factors.by_messages(r, h, 2000).filter("kind = 'track'").collect()}
    assert want and max(abs(want[k] - got[k]) for k in want if want[k] is not None) < 1e-3


def test_histories(spark):
    rows = [(1, [None, 0, 3, 0, 0]), (2, [1, 0, 0, 0, 2]), (3, [3, 0, 0]), (4, []), (5, [None, None])]
    t = spark.createDataFrame(rows, "track int, history array<int>")
    h = F.col("history")
    got = {r[0]: tuple(r[1:]) for r in t.select("track", histories.last_misses(h), histories.longest_silence(h), histories.encoded(h, 3).cast("long")).collect()}
    code = lambda xs: sum((4 if x is None else x) * 5**i for i, x in enumerate(xs))
    assert got == {1: (2, 2, code(rows[0][1])), 2: (0, 3, code(rows[1][1])), 3: (2, 2, code(rows[2][1])), 4: (0, 0, 0), 5: (0, 0, code([None, None]))}
    ids = lambda df: sorted(r.track for r in df.collect())
    assert ids(histories.found(t, [3, 0, 0])) == [1, 3, 4]  # an empty history has nothing to disagree
    assert ids(histories.found(t, [None, 0, 3, 0, 0])) == [1, 3, 4] and ids(histories.found(t, [None])) == [4, 5]
    assert ids(histories.others(t, [[0, 0], [2]])) == [5]


def test_segments_splits_and_repeats(spark):
    t = spark.createDataFrame([(1, 1, [5, 0, 7], 1.0), (1, 2, [5, 0, 0], 0.5), (1, 3, [0, 0], 0.8), (1, 4, [2, 7], 1.0)], "frame long, track int, history array<int>, exi double")
    h = spark.createDataFrame([(1, 0, 0, [1, 2], 3.0), (1, 0, 1, [1], 1.0), (1, 1, 0, [3], 0.1), (1, 1, 1, [], 0.9), (1, 2, 0, [4, 1], 1.0)], schema.HYPOTHESIS)
    a = histories.segment_probability(t, h.filter("cluster < 2"), [5, 0], 8, 9, 10).first()
    assert a.tracks == [1, 2, 3] and math.isclose(a.p, 1.0 + 0.75 * 0.5 + 0.1 * 0.8)  # the third began at scan 9
    assert histories.segment_probability(t, h, [9], 1, 1, 10).count() == 0  # before all histories
    with pytest.raises(ValueError):
        histories.segment_probability(t, h, [1], 1, 2, 3)
    assert [tuple(r) for r in histories.repeated_measurements(h, t).collect()] == [(1, 2, 0, 7)]
    weak = histories.splitting_tracks(h, t, 0.2)
    assert [r.track for r in weak.collect()] == [3]
    left = {(r.cluster, tuple(r.tracks)): r.prob for r in histories.without_tracks(h.filter("cluster < 2"), spark.createDataFrame([(1, 2), (1, 3)], "frame long, track int")).collect()}
    assert left == {(0, (1,)): 1.0, (1, ()): 1.0}
    parts = sorted((r.cluster, r.part, r.tracks, round(r.prob, 9)) for r in histories.split_clusters(h.filter("cluster < 2"), 0.7).collect())
    assert parts == [(0, 1, [1], 1.0), (0, 2, [], 0.25), (0, 2, [2], 0.75), (1, 0, [], 0.9), (1, 0, [3], 0.1)]
