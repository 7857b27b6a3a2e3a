import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lattica import schema
from lattica.functions import gaussian, logspace, ragged
from lattica.plans import catalog, problems
from lattica.sources import snapshots
from lattica.streaming import tracker


def same(a, b):
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    return sorted(map(key, a)) == sorted(map(key, b))


@pytest.mark.parametrize("name", ["exact_marginals", "theta_posteriors", "lbp_marginals", "bethe_evidence", "conditioned_evidence", "error_by_kind", "scenario_stats", "k_best_assignments"])
def test_queries_equal_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("events", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, sf_dir)
    want = con.sql(catalog.ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert same(df.select(*want.columns).collect(), want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_sources(spark, tmp_path):
    r = spark.createDataFrame([(1, 1, 0, -0.5)], schema.REWARD)
    h = spark.createDataFrame([(1, 0, 0, [1], 1.0)], schema.HYPOTHESIS)
    c = spark.createDataFrame([(1, 0, 0, True)], schema.CLUSTER_MAP)
    snapshots.write_problem(str(tmp_path / "p"), r, h, c)
    assert [x.collect() for x in snapshots.read_problem(spark, str(tmp_path / "p"), 1)] == [r.collect(), h.collect(), c.collect()]
    with pytest.raises(ValueError):
        snapshots.read_problem(spark, str(tmp_path / "p"), 2)
    snap = spark.createDataFrame([(7, [1, 2, 1, 3, 4], [2, 2, 1, 0], [1, 2, 3, 4], [2, 2], [0.0, 0.0, 0.0, float(np.log(3.0))])], "frame long, hypos array<int>, hypos_card array<int>, clusters array<int>, clusters_card array<int>, log_probs array<double>")
    got = snapshots.decode_hypotheses(snap).orderBy("cluster", "hypo").collect()
    assert [(x.cluster, x.hypo, x.tracks, round(x.prob, 6)) for x in got] == [(0, 0, [1, 2], 0.5), (0, 1, [1, 3], 0.5), (1, 0, [4], 0.25), (1, 1, [], 0.75)]
    inf = float("-inf")
    m = spark.createDataFrame([(1, [[1.0, inf, -0.6, inf], [2.0, 3.0, inf, -0.5]])], "frame long, matrix array<array<double>>")
    assert sorted(map(tuple, snapshots.to_reward(m).collect())) == [(1, 1, 0, -0.6), (1, 1, 1, 1.0), (1, 2, 0, -0.5), (1, 2, 1, 2.0), (1, 2, 2, 3.0)]
    t = spark.createDataFrame([("m: {rows: 2, cols: 3, data: [1, 2.5, 3, 4, 5, 6]}", "a/b/run_0042.mat")], "t string, path string")
    assert t.select(snapshots.text_matrix(F.col("t")), snapshots.frame_of_path(F.col("path"))).first() == ([[1.0, 2.5, 3.0], [4.0, 5.0, 6.0]], 42)
    snapshots.write_paths(t, str(tmp_path / "paths"))
    snapshots.write_sheet(t, str(tmp_path / "sheet"))
    snapshots.write_results(r, str(tmp_path / "res"), "frame")
    assert snapshots.read_results(spark, str(tmp_path / "res")).count() == 1


def test_functions(spark):
    one = spark.range(1)
    a, b = F.array(*map(F.lit, (3, 1, 5))), F.array(*map(F.lit, (5, 2, 3)))
    row = one.select(ragged.union_sorted(a, b), ragged.matches(a, b), ragged.without(a, F.array(F.lit(2))), ragged.parts(a, F.array(F.lit(2), F.lit(0), F.lit(1))), ragged.cumulative(a), ragged.heaviside(F.lit(0.0))).first()
    assert tuple(row) == ([1, 2, 3, 5], [3, 0, 1], [3, 5], [[3, 1], [], [5]], [3.0, 4.0, 9.0], 0.5)
    lp = spark.createDataFrame([(1, 0.0), (1, float("nan")), (1, 700.0), (2, -5.0)], "g int, x double")
    got = sorted((r.g, round(r.n, 6)) for r in lp.select("g", logspace.log_normalized(F.col("x"), "g").alias("n")).collect() if r.n > float("-inf"))
    assert got == [(1, -700.0), (1, 0.0), (2, 0.0)]
    assert {r.g: round(r.lse, 6) for r in logspace.logsumexp(lp.filter("not isnan(x)"), "x", "g").collect()} == {1: 700.0, 2: -5.0}
    parts = spark.createDataFrame([(1, 2), (2, 0), (3, 3)], "c int, n int")
    assert [r.b for r in parts.withColumn("b", ragged.begins(F.col("n"), "c")).orderBy("c").collect()] == [1, 3, 3]
    m = [[4.0, 1.0, 0.5], [1.0, 3.0, 0.2], [0.5, 0.2, 2.0]]
    assert gaussian.covariance_vector(m) == [4.0, 3.0, 2.0, 1.0, 0.5, 0.2] and gaussian.covariance_matrix(gaussian.covariance_vector(m)) == m
    v = one.select(gaussian.log_normal_2d(F.lit(1.0), F.lit(2.0), F.lit(2.0), F.lit(0.5), F.lit(1.0)), gaussian.missed_existence(F.lit(0.5), 0.9)).first()
    s = np.array([[2.0, 0.5], [0.5, 1.0]])
    want = -0.5 * np.array([1, 2]) @ np.linalg.inv(s) @ np.array([1, 2]) - 0.5 * np.log(np.linalg.det(2 * np.pi * s))
    assert v[0] == pytest.approx(want) and v[1] == pytest.approx(0.05 / 0.55)


def scans(n=12):
    rng = np.random.default_rng(0)
    return [(s, k, float(50 * s + 3 * k + rng.normal())) for s in (1, 2) for k in range(n)] + [(1, k, float(rng.uniform(-500, 500))) for k in range(0, n, 4)]


def test_tracker_follows_a_target_and_the_stream_equals_the_fold(spark, tmp_path):
    rows = scans()
    out = tracker.track(spark.createDataFrame(rows, "scenario long, scan long, z double")).collect()
    last = [r for r in out if r.scan == 11 and r.scenario == 2]
    assert len(last) == 1 and abs(last[0].x - (100 + 33)) < 5 and last[0].exi > 0.9
    path, told = str(tmp_path / "in"), str(tmp_path / "out")
    schema_ = "scenario long, scan long, z double"
    for part, (lo, hi) in enumerate(((0, 5), (5, 12))):
        spark.createDataFrame([r for r in rows if lo <= r[1] < hi], schema_).coalesce(1).write.mode("append").parquet(path)
        stream = tracker.track_stream(spark.readStream.schema(schema_).parquet(path))
        q = stream.writeStream.format("parquet").option("path", told).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    got = spark.read.parquet(told).collect()
    key = lambda r: (r.scenario, r.scan, r.track, round(r.x, 6), round(r.exi, 6), r.meas)
    assert sorted(map(key, got)) == sorted(map(key, out))


def test_tracked_sectors_have_competing_targets(spark, sf_dir):
    out = catalog.QUERIES["tracked_sectors"](spark, sf_dir).toPandas()
    assert set(out["scenario"]) == set(range(8))
    picked = out[out["meas"] > 0].groupby(["scenario", "scan"]).size()
    assert (picked > 1).any()


def test_each_scenario_is_tracked_in_a_task_of_its_own(spark):
    rows = [(s, k, float(50 * s + k)) for s in range(4) for k in range(20)]
    out = tracker.track(spark.createDataFrame(rows, "scenario long, scan long, z double"))
    assert out.select("scenario", F.spark_partition_id().alias("p")).distinct().agg(F.countDistinct("p"), F.count("*")).first()[:] == (4, 4)


def test_frames_of_large_cells_stay_apart(spark, tmp_path):
    base = 1_700_000_000 // 3600 * 3600
    rows = [(k, base + 3600 * h, u, float(k % 97)) for k, (h, u) in enumerate([(0, 0)] * 4100 + [(0, 1)] * 300 + [(1, 0)] * 9)]
    ev = spark.createDataFrame(rows, "event_id long, s long, user_id long, value double")
    ev.select("event_id", F.timestamp_seconds("s").alias("ts"), "user_id", "value").write.parquet(str(tmp_path / "events.parquet"))
    _, meas = problems.frames(spark, str(tmp_path))
    assert meas.count() == 4409 == meas.select("frame", "meas").distinct().count()
    cell = base // 3600 * 8
    got = {r.cell: [int(n) for n in r.lengths.split(",")] for r in catalog.QUERIES["ragged_lengths"](spark, str(tmp_path)).collect()}
    assert got == {cell: [4] * 1025, cell + 1: [4] * 75, cell + 8: [4, 4, 1]}
    frame = spark.createDataFrame([(c, b) for c in (-9, 0, 4_000_007) for b in (0, 999, 1000, 2**31)], "cell long, block long")
    assert frame.filter(problems.cell_of(problems.frame_of(F.col("cell"), F.col("block"))) != F.col("cell")).count() == 0
