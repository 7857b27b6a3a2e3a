"""The multi-target tracker: against truth, plain recursions and its own stream."""

import datetime
import math

import numpy as np
import pytest

from lattica.operators.assignment import gospa_by
from lattica.streaming import pmbm


def model(**more):
    birth = [(0.3, np.array([100.0, 100.0, 0.0, 0.0]), np.diag([1e4, 1e4, 9.0, 9.0]))]
    return pmbm.constant_velocity(birth=birth, **({"clutter": 2e-5, "hypotheses": 30} | more))


def scene(seed, scans, targets=4, detection=0.9):
    """(scan, z) rows and (scan, x) truth."""
    rng, m = np.random.default_rng(seed), model()
    x = [np.array([40.0 * k + 20, 100 + 30 * math.sin(k), 2.0 * (-1) ** k, 1.0]) for k in range(targets)]
    rows, truth = [], []
    for s in range(scans):
        x = [m.motion @ v for v in x]
        truth += [(s, v[:2].tolist()) for v in x]
        rows += [(s, (v[:2] + rng.normal(size=2) * 3).tolist()) for v in x if rng.random() < detection]
        rows += [(s, (rng.random(2) * 200).tolist()) for _ in range(rng.poisson(1))]
    return rows, truth


def test_estimates_come_close_to_the_truth(spark):
    rows, truth = scene(1, 25)
    z = spark.createDataFrame([(7, s, v) for s, v in rows], "scenario long, scan long, z array<double>").selectExpr("*", "'clash' as x", "1 as track").repartition(3)
    out = pmbm.track(z, model())
    est = out.selectExpr("scan", "slice(x, 1, 2) as x")
    errors = gospa_by(spark.createDataFrame(truth, "scan long, x array<double>"), est, "scan").orderBy("scan").collect()
    raw = gospa_by(spark.createDataFrame(truth, "scan long, x array<double>"), z.selectExpr("scan", "z as x"), "scan").collect()
    late = [r for r in errors if r.scan >= 8]
    assert np.mean([r.missed + r.false for r in late]) < 0.5
    assert np.mean([r.squared for r in late]) < 0.4 * np.mean([r.squared for r in raw if r.scan >= 8])
    labels = {r.track for r in out.collect() if r.scan >= 15}
    assert len(labels) <= 6  # targets keep their labels
    again = sorted(map(str, pmbm.track(z.repartition(7), model()).collect()))
    assert again == sorted(map(str, out.collect()))


def test_one_target_alone_is_a_kalman_filter():
    """Without clutter, births or misses to speak of, the one track is filtered as such."""
    m = model(clutter=1e-12, detection=0.999, survival=0.9999)
    x, p = np.array([50.0, 60.0, 1.0, -1.0]), np.diag([4.0, 4.0, 1.0, 1.0])
    m.birth = []
    w = pmbm.World(0, 2, [], {0: pmbm.Track(1, x, p, 0.999, (1,))}, [[((0,), 0.0)]])
    for k in range(1, 10):
        z = np.array([[50.0 + 1.2 * k, 60.0 - 0.9 * k]])
        w = pmbm.step(w, z, m, k)
        x, p = m.motion @ x, m.motion @ p @ m.motion.T + m.process
        s = m.measure @ p @ m.measure.T + m.noise
        g = p @ m.measure.T @ np.linalg.inv(s)
        x, p = x + g @ (z[0] - m.measure @ x), p - g @ s @ g.T
    [(label, got, exi)] = pmbm.estimates(w, m)
    assert label == 1 and np.allclose(got, x) and exi == 1.0
    assert np.allclose(next(iter(w.tracks.values())).p, p)


def test_existence_falls_without_measurements_and_returns_to_the_intensity():
    m = model()
    m.birth = []
    w = pmbm.World(0, 2, [], {0: pmbm.Track(1, np.zeros(4), np.eye(4), 0.9, (1,))}, [[((0,), 0.0)]])
    e = 0.9
    for k in range(1, 3):
        w = pmbm.step(w, np.zeros((0, 0)), m, k)
        e = e * m.survival
        e = e * (1 - m.detection) / (1 - e * m.detection)
        exis = [t.exi for t in w.tracks.values()]
        assert exis == pytest.approx([e] if e >= m.recycle else [])
    assert e < m.recycle and not w.clusters and sum(v for v, *_ in w.intensity) == pytest.approx(e)
    # scans that are left out count as steps of their own
    far = pmbm.step(pmbm.World(0, 1, [(0.5, np.zeros(4), np.eye(4))]), np.zeros((0, 0)), m, 4)
    assert far.intensity[0][0] == pytest.approx(0.5 * m.survival**4 * (1 - m.detection))


def test_invariants_and_state_after_each_scan():
    rows, _ = scene(5, 20, targets=6)
    m, w = model(hypotheses=15), pmbm.World()
    for s in range(20):
        w = pmbm.step(w, np.array(sorted(tuple(v) for k, v in rows if k == s)), m, s)
        assert max(map(len, w.clusters), default=0) <= 15  # what isn't doubtful stays beyond the frame's cap
        of = {}
        for c, hypos in enumerate(w.clusters):
            assert sum(math.exp(lp) for _, lp in hypos) == pytest.approx(1)
            assert len({ts for ts, _ in hypos}) == len(hypos)
            for ts, _ in hypos:
                for t in ts:
                    assert of.setdefault(t, c) == c  # a track is in one cluster
                last = [w.tracks[t].history[-1] for t in ts if w.tracks[t].history[-1] > 0]
                assert len(set(last)) == len(last)  # and a measurement in one track of a hypothesis
        assert set(of) == set(w.tracks) and len(w.intensity) <= m.components
        assert all(0 < t.exi <= 1 for t in w.tracks.values())
        assert pmbm.World.loaded(w.dumped()).dumped() == w.dumped()


def test_odd_rows(spark):
    z = [(1, 0, [10.0, 10.0]), (1, 0, [10.0, 10.0]), (1, 1, None), (1, 2, [math.nan, 1.0]), (1, 2, [10.5, 10.0]), (None, 0, [1.0, 1.0]), (2, None, [1.0, 1.0])]
    table = spark.createDataFrame(z, "scenario long, scan long, z array<double>")
    assert {r.scenario for r in pmbm.track(table, model(clutter=1e-9)).collect()} <= {1}
    assert pmbm.track(table.limit(0), model()).count() == 0


def test_stream_equals_fold_with_late_rows_and_expiry(spark, tmp_path):
    """Rows of a scan come over several batches and out of order, within the delay; one comes too late; the state of a scenario ends."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    rows, _ = scene(3, 8, targets=2)
    rows = [(k % 2 + 1, s, start + datetime.timedelta(minutes=s), z) for k, (s, z) in enumerate(rows)]
    # a row of scan s comes with those of scan s or the next
    batches = [[r for k, r in enumerate(rows) if r[1] + (k % 3 == 0) == b] for b in range(9)]
    far = lambda m: (9, 1000 + m, start + datetime.timedelta(minutes=m), [0.0, 0.0])
    late = (1, 2, start + datetime.timedelta(minutes=2), [1.0, 1.0])
    batches += [[far(60)], [late, far(61)], [far(600)], [far(601)], [far(2000)], [far(2001)]]
    schema = "scenario long, scan long, ts timestamp, z array<double>"
    path, told, seen = str(tmp_path / "in"), str(tmp_path / "out"), []
    for k, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(path)
        stream = pmbm.track_stream(spark.readStream.schema(schema).parquet(path), model(), "2 minutes", 120 * 60_000)
        q = stream.writeStream.format("parquet").option("path", told).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        seen.append(k)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.read.parquet(told).filter("scenario < 9").collect()
    want = pmbm.track(spark.createDataFrame(rows, schema).drop("ts"), model()).collect()
    assert sorted(str((r.scenario, r.scan, r.track, r.x, r.exi)) for r in got if r.kind == "track") == sorted(str((r.scenario, r.scan, r.track, r.x, r.exi)) for r in want)
    assert want and sorted(r.scenario for r in got if r.kind == "over") == [1, 2]
    # the late row is told, unless Spark itself has left it out as older than the watermark; either way it's in no state
    assert [(r.scenario, r.scan) for r in got if r.kind == "late"] in ([], [(1, 2)])


def test_a_step_updates_all_targets_at_once(monkeypatch):
    rows, _ = scene(3, 12)
    w, m, calls = pmbm.World(), model(), []
    plain = np.linalg.cholesky
    for s in range(12):
        z = pmbm._measurements([v for k, v in rows if k == s])
        if s == 11:
            monkeypatch.setattr(np.linalg, "cholesky", lambda a: calls.append(len(a)) or plain(a))
        before, w = w, pmbm.step(w, z, m, s)
    assert len(before.tracks) > 4 and sorted(calls) == sorted([len(before.intensity) + len(m.birth), len(before.tracks)])
    monkeypatch.undo()
    # each alone
    t, z = next(iter(before.tracks.values())), z[:3]
    x, p = m.motion @ t.x, m.motion @ t.p @ m.motion.T + m.process
    s = m.measure @ p @ m.measure.T + m.noise
    d, log, after, spread = pmbm._updated(*pmbm._predicted(t.x[None], t.p[None], m), z, m)
    for k, own in enumerate(z):
        nu, gain = own - m.measure @ x, p @ m.measure.T @ np.linalg.inv(s)
        assert d[0, k] == pytest.approx(nu @ np.linalg.inv(s) @ nu) and after[0, k] == pytest.approx(x + gain @ nu)
        assert log[0, k] == pytest.approx(-0.5 * (d[0, k] + np.log(np.linalg.det(2 * np.pi * s)))) and spread[0] == pytest.approx(p - gain @ s @ gain.T)
    empty = pmbm.step(pmbm.World(), np.zeros((0, 0)), m, 0)
    assert not empty.tracks and pmbm.step(empty, np.zeros((0, 0)), m, 3).last == 3
