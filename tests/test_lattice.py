"""Sums and best associations by lattices against enumeration."""

import math
import random
from functools import partial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lattica import schema
from lattica.functions.lineage import kept
from lattica.operators import assignment, conditioning, dense, exact, factors, search, shapes, single, stats
from lattica.operators import hypotheses as hy


def tables(spark, seed, frames=6):
    rng = random.Random(seed)
    reward, hypos = [], []
    for f in range(frames):
        t = 0
        for c in range(rng.randrange(1, 4)):
            own = list(range(t + 1, t + 1 + rng.randrange(0, 4)))
            t += len(own)
            hypos += [(f, c, k, sorted(rng.sample(own, rng.randrange(0, len(own) + 1))), rng.random() + 0.1) for k in range(rng.randrange(1, 4))]
        for x in range(1, t + 1):
            reward += [(f, x, j, rng.gauss(0, 2)) for j in range(5) if rng.random() < 0.5]
    return spark.createDataFrame(reward, schema.REWARD), spark.createDataFrame(hypos, schema.HYPOTHESIS)


@pytest.mark.parametrize("seed", range(3))
def test_sums_equal_those_of_associations(spark, seed):
    r, h = map(kept, tables(spark, seed))
    cm = kept(hy.merge_map(r, h))
    want = {(x.frame, x.master, x.kind, x.a, x.b): x for x in exact.masses(exact.joint(r, h, cm)).collect()}
    for given in (cm, None):
        sums = kept(exact.summed(r, h, given, hypos=True))
        got = {(x.frame, x.master, x.kind, x.a, x.b): x for x in sums.collect()}
        assert {k for k in got if k[2] not in ("cluster", "track")} == set(want)
        assert {k: got[k].lw for k in want} == pytest.approx({k: x.lw for k, x in want.items()})
        assert {k: got[k].n for k in want if k[2] in ("all", "hypo")} == {k: x.n for k, x in want.items() if k[2] in ("all", "hypo")}
        assert sorted(exact.map_of(sums).collect()) == sorted(cm.select("frame", "cluster", "master", "is_master").collect())
        assert sorted(exact.tracks_of(sums).collect()) == sorted(exact.members(h, cm).collect())


def test_sums_where_associations_are_too_many_to_list(spark):
    """Eight tracks that compete for eight measurements have 1,441,729 associations, with a bound of 43,046,721."""
    r = spark.createDataFrame([(0, t, j, math.sin(t * j)) for t in range(1, 9) for j in range(9)], schema.REWARD)
    h = spark.createDataFrame([(0, 0, 0, list(range(1, 9)), 1.0)], schema.HYPOTHESIS)
    e = exact.evidence(exact.summed(r, h)).first()
    assert e.n_joint == 1_441_729
    assert e.log_z == pytest.approx(factors.by_elimination(r, h).first().log_z)


def test_ranked_weights_equal_those_of_the_search(spark):
    r, h = map(kept, tables(spark, 5))
    want = [(x.frame, x.master, x.rank, x.ll) for x in search.best_associations(r, h, 20).orderBy("frame", "master", "rank").collect()]
    rows = exact.ranked(r, h, 20).orderBy("frame", "master", "rank").collect()
    assert [(x.frame, x.master, x["rank"]) for x in rows] == [x[:3] for x in want]
    assert [x.ll for x in rows] == pytest.approx([x[3] for x in want])
    z = {(x.frame, x.master): x.log_z for x in exact.evidence_by_master(exact.summed(r, h)).collect()}
    for x in rows:
        held = sum(math.exp(y.ll) for y in rows if (y.frame, y.master) == (x.frame, x.master))
        assert (x.log_held, x.log_z) == pytest.approx((math.log(held), z[x.frame, x.master]))


def test_best_of_associations_that_are_too_many_to_list(spark):
    """A bound of 43,046,721 associations, over exact.LIMIT: all tracks of 0 and 8 measurements, all weights alike."""
    clusters = [(0, [(0, 0.0, list(range(1, 9)))])]
    assert exact.best_weights(clusters, {t: [(j, float(j == 0)) for j in range(9)] for t in range(1, 9)}, 100) == [8.0, *[7.0] * 64, *[6.0] * 35]


def test_listed_associations_equal_those_of_partitioning():
    rng = random.Random(2)
    for _ in range(20):
        rows = [(t, j, rng.gauss(0, 2)) for t in range(rng.randrange(1, 5)) for j in range(5) if rng.random() < 0.6]
        t, j, ll = (np.array(x) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        want = assignment.murty(assignment.frame_matrix(t, j, ll)[1], 150)
        got = assignment.best_picks(t, j, ll, 150)
        assert [x for x, _ in got] == pytest.approx([x for _, x in want])
        for total, picks in got:
            assert total == pytest.approx(sum(x for a, b, x in rows if (a, b) in picks)) and len({b for _, b in picks if b}) == sum(b > 0 for _, b in picks)


def test_competition_equals_that_of_joint_hypotheses(spark):
    r, h = map(kept, tables(spark, 7))
    want = stats.histogram(stats.competing_by_hypothesis(r, hy.merged(h, hy.merge_map(r, h))), "n_tracks")
    assert sorted(map(tuple, stats.competition(r, h).collect())) == sorted(map(tuple, want.collect()))


def test_chains_equal_the_tree():
    rng = random.Random(4)
    for _ in range(30):
        reward, hypos, t = [], [], 0
        for c in range(rng.randrange(1, 4)):
            own = list(range(t + 1, t + 1 + rng.randrange(1, 4)))
            t += len(own)
            hypos += [(c, k, sorted(rng.sample(own, rng.randrange(0, len(own) + 1))), rng.random() + 0.1) for k in range(rng.randrange(1, 4))]
        reward = [(x, j, rng.gauss(0, 2)) for x in range(1, t + 1) for j in range(5) if rng.random() < 0.6]
        want, log_z = factors.JunctionTree(*factors.graph(reward, hypos)).calibrated()
        domains, got, z = factors.chained_beliefs(reward, hypos)
        assert domains == factors.graph(reward, hypos)[0] and list(got) == list(domains)
        assert z == pytest.approx(log_z)
        for v, p in want.items():
            assert got[v] == pytest.approx(p, abs=1e-9)


def test_frames_that_differ_in_numbers_alone_are_one_shape(spark):
    """Track 1 gates two measurements, of which track 2 gates one, whatever their numbers."""
    rng = random.Random(6)
    reward, hypos = [], []
    for f in range(20):
        a, b = rng.sample(range(1, 9), 2)
        reward += [(f, t, j, rng.gauss(0, 2)) for t, j in ((1, 0), (1, a), (1, b), (2, 0), (2, b))]
        hypos += [(f, 0, 0, [1], rng.random() + 0.1), (f, 1, 0, [2], 0.5), (f, 1, 1, [], rng.random() + 0.1)]
    r, h = spark.createDataFrame(reward, schema.REWARD), spark.createDataFrame(hypos, schema.HYPOTHESIS)
    batch = exact.by_frame(r, h).toPandas().map(lambda x: np.array(x) if isinstance(x, list) else x)
    (shape,) = shapes.grouped(batch)
    assert sorted(shape.frame) == list(range(20))
    for frames in exact.frame_rows([batch]):
        for frame, masters, clusters, weights in frames:
            at = list(shape.frame).index(frame)
            log_z, n, _ = exact.lattice(exact.by_master(masters, clusters)[0], weights)
            got_z, got_n, _ = exact.lattice(exact.by_master(masters, shape.clusters)[0], shape.weights, shape.counts)
            assert (got_z[at], got_n[at]) == (pytest.approx(log_z), n)


def test_messages_of_many_hypotheses_stop_by_themselves():
    rng = np.random.default_rng(3)
    a = rng.gamma(0.5, 3.0, (40, 3, 4)) * (rng.random((40, 3, 4)) < 0.7)
    for tol, most in ((single.TOL, single.MOST), (0.0, 6)):
        mu, nu, k = single.messages_of_all(a, tol, most)
        for i in range(len(a)):
            want = single.messages(a[i], tol, most)
            assert k[i] == want[2]
            assert (mu[i], nu[i]) == (pytest.approx(want[0]), pytest.approx(want[1]))
        assert tol == 0 or len(set(k.tolist())) > 1


def test_no_rows_are_a_table():
    columns = [c.split()[0] for c in exact.SUMS.split(", ")]
    out = exact.table([], columns, {"frame": "int64"})
    assert list(out) == columns and out["kind"].dtype == object and out["frame"].dtype == "int64"


def batch_of(r, h, cm=None):
    return exact.by_frame(r, h, cm).toPandas().map(lambda x: np.array(x) if isinstance(x, list) else x)


@pytest.mark.parametrize("seed", range(3))
def test_masters_of_one_size_equal_those_solved_alone(spark, seed):
    r, h = map(kept, tables(spark, seed, 20))
    cm = kept(hy.merge_map(r, h))
    batch = batch_of(r, h, cm)
    parts, left = conditioning._by_size(batch)
    assert len(left) < len(batch)
    alone = partial(conditioning.enumerated)  # not the solver itself, so frames are taken by shape
    names = [c.split()[0] for c in conditioning.SUMS.split(", ")]
    want, got = (
        {tuple(None if v is None or v != v else v for v in (x.frame, x.master, x.kind, x.a, x.b)): x.p for x in pd.concat(list(conditioning._summed([batch], s, True))).astype({"a": float, "b": float})[names].itertuples()}
        for s in (alone, conditioning.enumerated)
    )
    # hypotheses that can't be have 0, or no row
    want, got = ({k: p for k, p in x.items() if k[2] != "label" or p > 1e-12} for x in (want, got))
    assert got == pytest.approx(want, abs=1e-12)
    pairs, left = factors._by_size(batch_of(r, h))
    columns = [c.split()[0] for c in factors.RESULT.split(", ")]
    got = {(x.frame, x.kind, x.key, x.value): (x.p, x.log_z) for x in exact.table(pairs, columns, {}).itertuples()}
    assert got and len(left) < len(batch)
    rows, hypos = r.collect(), h.collect()
    for f in {k[0] for k in got}:
        pairs, own, offset = factors.shifted([(x.track, x.meas, x.ll) for x in rows if x.frame == f], [(x.cluster, x.hypo, x.tracks, x.prob) for x in hypos if x.frame == f])
        domains, beliefs, log_z = factors.tree_beliefs(pairs, own)
        want = {(f, *v, x): p for v, b in beliefs.items() for x, p in zip(domains[v], b.tolist(), strict=True)}
        assert {k: got[k][0] for k in got if k[0] == f} == pytest.approx(want, abs=1e-12)
        assert all(x[1] == pytest.approx(log_z + offset) for k, x in got.items() if k[0] == f)


def test_mixtures_by_frame_equal_those_by_hypothesis(spark):
    r, h = tables(spark, 8, 12)
    r = kept(r.filter("meas > 0").unionByName(r.select("frame", "track").distinct().selectExpr("frame", "track", "0 AS meas", "CAST(-1 - track * 0.1 AS DOUBLE) AS ll")))
    h = kept(h.withColumn("tracks", F.array_sort(F.array_intersect("tracks", F.lit(list(range(1, 20)))))))
    known = {(x.frame, x.track) for x in r.collect()}
    h = kept(spark.createDataFrame([(x.frame, x.cluster, x.hypo, [t for t in x.tracks if (x.frame, t) in known], x.prob) for x in h.collect()], schema.HYPOTHESIS))
    cm = kept(hy.merge_map(r, h))
    m = kept(hy.merged(h, cm))
    rows = lambda df: {(x.frame, x.track, x.kind, x.meas): x.p for x in df.collect()}
    want = rows(single.total_probability(single.per_hypothesis(r, m, single.by_bethe, 0.0, 6), m))
    assert rows(single.mixed(r, h, cm, 6)) == pytest.approx(want)


def test_frames_of_one_size_are_passed_together(spark, monkeypatch):
    """A hundred frames whose tracks gate in their own way each, but four tracks share three measurements in all of them."""
    rng = random.Random(9)
    reward, hypos = [], []
    for f in range(100):
        reward += [(f, t, 0, -1.0) for t in range(1, 5)] + [(f, t, j, rng.gauss(0, 1)) for j in range(1, 4) for t in sorted({j, j + 1, rng.randrange(1, 5)})]
        hypos += [(f, 0, 0, [1, 2, 3, 4], 0.5), (f, 0, 1, rng.sample([1, 2, 3, 4], 2), 0.5)]
    r, h = spark.createDataFrame(reward, schema.REWARD), spark.createDataFrame(hypos, schema.HYPOTHESIS)
    sizes = []
    passed = dense.passed
    monkeypatch.setattr(dense, "passed", lambda g, conditioned: sizes.append(len(g.master)) or passed(g, conditioned))
    _, left = factors._by_size(batch_of(r, h))
    assert sizes == [100] and not len(left)
