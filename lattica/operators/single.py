"""Loopy belief propagation for one hypothesis (its tracks all exist), its Bethe log-evidence, and mixtures over joint hypotheses.

A joint hypothesis and the options of its tracks are one row; messages are numpy arrays of the rows of a batch with as many tracks and measurements."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import dense
from .exact import by_frame, table
from .shapes import WORD, flat

#: Stop when what's left is bounded under half of ln(1 + TOL), looked at every CHECK iterations; MOST iterations at most.
TOL, MOST, CHECK = 1e-3, 300, 5

RESULT = "frame long, master int, hypo int, track int, meas int, p double, log_z double, iterations int"


def single_hypothesis(w: np.ndarray, w0: np.ndarray, tol: float = TOL, most: int = MOST, check: int = CHECK, trace: list | None = None) -> tuple[np.ndarray, int]:
    """Probabilities (missed, detections) of each track and the iterations taken. With tol 0 there are exactly `most` iterations. `trace` gets
    (iteration, least, largest) of the messages to tracks."""
    mu, nu, k = messages(w / w0[:, None], tol, most, check, trace)
    p = np.concatenate([np.ones((len(w), 1)), w / w0[:, None] * nu], 1)
    return p / p.sum(1, keepdims=True), k


def messages(a: np.ndarray, tol: float = TOL, most: int = MOST, check: int = CHECK, trace: list | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Messages from tracks to measurements and back for detection weights relative to missed detections, and the iterations taken.

    The stop rule is the published one: the contraction of the last step of the messages to tracks bounds the distance to the fixed point.
    An implementation with another logarithm in it stops after other numbers of iterations, close to the same point."""
    nu, k = np.ones_like(a), 0
    mu, half = np.zeros_like(a), 0.5 * np.log1p(tol)
    top = float(a.sum(1).max(initial=0.0))
    while k < most:
        k += 1
        before, an = nu, a * nu
        mu = a / (1 + an.sum(1, keepdims=True) - an)
        nu = 1 / (1 + mu.sum(0, keepdims=True) - mu)
        if trace is not None and a.any():
            trace.append((k, float(nu[a > 0].min()), float(nu[a > 0].max())))
        if tol > 0 and k % check == 0:
            d = float(np.abs(np.log(np.where(a > 0, nu / before, 1.0))).max(initial=0.0))
            if d <= 0 or (alpha := (np.log1p(top * np.exp(d)) - np.log1p(top)) / d) * (d + half) < half:
                break
    return mu, nu, k


def messages_of_all(a: np.ndarray, tol: float = TOL, most: int = MOST, check: int = CHECK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`messages` of many problems of as many tracks and measurements, each of which stops by itself."""
    mu, nu, k = np.zeros_like(a), np.ones_like(a), np.zeros(len(a), int)
    half, top = 0.5 * np.log1p(tol), a.sum(-1).max(-1, initial=0.0)
    on, done = np.arange(len(a)), 0
    b, now = a, nu
    while len(on) and done < most:
        done += 1
        before, an = now, b * now
        to = b / (1 + an.sum(-1, keepdims=True) - an)
        now = 1 / (1 + to.sum(-2, keepdims=True) - to)
        met = np.zeros(len(on), bool)
        if tol > 0 and done % check == 0:
            d = np.abs(np.log(np.where(b > 0, now / before, 1.0))).max((-1, -2), initial=0.0)
            some = np.where(d > 0, d, 1.0)
            met = (d <= 0) | ((np.log1p(top[on] * np.exp(some)) - np.log1p(top[on])) / some * (some + half) < half)
        out = np.flatnonzero(met | (done == most))
        if len(out):
            mu[on[out]], nu[on[out]], k[on[out]] = to[out], now[out], done
            left = np.flatnonzero(~met)
            on, b, now = on[left], b[left], now[left]
    return mu, nu, k


def bethe(a: np.ndarray, w0: np.ndarray, mu: np.ndarray, nu: np.ndarray) -> float | np.ndarray:
    """Log-evidence of the messages' fixed point; of many problems, which stand in leading dimensions."""
    z = np.log(w0).sum(-1) + np.log1p((a * nu).sum(-1)).sum(-1) + np.log1p(mu.sum(-2)).sum(-1) - np.log1p(mu * nu).sum((-1, -2))
    return z if a.ndim > 2 else float(z)


def clean(w: np.ndarray, w0: np.ndarray, tol: float = TOL, most: int = MOST, free: np.ndarray | float = 1.0) -> tuple[np.ndarray, np.ndarray | float]:
    """Probabilities (missed, detections) and log-evidence without division by missed detections, whose weight may be 0 where a track has
    detections. Sums over others are taken without the own term, as messages may be very large. `free`: what each measurement weighs
    without a track. Several problems of the same tracks stand in leading dimensions of w (and of w0, and of free before a dimension of one)."""
    others = lambda n: 1.0 - np.eye(n)
    rows, columns, nu = others(w.shape[-2]), others(w.shape[-1]), np.ones_like(w)
    mu = np.zeros_like(w)
    for _ in range(most):
        before = nu
        mu = w / np.maximum(w0[..., None] + (w * nu) @ columns, 1e-300)
        nu = 1 / (free + rows @ mu)
        if tol > 0 and (np.abs(nu - before).max(axis=(-1, -2), initial=0.0) <= tol * np.maximum(1.0, nu.max(axis=(-1, -2), initial=0.0))).all():
            break
    p = np.concatenate([np.broadcast_to(w0[..., None], (*w.shape[:-1], 1)), w * nu], -1)
    total = p.sum(-1)
    log_z = np.log(total).sum(-1) + np.log(free + mu.sum(-2, keepdims=True)).sum((-1, -2)) - np.log1p(mu * nu).sum((-1, -2))
    return p / total[..., None], log_z if w.ndim > 2 else float(log_z)


def new_track_probability(mu: np.ndarray) -> np.ndarray:
    """That each measurement belongs to no track."""
    return 1 / (1 + mu.sum(0))


def phd_constant(w: np.ndarray, w0: np.ndarray) -> float | np.ndarray:
    """Log of exp(-sum(1 - w0)) times the product over measurements of 1 plus their tracks' weights."""
    z = -(1 - w0).sum(-1) + np.log1p(w.sum(-2)).sum(-1)
    return z if w.ndim > 2 else float(z)


#: What gives the log-evidence of a hypothesis, or of many in a leading dimension: (w, w0, mu, nu) -> log Z.
Evidence = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], float | np.ndarray]


def by_bethe(w: np.ndarray, w0: np.ndarray, mu: np.ndarray, nu: np.ndarray) -> float | np.ndarray:
    return bethe(w / w0[..., None], w0, mu, nu)


def by_phd(w: np.ndarray, w0: np.ndarray, mu: np.ndarray, nu: np.ndarray) -> float | np.ndarray:
    return phd_constant(w, w0)


def _solved(batch: pd.DataFrame, log_z: Evidence, tol: float, most: int) -> pd.DataFrame:
    """RESULT of a batch of joint hypotheses and their frames' options: those of as many tracks and measurements are solved at once."""
    n = len(batch)
    tracks, t_row = flat(batch["tracks"], int)
    t, o_row = flat(batch["t"], int)
    j, e = flat(batch["j"], int)[0], np.exp(flat(batch["ll"], float)[0])
    # tracks and measurements by their place in their hypothesis
    member = np.unique(t_row * WORD + tracks)
    key = o_row * WORD + t
    own = np.isin(key, member)
    key, o_row, j, e = key[own], o_row[own], j[own], e[own]
    gated = np.unique((o_row * WORD + j)[j > 0])
    t_first, j_first = (np.searchsorted(x // WORD, np.arange(n + 1)) for x in (member, gated))
    r, c = np.searchsorted(member, key) - t_first[o_row], np.searchsorted(gated, o_row * WORD + j) - j_first[o_row]
    sizes, of = np.unique(np.stack([np.diff(t_first), np.diff(j_first)], 1), axis=0, return_inverse=True)
    names = [x.split()[0] for x in RESULT.split(", ")]
    ids = [batch[x].to_numpy() for x in names[:3]]
    parts = []
    for k, (tall, wide) in enumerate(sizes.tolist()):
        rows = np.flatnonzero(of.ravel() == k)
        if not tall:
            parts.append(pd.DataFrame(dict(zip(names, [*(x[rows] for x in ids), None, None, None, 0.0, 0], strict=True))))
            continue
        at, some = np.full(n, -1), np.isin(o_row, rows)
        at[rows] = np.arange(len(rows))
        w, w0 = np.zeros((len(rows), tall, wide)), np.zeros((len(rows), tall))
        hit = some & (j > 0)
        w[at[o_row[hit]], r[hit], c[hit]] = e[hit]
        miss = some & (j <= 0)
        w0[at[o_row[miss]], r[miss]] = e[miss]
        a = w / w0[..., None]
        mu, nu, took = messages_of_all(a, tol, most)
        p = np.concatenate([np.ones((len(rows), tall, 1)), a * nu], -1)
        p /= p.sum(-1, keepdims=True)
        z = log_z(w, w0, mu, nu)
        f, x, y = np.nonzero(np.concatenate([np.ones((len(rows), tall, 1)), w], -1) > 0)
        meas = np.zeros(len(f), int)
        meas[y > 0] = gated[j_first[rows[f[y > 0]]] + y[y > 0] - 1] % WORD
        parts.append(pd.DataFrame(dict(zip(names, [*(i[rows[f]] for i in ids), member[t_first[rows[f]] + x] % WORD, meas, p[f, x, y], z[f], took[f]], strict=True))))
    out = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=names)
    return out.astype({"track": "Int32", "meas": "Int32", "p": "Float64"})


def per_hypothesis(reward: DataFrame, merged: DataFrame, log_z: Evidence = by_bethe, tol: float = TOL, most: int = MOST) -> DataFrame:
    """RESULT: for each joint hypothesis of `merged` (frame, master, hypo, tracks) the marginals of its tracks given that it holds (meas 0
    missed), its log-evidence and iterations. A hypothesis without tracks has one row with track null. Every track needs a missed detection."""
    options = reward.groupBy("frame").agg(F.collect_list("track").alias("t"), F.collect_list("meas").alias("j"), F.collect_list("ll").alias("ll"))
    rows = merged.select("frame", "master", "hypo", "tracks").join(options, "frame", "left")

    def run(batches):
        for batch in batches:
            yield _solved(batch, log_z, tol, most)

    return rows.mapInPandas(run, RESULT)


def _mixed_size(g: dense.Group, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of what tracks have alone and of shared measurements, of a group's masters: messages are passed once for each set of
    sharing tracks that a joint hypothesis has."""
    has, lw = g.has[0], g.lp[0]
    for more, lp in zip(g.has[1:], g.lp[1:], strict=True):
        n = has.shape[1] * more.shape[1]
        has = (has[:, :, None] | more[:, None]).reshape(len(lw), n, has.shape[-1])
        lw = (lw[:, :, None] + lp[:, None]).reshape(len(lw), n)
    lw = lw + np.einsum("fht,ft->fh", has.astype(float), g.free)
    sets, of = dense.subsets(has[..., : g.sharing])
    a = np.exp(g.ll - g.free[:, : g.sharing, None])[:, None] * sets[None, :, :, None]
    mu, nu, _ = messages_of_all(a.reshape(len(a) * len(sets), *a.shape[2:]), 0.0, rounds)
    mu, an = mu.reshape(a.shape), a * nu.reshape(a.shape)
    z = np.log1p(an.sum(-1)).sum(-1) + np.log1p(mu.sum(-2)).sum(-1) - np.log1p(mu * nu.reshape(a.shape)).sum((-1, -2))
    lw = lw + np.take_along_axis(z, of, 1)
    p = np.exp(lw - lw.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    alone = np.einsum("fh,fht->ft", p, has.astype(float))
    by_set = dense.gathered(p, of, len(sets))[:, :, None] * sets / (1 + an.sum(-1))
    alone[:, : g.sharing] = by_set.sum(1)
    return alone, (by_set[..., None] * an).sum(1)


def _mixed(batch: pd.DataFrame, rounds: int) -> pd.DataFrame:
    m = dense.Masters(batch)
    alone, p = np.zeros(len(m.track)), np.zeros(len(m.j))
    for g in m.groups(np.ones(len(m.row), bool), lambda hs, tall, sharing, wide: math.prod(hs) * (tall + sharing * wide + 1)):
        alone[g.mem], hit = _mixed_size(g, rounds)
        p[g.at[g.at >= 0]] = hit[g.at >= 0]
    own = m.col < 0
    p[own] = (alone[m.o_mem] * np.exp(m.share))[own]
    there = np.exp(m.ll) > 0
    frame, n = m.row_frame[m.row[m.m_of]], len(m.track)
    mem, j, p = m.o_mem[there], m.j[there], p[there]
    kind = np.where(j == 0, "missed", "detection").astype(object)
    return table([(frame[mem], m.track[mem], kind, j, p), (frame, m.track, "nonexistence", None, 1 - np.bincount(mem, p, n))], ["frame", "track", "kind", "meas", "p"], {"frame": "int64", "track": "int32", "meas": "Int32", "p": "float64"})


def mixed(reward: DataFrame, h: DataFrame, cluster_map: DataFrame, rounds: int) -> DataFrame:
    """MARGINAL: total_probability(per_hypothesis(reward, merged(h, cluster_map), by_bethe, 0.0, rounds), ...), without a table of joint hypotheses: a master's
    stand in its frame's row. Every track needs a missed detection, and is in clusters of one master."""
    names = "frame long, track int, kind string, meas int, p double"

    def run(batches):
        for batch in batches:
            if len(batch):
                yield _mixed(batch, rounds)

    return by_frame(reward, h, cluster_map).mapInPandas(run, names)


def hypothesis_posteriors(per: DataFrame, merged: DataFrame) -> DataFrame:
    """frame, master, hypo, log_w (prior times evidence), p of each joint hypothesis."""
    w = per.groupBy("frame", "master", "hypo").agg(F.first("log_z").alias("log_z")).join(merged.select("frame", "master", "hypo", "log_prob"), ["frame", "master", "hypo"])
    own = Window.partitionBy("frame", "master")
    w = w.select("frame", "master", "hypo", (F.col("log_prob") + F.col("log_z")).alias("log_w"))
    x = F.exp(F.col("log_w") - F.max("log_w").over(own))
    return w.withColumn("p", x / F.sum(x).over(own))


def total_probability(per: DataFrame, merged: DataFrame) -> DataFrame:
    """MARGINAL by total probability: each joint hypothesis' marginals weighted by its posterior; a track doesn't exist in the others."""
    post = hypothesis_posteriors(per, merged).select("frame", "master", "hypo", F.col("p").alias("post"))
    there = per.filter("track is not null").join(post, ["frame", "master", "hypo"]).groupBy("frame", "track", "meas").agg(F.sum(F.col("p") * F.col("post")).alias("p"))
    gone = there.groupBy("frame", "track").agg((1 - F.sum("p")).alias("p"))
    there = there.select("frame", "track", F.when(F.col("meas") == 0, "missed").otherwise("detection").alias("kind"), "meas", "p")
    return there.unionByName(gone.select("frame", "track", F.lit("nonexistence").alias("kind"), F.lit(None).cast("int").alias("meas"), "p"))


def mixture_evidence(per: DataFrame, merged: DataFrame) -> DataFrame:
    """frame, log_z: the product over masters of the sum over joint hypotheses of prior times evidence."""
    w = hypothesis_posteriors(per, merged).withColumn("top", F.max("log_w").over(Window.partitionBy("frame", "master")))
    by = w.groupBy("frame", "master").agg((F.first("top") + F.ln(F.sum(F.exp(F.col("log_w") - F.col("top"))))).alias("log_z"))
    return by.groupBy("frame").agg(F.sum("log_z").alias("log_z"))
