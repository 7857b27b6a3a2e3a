"""Results of merged clusters by conditioning on who owns each measurement that links them.

A cluster is solved once for each distinct set of linking measurements that it uses, not for each ownership; `Solver` says how."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial
from itertools import combinations
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import kept
from .assignment import hungarian
from .dense import solved
from .exact import by_frame, by_master, table
from .hypotheses import linking_measurements, normalize
from .shapes import grouped
from .single import clean

#: Ownerships of a master that are listed, or sets that are told apart, at most; beyond, factors.by_elimination takes the frame.
CASES = 1e6


#: A measurement and the log-weight of a track that has it (0: missed).
Options = list[tuple[int, float]]
Way = tuple[list[int], list[tuple[int, int, float]], float]


class Solver(Protocol):
    """Solves a cluster's hypothesis alone: its tracks and prior, the options of tracks, the master's shared measurements and those that the cluster
    gates, to (uses, picks, lw), the log-weights of the ways to use sets of shared measurements. Ways may be single associations or
    sums of them, exact or not: a pick (track, meas, share) says which share of its way's weight it has. Priors and weights are numbers, or arrays of
    frames of one shape, and so are shares and log-weights."""

    def __call__(self, tracks: list[int], prob: float, weights: dict[int, Options], shared: list[int], gated: list[int]) -> list[Way]: ...


def enumerated(tracks: list[int], prob: float, weights: dict[int, Options], shared: list[int], gated: list[int]) -> list[Way]:
    """The exact solver: every association, summed by the set that it uses."""
    bit: dict[int, int] = {}
    ways: list = [(0, np.log(prob), ())] if np.all(prob > 0) else []
    for t in tracks:
        own = [((t, j), bit.setdefault(j, 1 << len(bit)) if j > 0 else 0, ll) for j, ll in weights.get(t, ())]
        ways = [(taken | b, lw + ll, (*picks, pick)) for taken, lw, picks in ways for pick, b, ll in own if not taken & b]
    linking = sum(bit[j] for j in shared if j in bit)
    sets: dict[int, list] = {}
    for taken, lw, picks in ways:
        if np.any(lw > NONE):
            sets.setdefault(taken & linking, []).append((lw, picks))
    out = []
    for used, some in sets.items():
        lw, share = _log_sum([lw for lw, _ in some]), defaultdict(float)
        for own, picks in some:
            w = np.exp(own - np.where(lw > NONE, lw, 0.0))
            for pick in picks:
                share[pick] = share[pick] + w
        out.append((sorted(j for j, b in bit.items() if b & used), [(t, j, w) for (t, j), w in share.items()], lw))
    return out


def _log_sum(xs: list) -> float | np.ndarray:
    if len(xs) < 2:
        return xs[0] if xs else NONE
    if isinstance(xs[0], np.ndarray):
        return np.logaddexp.reduce(xs)
    top = max(xs)
    return top + math.log(sum(math.exp(x - top) for x in xs)) if top > NONE else NONE


#: Weight of no track for a measurement that must be used: none, but that messages stay finite.
UNUSED = 1e-12
NONE = float("-inf")
#: What Conditioned sums: kinds `all` (p is log_z), `label` (cluster a's hypothesis b) and `pick` (track a's measurement b).
SUMS = "frame long, master int, kind string, a int, b int, p double"
#: Sets of shared measurements of one hypothesis that messages are passed for at most.
SETS = 4096


def propagated(tracks: list[int], prob: float, weights: dict[int, Options], shared: list[int], gated: list[int], tol: float = 1e-12, most: int = 300) -> list[Way]:
    """The loopy solver: one way for each set of its shared measurements that a hypothesis' tracks can use all at once, weighed by
    the Bethe evidence of messages in which the set is used and the other shared measurements are left out.

    Exact where a hypothesis' tracks and measurements have no loop. More than SETS sets of a hypothesis raise; factors.by_elimination
    takes such frames. With tol 0 there are `most` rounds. A track's weights are divided by its largest, which messages don't notice."""
    return _by_sets(tracks, prob, weights, shared, tol, most, True)


def allowed(tracks: list[int], prob: float, weights: dict[int, Options], shared: list[int], gated: list[int], tol: float = 1e-12, most: int = 300) -> list[Way]:
    """The loopy solver that lets a cluster use what it owns: one way for each set of its cluster's shared measurements, weighed
    by the Bethe evidence of messages in which the others are left out and those of the set may be used.

    With Conditioned's default, each ownership takes the way of just the set that the cluster owns, so an association counts once for
    each ownership that allows it. Sets that are the same for a hypothesis' own tracks are solved once. Bounds as in `propagated`."""
    return _by_sets(tracks, prob, weights, [j for j in shared if j in gated], tol, most, False)


#: Numbers that arrays of messages have at most.
CELLS = 4_000_000


def _by_sets(tracks: list[int], prob: float, weights: dict[int, Options], links: list[int], tol: float, most: int, forced: bool) -> list[Way]:
    order = sorted(tracks)
    meas = sorted({j for t in order for j, _ in weights.get(t, ()) if j > 0})
    column = {j: i for i, j in enumerate(meas)}
    n = np.size(prob)
    top = np.array([np.max([np.broadcast_to(ll, n) for _, ll in weights[t]], axis=0) if weights.get(t) else np.full(n, NONE) for t in order]).reshape(len(order), n).T
    if np.any(np.less_equal(prob, 0)) or (top <= NONE).all(axis=0).any():
        return []
    # by frame, track and measurement
    w, w0 = np.zeros((n, len(order), len(meas))), np.zeros((n, len(order)))
    for r, t in enumerate(order):
        for j, ll in weights[t]:
            x = np.exp(ll - np.where(top[:, r] > NONE, top[:, r], 0.0))
            if j > 0:
                w[:, r, column[j]] = x
            else:
                w0[:, r] = x
    linked = np.isin(meas, links)
    sets = [j for j in meas if j in links] if forced else links
    longest = min(len(sets), len(order)) if forced else len(sets)
    if sum(math.comb(len(sets), k) for k in range(longest + 1)) > SETS:
        raise ValueError("too many sets of shared measurements")
    base = np.log(prob) + top.sum(axis=1)
    out = (lambda x: x) if isinstance(prob, np.ndarray) else (lambda x: float(x[0]))
    uses = [used for k in range(longest + 1) for used in combinations(sets, k)]
    if not order:
        return [(list(used), [], out(base)) for used in uses]
    if forced:
        able = {frozenset()}
        for t in order:
            able |= {x | {j} for x in able for j, _ in weights[t] if j in links and j not in x}
        uses = [used for used in uses if frozenset(used) in able]
    inside = {used: tuple(j for j in used if j in column) for used in uses}
    solved = list(dict.fromkeys(inside.values()))
    keep = np.array([~linked | np.isin(meas, used) for used in solved]).reshape(len(solved), 1, len(meas))
    must = keep & linked & forced
    # tracks that can't be missed need a measurement of their own as well; frames of one shape are alike in what weighs nothing
    if (w0[0] <= 0).any():
        fit = [_feasible(w[0][:, k[0]], w0[0], m[0][k[0]]) for k, m in zip(keep, must, strict=True)]
        solved, keep, must = [x for x, y in zip(solved, fit, strict=True) if y], keep[fit], must[fit]
    if not solved:
        return []
    # all sets at once: what's left out weighs nothing
    step = max(1, CELLS // max(1, keep.size * len(order)))
    some = [clean(w[k : k + step, None] * keep, w0[k : k + step, None], tol, most, np.where(must, UNUSED, 1.0)) for k in range(0, n, step)]
    p, log_z = np.concatenate([x for x, _ in some]), np.concatenate([x for _, x in some])
    columns = [0, *meas]
    known = {}
    for i, used in enumerate(solved):
        picks = [(order[r], columns[c], out(p[:, i, r, c])) for r, c in np.argwhere((p[:, i] > 0).any(axis=0)).tolist()]
        known[used] = (picks, out(base + log_z[:, i]))
    return [(list(used), *known[inside[used]]) for used in uses if inside[used] in known]


def _feasible(w: np.ndarray, w0: np.ndarray, must: np.ndarray) -> bool:
    """Whether tracks can use all measurements that must be used while those that can't be missed have one, too. Both hold at once if
    each holds by itself, as matchings of the two sides can be joined."""
    some = lambda x: hungarian(np.where(x > 0, 0.0, np.inf)) is not None
    sure = w[w0 <= 0]
    return (not must.any() or some(w[:, must].T)) and (not len(sure) or (sure.shape[0] <= sure.shape[1] and some(sure)))


def ownerships(links: DataFrame) -> DataFrame:
    """frame, master, case, owners: every way to give each linking measurement (frame, master, meas, clusters) to none (-1) or one of its clusters."""
    links = links.groupBy("frame", "master").agg(F.array_sort(F.collect_list(F.struct("meas", "clusters"))).alias("links"))
    ways = F.expr("aggregate(links, CAST(1 AS double), (a, l) -> a * (1 + size(l.clusters)))")
    links = links.withColumn("links", F.when(ways <= CASES, F.col("links")).otherwise(F.raise_error(F.lit("too many ownerships"))))
    walk = """aggregate(links, array(CAST(array() AS array<struct<meas:int,owner:int>>)),
      (acc, l) -> flatten(transform(acc, s -> transform(concat(array(-1), l.clusters), c -> array_append(s, struct(l.meas AS meas, c AS owner))))))"""
    return links.select("frame", "master", F.posexplode(F.expr(walk)).alias("case", "owners"))


def remapped(links: DataFrame) -> DataFrame:
    """links (frame, master, meas, ...) with `place`: the linking measurements of a master numbered from 1."""
    return links.withColumn("place", F.dense_rank().over(Window.partitionBy("frame", "master").orderBy("meas")))


def _disjoint(one: dict[int, float], other: dict[int, float], keep: int) -> dict[int, float]:
    """Log-weights of sets that are unions of disjoint sets of the two, of which only the bits of keep are told apart."""
    sums: dict[int, list[float]] = {}
    for a, x in one.items():
        for b, y in other.items():
            if not a & b:
                sums.setdefault((a | b) & keep, []).append(x + y)
    if len(sums) > CASES:
        raise ValueError("too many ownerships")
    return {k: _log_sum(v) for k, v in sums.items()}


def _within(mask: int) -> Iterator[int]:
    """All sets of bits of the mask."""
    part = mask
    while True:
        yield part
        if not part:
            return
        part = (part - 1) & mask


def rest_of(weights: list[dict[int, float]], gates: list[int]) -> list[dict[int, float]]:
    """For each cluster and each of its sets of shared measurements, the log-weight of what all other clusters do with the rest: the sum over all
    ways to give them disjoint sets. weights: of each cluster's sets, as bits; gates: the shared measurements that it gates.

    One pass from the first cluster on and one from the last, so that ownerships aren't listed; what neither a cluster that's passed nor
    one to come both gate is not told apart."""
    n = len(weights)
    past, future = [0] * (n + 1), [0] * (n + 1)
    for i in range(n):
        past[i + 1], future[n - 1 - i] = past[i] | gates[i], future[n - i] | gates[n - 1 - i]
    ahead, behind = [{0: 0.0}], [{0: 0.0}]
    for i in range(n - 1):
        ahead.append(_disjoint(ahead[-1], weights[i], future[i + 1]))
        behind.append(_disjoint(behind[-1], weights[n - 1 - i], past[n - 1 - i]))
    out = []
    for i in range(n):
        others = _disjoint(ahead[i], behind[n - 1 - i], gates[i])
        out.append({own: _log_sum(xs) for own in weights[i] if (xs := [x for k, x in others.items() if not k & own])})
    return out


def _sums(clusters: dict[int, list], weights: dict[int, Options], solver: Solver, forced: bool) -> list[tuple]:
    """SUMS of a master, without its keys; nothing where nothing is possible. clusters: (hypo, prob, tracks) of each."""
    gated = [{j for _, _, ts in hs for t in ts for j, _ in weights.get(t, ()) if j > 0} for hs in clusters.values()]
    times = Counter(j for own in gated for j in own)
    shared = sorted(j for j, n in times.items() if n > 1)
    bit = {j: 1 << i for i, j in enumerate(shared)}
    gates = [sum(bit[j] for j in own if j in bit) for own in gated]
    sets: list[dict[int, list[float]]] = [{} for _ in clusters]
    ways = []
    for i, (c, hs) in enumerate(clusters.items()):
        for hypo, prob, tracks in hs:
            for uses, picks, lw in solver(tracks, prob, weights, shared, sorted(gated[i])):
                used = sum(bit[j] for j in uses)
                ways.append((i, used, c, hypo, picks, lw))
                sets[i].setdefault(used, []).append(lw)
    own = [{k: _log_sum(v) for k, v in s.items()} for s in sets]
    if not forced:
        if max(g.bit_count() for g in gates) > math.log2(CASES):
            raise ValueError("too many ownerships")
        own = [{k: _log_sum(xs) for k in _within(g) if (xs := [v for u, v in s.items() if not u & ~k])} for g, s in zip(gates, own, strict=True)]
    rest = rest_of(own, gates)
    log_z = _log_sum([lw + rest[0][k] for k, lw in own[0].items() if k in rest[0]])
    if np.all(log_z == NONE):
        return []
    labels, picked, factor = defaultdict(float), defaultdict(float), {}
    for i, used, c, hypo, picks, lw in ways:
        if (i, used) not in factor:
            factor[i, used] = _log_sum([v for k, v in rest[i].items() if (k == used if forced else not used & ~k)])
        p = np.exp(lw + factor[i, used] - log_z)
        labels[c, hypo] = labels[c, hypo] + p
        for t, j, share in picks:
            picked[t, j] = picked[t, j] + p * share
    return [("all", None, None, log_z), *(("label", *k, p) for k, p in labels.items()), *(("pick", *k, p) for k, p in picked.items())]


def _by_size(batch: pd.DataFrame) -> tuple[list[tuple], pd.DataFrame]:
    """SUMS of exact conditioning of the rows whose masters are of one or two clusters (dense.solved), and the rows left. A row with an option that
    weighs nothing is left, too, as options that can't be differ there from those that hardly are."""
    x = solved(batch, True)
    m = x.of
    x.drop(np.unique(m.row[m.m_of[m.o_mem[x.option <= 0]]]))
    left = x.bad_rows()
    x.drop(left)
    own, h, o = x.good, x.good[m.of], x.good[m.m_of[m.o_mem]]
    of = m.m_of[m.o_mem[o]]
    parts = [
        (m.row_frame[m.row[own]], m.name[own], "all", None, None, x.log_z[own]),
        (m.row_frame[m.row[m.of[h]]], m.name[m.of[h]], "label", m.cluster[h], m.hypo[h], x.hypo[h]),
        (m.row_frame[m.row[of]], m.name[of], "pick", m.track[m.o_mem[o]], m.j[o], x.option[o]),
    ]
    return parts, batch.iloc[left]


def _summed(batches: Iterator[pd.DataFrame], solver: Solver, forced: bool) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        if solver is enumerated and forced and len(batch):
            out, batch = _by_size(batch)
        for x in grouped(batch):
            with np.errstate(divide="ignore", invalid="ignore"):
                for master, part in by_master(x.masters, x.clusters).items():
                    clusters = {c: [(hypo, np.exp(prior), tracks) for hypo, prior, tracks in hs] for c, hs in part}
                    sums = _sums(clusters, x.weights, solver, forced)
                    if not sums:
                        continue
                    log_z = np.broadcast_to(sums[0][-1], x.frame.shape)
                    some = log_z > NONE
                    for kind, a, b, p in sums:
                        p = np.broadcast_to(p, x.frame.shape)
                        if kind == "pick":
                            frame, meas, share, p = x.picked(a, b, some, p)
                            out.append((frame, master, kind, a, meas, p * np.exp(share)))
                        else:
                            out.append((x.frame[some], master, kind, a, b, p[some]))
        yield table(out, [c.split()[0] for c in SUMS.split(", ")], {"frame": "int64", "master": "int32", "a": "Int32", "b": "Int32", "p": "float64"})


class Conditioned:
    """Evidence, marginals and posteriors of all masters (those of one cluster, too) by summing over ownerships.

    An owner must use what it owns (`forced`, exact), or merely may (approximate: an association counts once for each ownership that
    allows it); others may not. A frame's hypotheses and weights stand in one row and its ownerships nowhere: clusters are passed one by one, with the sets
    that those before them have taken, for all frames of one shape at once. Masters with over CASES such sets raise."""

    def __init__(self, reward: DataFrame, h: DataFrame, cluster_map: DataFrame, forced: bool = True, solver: Solver = enumerated):
        cluster_map = kept(cluster_map)
        keys = ["frame", "master"]
        self.member = normalize(h).join(cluster_map.select("frame", "cluster", "master"), ["frame", "cluster"])
        self.masters = cluster_map.filter("is_master").select(keys)
        self.sums = kept(by_frame(reward, h, cluster_map).mapInPandas(partial(_summed, solver=solver, forced=forced), SUMS))
        self.z = self.sums.filter("kind = 'all'").select(*keys, F.col("p").alias("log_z"))

    def evidence(self) -> DataFrame:
        """frame, master, z, log_z; 0 and -inf where nothing is possible. z is 0 or infinite, too, where it doesn't fit."""
        rows = self.masters.join(self.z, ["frame", "master"], "left").fillna({"log_z": float("-inf")})
        return rows.select("frame", "master", F.exp("log_z").alias("z"), "log_z")

    def marginals(self) -> DataFrame:
        """MARGINAL of all tracks of hypotheses; tracks of a master where nothing is possible have p 0 of not existing."""
        picked = self.sums.filter("kind = 'pick'").groupBy("frame", F.col("a").alias("track"), F.col("b").alias("meas")).agg(F.sum("p").alias("p"))
        able = self.z.select("frame", "master", F.lit(1.0).alias("one"))
        tracks = self.member.select("frame", "master", F.explode("tracks").alias("track")).distinct().join(able, ["frame", "master"], "left")
        sums = picked.groupBy("frame", "track").agg(F.sum("p").alias("s"))
        gone = tracks.join(sums, ["frame", "track"], "left").select("frame", "track", F.lit("nonexistence").alias("kind"), F.lit(None).cast("int").alias("meas"), F.coalesce(F.col("one") - F.coalesce("s", F.lit(0.0)), F.lit(0.0)).alias("p"))
        return picked.select("frame", "track", F.when(F.col("meas") == 0, "missed").otherwise("detection").alias("kind"), "meas", "p").unionByName(gone)

    def theta(self) -> DataFrame:
        """frame, cluster, hypo, p: posteriors of prior hypotheses; 0 where nothing is possible."""
        p = self.sums.filter("kind = 'label'").select("frame", F.col("a").alias("cluster"), F.col("b").alias("hypo"), "p")
        return self.member.select("frame", "cluster", "hypo").join(p, ["frame", "cluster", "hypo"], "left").fillna({"p": 0.0})


def conditioned_evidence(reward: DataFrame, h: DataFrame, cluster_map: DataFrame, forced: bool = True) -> DataFrame:
    """frame, master, z, log_z of the masters with links; others aren't solved. See Conditioned."""
    links = linking_measurements(reward, h, cluster_map).select("frame", "master").distinct()
    linked = kept(cluster_map.join(links, ["frame", "master"], "left_semi"))
    own = h.join(linked.select("frame", "cluster"), ["frame", "cluster"], "left_semi")
    return Conditioned(reward, own, linked, forced).evidence()
