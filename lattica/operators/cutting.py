"""Keeping superclusters small: edges of the cluster-measurement graph that are weak and lie between clusters are cut, then the links that
cost least, until no supercluster is too large. Frames are independent; a frame's graph stands in one row."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Hashable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import dealt

#: How much less likely than a missed detection an edge is that may go.
WEAKER = math.log(500)
#: Clusters of a supercluster, and what its largest cardinalities and its counts of hypotheses may exceed the largest cluster's by.
CLUSTERS, CARDINALITY, COUNT = 5, 5, 100
#: What the likelihood of the worst edge counts against a cut.
EDGE = 0.75

Edge = tuple[int, int, float, bool]


def betweenness(near: dict[Hashable, list[Hashable]]) -> dict[Hashable, float]:
    """How many shortest paths between other nodes pass each node (several between the same two share one), each pair once: one
    breadth-first search from each node, and its paths summed backwards."""
    out = dict.fromkeys(near, 0.0)
    for s in near:
        order, before, paths, far = [], {v: [] for v in near}, dict.fromkeys(near, 0), {s: 0}
        paths[s] = 1
        todo = deque([s])
        while todo:
            v = todo.popleft()
            order.append(v)
            for w in near[v]:
                if w not in far:
                    far[w] = far[v] + 1
                    todo.append(w)
                if far[w] == far[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        rest = dict.fromkeys(near, 0.0)
        for w in reversed(order):
            for v in before[w]:
                rest[v] += paths[v] / paths[w] * (1 + rest[w])
            if w != s:
                out[w] += rest[w] / 2
    return out


def edges(reward: DataFrame, h: DataFrame, weaker: float = WEAKER) -> DataFrame:
    """frame, cluster, meas, ll, weak: the best weight of a cluster's tracks for a measurement, and whether it's `weaker` than a missed
    detection of its track, for all that track's gates. A track without a missed detection has no weak edge."""
    member = h.select("frame", "cluster", F.explode("tracks").alias("track")).distinct()
    missed = reward.filter("meas = 0").select("frame", "track", F.col("ll").alias("missed"))
    rows = reward.filter("meas > 0").join(member, ["frame", "track"]).join(missed, ["frame", "track"], "left")
    weak = F.coalesce(F.col("ll") < F.col("missed") - weaker, F.lit(False))
    return rows.groupBy("frame", "cluster", "meas").agg(F.max("ll").alias("ll"), F.min(weak).alias("weak"))


def _graph(rows: list[Edge]) -> dict[Hashable, list[Hashable]]:
    near: dict[Hashable, list[Hashable]] = {}
    for c, j, *_ in rows:
        near.setdefault(("cluster", c), []).append(("meas", j))
        near.setdefault(("meas", j), []).append(("cluster", c))
    return near


def _by_frame(e: DataFrame, solve, result: str, sizes: DataFrame | None = None) -> DataFrame:
    one = e.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("cluster", "meas", "ll", "weak"))).alias("e"))
    one = one.withColumn("sizes", F.lit(0)) if sizes is None else one.join(sizes, "frame", "left")
    names = [x.split()[0] for x in result.split(", ")]

    def run(batches):
        for batch in batches:
            out = []
            for frame, rows, size in zip(batch["frame"], batch["e"], batch["sizes"], strict=True):
                out += [(frame, *x) for x in solve([(r["cluster"], r["meas"], r["ll"], bool(r["weak"])) for r in rows], size)]
            yield pd.DataFrame(out, columns=names)

    return dealt(one, "frame").mapInPandas(run, result)


def node_betweenness(reward: DataFrame, h: DataFrame) -> DataFrame:
    """frame, kind (cluster or meas), key, centrality of the cluster-measurement graph; clusters that gate nothing aren't in it."""

    def solve(rows, _):
        return [(kind, key, x) for (kind, key), x in betweenness(_graph(rows)).items()]

    return _by_frame(edges(reward, h), solve, "frame long, kind string, key int, centrality double")


def weak_cuts(rows: list[Edge]) -> set[tuple[int, int]]:
    """Weak edges at measurements that lie between clusters, but for the best edge of a measurement that would lose all."""
    between = betweenness(_graph(rows))
    out: set[tuple[int, int]] = set()
    for j in {j for _, j, *_ in rows}:
        own = [r for r in rows if r[1] == j]
        gone = [r for r in own if r[3] and between["meas", j] > 0]
        if len(gone) == len(own):
            gone.remove(max(gone, key=lambda r: (r[2], -r[0])))
        out.update((c, j) for c, j, *_ in gone)
    return out


def _components(rows: list[Edge]) -> dict[int, int]:
    """The least cluster that each cluster is connected with."""
    near, out = _graph(rows), {}
    for c in sorted({r[0] for r in rows}):
        if c in out:
            continue
        todo, seen = [("cluster", c)], {("cluster", c)}
        while todo:
            v = todo.pop()
            if v[0] == "cluster":
                out[v[1]] = c
            for w in near[v]:
                if w not in seen:
                    seen.add(w)
                    todo.append(w)
    return out


def small_cuts(rows: list[Edge], cardinality: dict[int, int], count: dict[int, int], clusters: int = CLUSTERS, more_cardinality: int = CARDINALITY, more_count: int = COUNT) -> set[tuple[int, int]]:
    """Edges to cut until no supercluster of several clusters has more than `clusters`, or largest cardinalities or counts of hypotheses
    that sum to over the largest cluster's and what may be more. Of the linked pairs of clusters in superclusters that are too large, the one goes
    next of largest size / `clusters` + cardinalities / most + counts / most - EDGE * ll of its worst edge; each measurement that two share
    stays with the one that it fits better (ties: the latter), the other's edge is cut."""
    left = {(c, j): ll for c, j, ll, _ in rows}
    most_card, most_count = max(cardinality.values(), default=0) + more_cardinality, max(count.values(), default=0) + more_count
    out: set[tuple[int, int]] = set()
    while True:
        own = _components([(c, j, ll, False) for (c, j), ll in left.items()])
        groups: dict[int, list[int]] = {}
        for c, m in own.items():
            groups.setdefault(m, []).append(c)
        large = {m for m, cs in groups.items() if len(cs) > 1 and (len(cs) > clusters or sum(cardinality.get(c, 0) for c in cs) > most_card or sum(count.get(c, 0) for c in cs) > most_count)}
        if not large:
            return out
        by_meas: dict[int, list[int]] = {}
        for c, j in left:
            if own[c] in large:
                by_meas.setdefault(j, []).append(c)
        worst: dict[tuple[int, int], float] = {}
        for j, cs in by_meas.items():
            for a in cs:
                for b in cs:
                    if a < b:
                        worst[a, b] = max(worst.get((a, b), -math.inf), min(left[a, j], left[b, j]))

        def gain(pair, worst=worst, own=own, groups=groups):
            a, b = pair
            return len(groups[own[a]]) / clusters + (cardinality.get(a, 0) + cardinality.get(b, 0)) / most_card + (count.get(a, 0) + count.get(b, 0)) / most_count - EDGE * worst[pair]

        a, b = max(sorted(worst), key=gain)
        for j, cs in by_meas.items():
            if a in cs and b in cs:
                loser = b if left[a, j] > left[b, j] else a
                out.add((loser, j))
                del left[loser, j]


def cut_edges(reward: DataFrame, h: DataFrame, weaker: float = WEAKER, clusters: int = CLUSTERS, more_cardinality: int = CARDINALITY, more_count: int = COUNT) -> DataFrame:
    """frame, cluster, meas, reason (weak or size) of the edges that are cut."""
    per = h.groupBy("frame", "cluster").agg(F.max(F.size("tracks")).alias("cardinality"), F.count("*").cast("int").alias("count"))
    sizes = per.groupBy("frame").agg(F.collect_list(F.struct("cluster", "cardinality", "count")).alias("sizes"))

    def solve(rows, size):
        weak = weak_cuts(rows)
        rest = [r for r in rows if (r[0], r[1]) not in weak]
        card, count = ({x["cluster"]: x[k] for x in size} for k in ("cardinality", "count"))
        return [(*x, "weak") for x in sorted(weak)] + [(*x, "size") for x in sorted(small_cuts(rest, card, count, clusters, more_cardinality, more_count))]

    return _by_frame(edges(reward, h, weaker), solve, "frame long, cluster int, meas int, reason string", sizes)


def without(reward: DataFrame, h: DataFrame, cuts: DataFrame) -> DataFrame:
    """REWARD without the weights of a cut edge's tracks for its measurement."""
    member = h.select("frame", "cluster", F.explode("tracks").alias("track")).distinct()
    gone = cuts.join(member, ["frame", "cluster"]).select("frame", "track", "meas").distinct()
    return reward.join(gone, ["frame", "track", "meas"], "left_anti")
