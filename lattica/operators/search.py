"""The best joint associations of a master by a search with bounds over parents and assignments.

A parent is a choice of one prior hypothesis in each cluster. What it can reach at most is its prior and the largest weight of each of its
tracks, a sum over clusters, so parents come in the order of their bounds without a list of them. One queue holds the next parents, parts
of assignment spaces under their bounds, and solved assignments; what comes first is refined, or is the next result if it's solved."""

from __future__ import annotations

import heapq
import math
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import dealt
from .assignment import NONE, first_matching, parts_without, solved_part
from .exact import options
from .hypotheses import merge_map, normalize

RESULT = "frame long, master int, rank int, labels array<struct<cluster:int,hypo:int>>, picks array<struct<track:int,meas:int>>, ll double, solved int, parents int"

Hypothesis = tuple[int, int, list[int], float]
#: Joint associations, bounded from above by the options of tracks, that listed_joint lists at most.
LISTED = 1000


def _matrix(tracks: list[int], weights: dict[int, dict[int, float]]) -> tuple[np.ndarray, list[int]]:
    """Rewards with measurements and then each track's missed detection as rows, and the measurements."""
    meas = sorted({j for t in tracks for j in weights.get(t, {}) if j > 0})
    row = {j: i for i, j in enumerate(meas)}
    out = np.full((len(meas) + len(tracks), len(tracks)), NONE)
    for c, t in enumerate(tracks):
        for j, ll in weights.get(t, {}).items():
            out[row[j] if j > 0 else len(meas) + c, c] = ll
    return out, meas


def best_joint(clusters: list[list[Hypothesis]], weights: dict[int, dict[int, float]], k: int) -> tuple[list[tuple[list, list, float]], int, int]:
    """The k best (labels, picks, ll) in descending order, how many assignment problems were solved, and how many parents were opened.
    clusters: hypotheses (cluster, hypo, tracks, log-prior); weights: of each track by measurement (0 missed)."""
    reach = lambda h: h[3] + sum(max(weights.get(t, {}).values(), default=NONE) for t in h[2])
    ranked = [sorted(((reach(h), h) for h in hs), key=lambda x: (-x[0], x[1][1])) for hs in clusters]
    if not all(ranked):
        return [], 0, 0
    bound = lambda at: sum(hs[i][0] for hs, i in zip(ranked, at, strict=True))
    tie, out, solved, opened = count(), [], 0, 0
    start = (0,) * len(ranked)
    heap: list = [(-bound(start), next(tie), "parent", (start, 0), None)]
    while heap and len(out) < k:
        cost, _, kind, x, parent = heapq.heappop(heap)
        if cost == np.inf:
            break
        if kind == "parent":
            at, last = x
            # each choice follows from one other: the last place that isn't first choice goes one back
            for p in range(last, len(at)):
                if at[p] + 1 < len(ranked[p]):
                    after = at[:p] + (at[p] + 1,) + at[p + 1 :]
                    heapq.heappush(heap, (-bound(after), next(tie), "parent", (after, p), None))
            chosen = [hs[i][1] for hs, i in zip(ranked, at, strict=True)]
            tracks = sorted(t for h in chosen for t in h[2])
            matrix, meas = _matrix(tracks, weights)
            parent, opened, solved = (chosen, tracks, matrix, meas, sum(h[3] for h in chosen)), opened + 1, solved + 1
            found = first_matching(matrix) if tracks else (0.0, np.zeros(0, int), np.zeros((0, 0)), 0)
        elif kind == "part":
            found, solved = solved_part(parent[2], x), solved + 1
        else:
            chosen, tracks, matrix, meas, prior = parent
            picks = [(t, meas[r] if r < len(meas) else 0) for t, r in zip(tracks, x[1].tolist(), strict=False)]
            out.append(([(c, h) for c, h, _, _ in chosen], picks, prior + x[0]))
            for part in parts_without(x, len(tracks)) if tracks else []:
                heapq.heappush(heap, (-(prior + part[0]), next(tie), "part", part, parent))
            continue
        if found is not None and found[0] > NONE:
            heapq.heappush(heap, (-(parent[4] + found[0]), next(tie), "found", found, parent))
    return out, solved, opened


def listed_joint(clusters: list[list[Hypothesis]], weights: dict[int, dict[int, float]], k: int, most: int = LISTED) -> list[tuple[list, list, float]] | None:
    """The associations of best_joint from a list of all; none if there may be over `most`."""
    if math.prod(sum(math.prod(len(weights.get(t, ())) for t in ts) for _, _, ts, _ in hs) for hs in clusters) > most:
        return None
    ways: list = [((), (), 0, 0.0)]
    for hs in clusters:
        own = []
        for c, h, tracks, prior in hs:
            some: list = [((), 0, prior)]
            for t in tracks:
                some = [((*picks, (t, j)), used | 1 << j if j else used, lw + ll) for picks, used, lw in some for j, ll in weights.get(t, {}).items() if not j or not used >> j & 1]
            own += [((c, h), *x) for x in some if x[2] > NONE]
        ways = [((*labels, label), picks + more, used | new, lw + ll) for labels, picks, used, lw in ways for label, more, new, ll in own if not used & new]
    ways.sort(key=lambda x: -x[3])
    return [(list(labels), sorted(picks), lw) for labels, picks, _, lw in ways[:k]]


def best_associations(reward: DataFrame, h: DataFrame, k: int = 150, cluster_map: DataFrame | None = None, births: DataFrame | None = None) -> DataFrame:
    """RESULT: the k best joint associations of each master by their log-weight, with the assignment problems solved and parents opened for
    the whole master. Equal weights come in any order. Masters without a possible association have no row.

    births (frame, meas, ll): what a measurement weighs that no track takes, as one that starts a track; without them, nothing.
    A master's hypotheses and weights stand in one row, its joint hypotheses and associations nowhere."""
    cluster_map = merge_map(reward, h) if cluster_map is None else cluster_map
    one = normalize(h).join(cluster_map.select("frame", "cluster", "master"), ["frame", "cluster"]).groupBy("frame", "master").agg(F.collect_list(F.struct("cluster", "hypo", "tracks", "prob")).alias("hs"))
    rows = one.join(options(reward), "frame", "left")
    if births is None:
        rows = rows.withColumn("born", F.expr("CAST(null AS map<int,double>)"))
    else:
        rows = rows.join(births.groupBy("frame").agg(F.map_from_entries(F.collect_list(F.struct("meas", "ll"))).alias("born")), "frame", "left")

    def run(batches):
        for batch in batches:
            out = []
            for frame, master, hs, os, born in zip(*(batch[c] for c in ("frame", "master", "hs", "options", "born")), strict=True):
                clusters: dict[int, list[Hypothesis]] = {}
                for x in hs:
                    if x["prob"] > 0:
                        clusters.setdefault(x["cluster"], []).append((x["cluster"], x["hypo"], [int(t) for t in x["tracks"]], float(np.log(x["prob"]))))
                for c in {x["cluster"] for x in hs}:
                    clusters.setdefault(c, [])
                own = {t for x in hs for t in x["tracks"]}
                weights = {t: {o["meas"]: o["ll"] for o in w} for t, w in dict(os or {}).items() if t in own}
                born = dict(born or {})
                # a measurement starts a track unless one takes it: all do, and who takes one pays for that
                gated = {j for w in weights.values() for j in w if j > 0}
                base = sum(born.get(j, 0.0) for j in gated)
                weights = {t: {j: ll - (born.get(j, 0.0) if j > 0 else 0.0) for j, ll in w.items()} for t, w in weights.items()}
                found, solved, opened = best_joint([clusters[c] for c in sorted(clusters)], weights, k)
                out += [(frame, master, i + 1, [{"cluster": c, "hypo": x} for c, x in labels], [{"track": t, "meas": j} for t, j in picks], base + ll, solved, opened) for i, (labels, picks, ll) in enumerate(found)]
            yield pd.DataFrame(out, columns=["frame", "master", "rank", "labels", "picks", "ll", "solved", "parents"])

    return dealt(rows.select("frame", "master", "hs", "options", "born"), "frame", "master").mapInPandas(run, RESULT)


def truncated(best: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of best associations: (frame, master, log_z) of what they hold, and (frame, track, meas, p) of their tracks with hypotheses in mind: what
    p lacks to 1 is not existing."""
    top = best.groupBy("frame", "master").agg(F.max("ll").alias("top"))
    w = best.join(top, ["frame", "master"]).withColumn("w", F.exp(F.col("ll") - F.col("top")))
    z = w.groupBy("frame", "master").agg((F.first("top") + F.ln(F.sum("w"))).alias("log_z"))
    picks = w.join(z, ["frame", "master"]).select("frame", F.explode("picks").alias("x"), F.exp(F.col("ll") - F.col("log_z")).alias("p"))
    return z, picks.groupBy("frame", F.col("x.track").alias("track"), F.col("x.meas").alias("meas")).agg(F.sum("p").alias("p"))
