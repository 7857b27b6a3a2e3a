"""Statistics of data sets of association problems."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exact import by_frame, by_master, frame_rows
from .hypotheses import gated, linking_measurements, merged


def scenario(reward: DataFrame, h: DataFrame, cluster_map: DataFrame) -> DataFrame:
    """A row for each frame: prior and posterior clusters, hypotheses before and after merging, linking and gated measurements."""
    clusters = cluster_map.groupBy("frame").agg(F.count("*").alias("n_prior"), F.countDistinct("master").alias("n_posterior"))
    before = h.groupBy("frame").agg(F.count("*").alias("n_hypos_prior"))
    after = merged(h, cluster_map).groupBy("frame").agg(F.count("*").alias("n_hypos_posterior"), F.avg(F.size("tracks")).alias("mean_tracks"))
    links = linking_measurements(reward, h, cluster_map).groupBy("frame").agg(F.count("*").alias("n_linking"))
    gates = gated(reward, h).groupBy("frame").agg(F.countDistinct("meas").alias("n_gated"))
    out = clusters.join(before, "frame").join(after, "frame").join(links, "frame", "left").join(gates, "frame", "left")
    return out.fillna(0, ["n_linking", "n_gated"])


def summary(s: DataFrame) -> DataFrame:
    """Ratios of sums over all frames."""
    total = lambda c: F.sum(c)
    return s.agg(
        F.count("*").alias("n_frames"), (total("n_hypos_posterior") / total("n_posterior")).alias("hypos_per_cluster"), (total("n_prior") / total("n_posterior")).alias("clusters_per_master"),
        (total(F.col("mean_tracks") * F.col("n_hypos_posterior")) / total("n_hypos_posterior")).alias("tracks_per_hypo"), total("n_linking").alias("n_linking"), F.max("n_prior").alias("most_clusters"),
    )


def competing_tracks(reward: DataFrame) -> DataFrame:
    """How many measurements are gated by how many tracks."""
    return reward.filter("meas > 0").groupBy("frame", "meas").agg(F.count("*").alias("n_tracks")).groupBy("n_tracks").agg(F.count("*").alias("n_meas"))


def competing_by_hypothesis(reward: DataFrame, m: DataFrame) -> DataFrame:
    """frame, master, hypo, meas, n_tracks: how many of a joint hypothesis' tracks gate each measurement that some of them gates."""
    own = m.select("frame", "master", "hypo", F.explode("tracks").alias("track"))
    return own.join(reward.filter("meas > 0").select("frame", "track", "meas"), ["frame", "track"]).groupBy("frame", "master", "hypo", "meas").agg(F.count("*").alias("n_tracks"))


def _competition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    out: Counter = Counter()
    for frames in frame_rows(batches):
        for _, masters, clusters, weights in frames:
            for part in by_master(masters, clusters).values():
                # of each cluster and measurement, how many hypotheses have how many tracks that gate it
                own = [[Counter(j for t in ts for j, _ in weights.get(t, ()) if j > 0) for *_, ts in hs] for _, hs in part]
                for j in {j for hs in own for x in hs for j in x}:
                    some = Counter({0: 1})
                    for hs in own:
                        each, now = Counter(x[j] for x in hs), Counter()
                        for a, n in some.items():
                            for b, m in each.items():
                                now[a + b] += n * m
                        some = now
                    out.update(some)
    yield pd.DataFrame([(v, n) for v, n in out.items() if v > 0], columns=["value", "n"])


def competition(reward: DataFrame, h: DataFrame, cluster_map: DataFrame | None = None) -> DataFrame:
    """histogram(competing_by_hypothesis(...), "n_tracks"), without a table of joint hypotheses: a measurement's counts of a master are those
    of its clusters, added in all ways."""
    return by_frame(reward, h, cluster_map).mapInPandas(_competition, "value long, n long").groupBy("value").agg(F.sum("n").alias("n"))


def superclusters(reward: DataFrame, h: DataFrame, cluster_map: DataFrame) -> DataFrame:
    """frame, master, n_clusters, n_hypos_before (sum), n_hypos_after (product), n_linking, and the least and most linking measurements of a
    cluster, of the masters that several clusters merge into."""
    per = h.groupBy("frame", "cluster").agg(F.count("*").alias("n")).join(cluster_map, ["frame", "cluster"])
    many = per.groupBy("frame", "master").agg(F.count("*").alias("n_clusters"), F.sum("n").alias("n_hypos_before"), F.product(F.col("n").cast("double")).cast("long").alias("n_hypos_after")).filter("n_clusters > 1")
    links = linking_measurements(reward, h, cluster_map)
    by_cluster = links.select("frame", "master", F.explode("clusters").alias("cluster")).groupBy("frame", "master", "cluster").agg(F.count("*").alias("n"))
    by_cluster = by_cluster.groupBy("frame", "master").agg(F.min("n").alias("least_linking"), F.max("n").alias("most_linking"))
    return many.join(links.groupBy("frame", "master").agg(F.count("*").alias("n_linking")), ["frame", "master"]).join(by_cluster, ["frame", "master"])


def histogram(df: DataFrame, column: str) -> DataFrame:
    """value, n: how often each value of a column occurs."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
