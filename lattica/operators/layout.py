"""Forms of the reward table, its gates and components, and views of marginals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import hypotheses as hy


def square(reward: DataFrame, n_meas: DataFrame | None = None) -> DataFrame:
    """Long rows of the square layout: detections in columns 1..m, missed detections in column m + track, m being the largest
    measurement of the frame, or that of `n_meas` (frame, m)."""
    m = n_meas if n_meas is not None else reward.groupBy("frame").agg(F.max("meas").alias("m"))
    return reward.join(m, "frame").select("frame", "track", F.when(F.col("meas") > 0, F.col("meas")).otherwise(F.col("m") + F.col("track")).alias("col"), "ll")


def of_tracks(reward: DataFrame, tracks: DataFrame, drop: bool = False) -> DataFrame:
    """The rows of the listed (frame, track), or all others."""
    return reward.join(tracks.select("frame", "track"), ["frame", "track"], "left_anti" if drop else "left_semi")


def gating_tracks(reward: DataFrame, meas: DataFrame) -> DataFrame:
    """frame, meas, tracks: the tracks that gate each measurement of `meas` (frame, meas), sorted; empty where none does."""
    by = reward.filter("meas > 0").groupBy("frame", "meas").agg(F.array_sort(F.collect_list("track")).alias("tracks"))
    return meas.select("frame", "meas").join(by, ["frame", "meas"], "left").withColumn("tracks", F.coalesce("tracks", F.array().cast("array<int>")))


def components(reward: DataFrame) -> DataFrame:
    """frame, track, component: tracks that gate a common measurement, also by way of others, share the least of them."""
    alone = reward.select("frame", F.col("track").alias("cluster"), F.array("track").alias("tracks")).distinct()
    return hy.merge_map(reward, alone).select("frame", F.col("cluster").alias("track"), F.col("master").alias("component"))


def measurement_form(reward: DataFrame, forced: DataFrame | None = None, forbidden: DataFrame | None = None) -> DataFrame:
    """frame, meas, track, ll: each gated measurement's weights by track, relative to the track's missed detection, and 0 for
    track 0 (clutter). Measurements of `forced` (frame, meas) have no row for clutter; pairs of `forbidden` (frame, track, meas) none at all."""
    missed = reward.filter("meas = 0").select("frame", "track", F.col("ll").alias("missed"))
    hits = reward.filter("meas > 0")
    clutter = hits.select("frame", "meas").distinct()
    if forbidden is not None:
        hits = hits.join(forbidden.select("frame", "track", "meas"), ["frame", "track", "meas"], "left_anti")
    if forced is not None:
        clutter = clutter.join(forced.select("frame", "meas"), ["frame", "meas"], "left_anti")
    rows = hits.join(missed, ["frame", "track"]).select("frame", "meas", "track", (F.col("ll") - F.col("missed")).alias("ll"))
    return rows.unionByName(clutter.select("frame", "meas", F.lit(0).alias("track"), F.lit(0.0).alias("ll")))


def track_form(by_meas: DataFrame, reward: DataFrame) -> DataFrame:
    """frame, track, meas, p of marginals by measurement (frame, meas, track, p; track 0 is clutter): a track is missed (0) where
    no measurement has it."""
    hit = by_meas.filter("track > 0").select("frame", "track", "meas", "p")
    rest = hit.groupBy("frame", "track").agg(F.sum("p").alias("p"))
    tracks = reward.select("frame", "track").distinct()
    return hit.unionByName(tracks.join(rest, ["frame", "track"], "left").select("frame", "track", F.lit(0).alias("meas"), (1 - F.coalesce("p", F.lit(0.0))).alias("p")))


def track_evidence(by_meas_z: DataFrame, reward: DataFrame) -> DataFrame:
    """frame, z of the track form: z of the measurement form times the missed-detection weights of all tracks."""
    w0 = reward.filter("meas = 0").groupBy("frame").agg(F.sum("ll").alias("w0"))
    return by_meas_z.join(w0, "frame").select("frame", (F.col("z") * F.exp("w0")).alias("z"))


def nonexistence_removed(marginals: DataFrame) -> DataFrame:
    """Marginals given that the track exists; null where it surely doesn't."""
    own = Window.partitionBy("frame", "track")
    return marginals.filter("kind <> 'nonexistence'").withColumn("p", F.col("p") / F.nullif(F.sum("p").over(own), F.lit(0.0)))


def open_associations(n: Column, m: Column) -> Column:
    """How many ways n tracks and m measurements can be associated if every track gates every measurement."""
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] * (n - k + 1) * (m - k + 1) / k
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    return F.aggregate(F.filter(F.sequence(F.lit(0), F.least(n, m)), lambda k: k > 0), start, step, lambda acc: acc["total"])
