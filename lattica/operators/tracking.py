"""Stages of a tracker as tables: intensity of undetected targets, validation, pruning, estimates. One state dimension in columns x and p;
several in arrays go the same way through functions.gaussian."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import hypotheses as hy


def predicted(components: DataFrame, transition: float, process: float, survival: float, noise: float) -> DataFrame:
    """Components (frame, component, weight, x, p) after a step: weight, mean and variance predicted, and s, the variance of their measurement."""
    p = F.col("p") * transition**2 + process
    return components.withColumns({"weight": F.col("weight") * survival, "x": F.col("x") * transition, "p": p, "s": p + noise})


def validated(components: DataFrame, measurements: DataFrame, gate: float, detection: float) -> DataFrame:
    """frame, component, meas, ll of gated pairs: ln(detection) + ln(weight) + ln N(z; x, s). measurements: frame, meas, z."""
    nu = F.col("z") - F.col("x")
    hit = components.join(measurements, "frame").filter(nu * nu / F.col("s") < gate)
    return hit.select("frame", "component", "meas", (math.log(detection) + F.ln("weight") - 0.5 * nu * nu / F.col("s") - 0.5 * F.ln(2 * math.pi * F.col("s"))).alias("ll"))


def intensity_by_measurement(validation: DataFrame) -> DataFrame:
    """frame, meas, total: what all gated components together weigh for each measurement."""
    return validation.groupBy("frame", "meas").agg(F.sum(F.exp("ll")).alias("total"))


def supported(tracks: DataFrame, h: DataFrame) -> DataFrame:
    """Tracks that some hypothesis has; the others are pruned."""
    own = h.select("frame", F.explode("tracks").alias("track")).distinct()
    return tracks.join(own, ["frame", "track"], "left_semi")


def estimates(h: DataFrame, tracks: DataFrame, report: float = 0.5) -> DataFrame:
    """frame, cluster, hypo, track, exi: the tracks of existence over `report` of each cluster's likeliest hypothesis, that of largest prob times
    the product over its tracks of exi or 1 - exi, whichever is larger (ties: the least hypo)."""
    rows = hy.normalize(h).select("frame", "cluster", "hypo", "prob", F.explode_outer("tracks").alias("track")).join(tracks.select("frame", "track", "exi"), ["frame", "track"], "left")
    part = F.coalesce(F.ln(F.greatest(F.col("exi"), 1 - F.col("exi"))), F.lit(0.0))
    score = rows.groupBy("frame", "cluster", "hypo").agg((F.first(F.ln("prob")) + F.sum(part)).alias("score"))
    best = score.withColumn("k", F.row_number().over(Window.partitionBy("frame", "cluster").orderBy(F.round("score", 12).desc(), "hypo"))).filter("k = 1")
    return rows.join(best.select("frame", "cluster", "hypo"), ["frame", "cluster", "hypo"]).filter(F.col("exi") > report).select("frame", "cluster", "hypo", "track", "exi")


def recycled(tracks: DataFrame, least: float = 0.1, drop: float = 1e-5) -> tuple[DataFrame, DataFrame]:
    """Tracks that stay, and those of existence under `least` as components (frame, component, weight, x, p), if their weight is `drop` or more."""
    weak = tracks.filter(F.col("exi") < least).filter(F.col("exi") >= drop)
    return tracks.filter(F.col("exi") >= least), weak.select("frame", F.col("track").alias("component"), F.col("exi").alias("weight"), "x", "p")


def validation_likelihood(reward: DataFrame) -> DataFrame:
    """frame, track, meas, valid, likelihood: the reward table as a gate and a weight; pairs that aren't in it have neither."""
    return reward.select("frame", "track", "meas", (F.col("ll") > float("-inf")).alias("valid"), F.exp("ll").alias("likelihood"))
