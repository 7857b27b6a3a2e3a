"""Gates in several dimensions: a range join of predicted and actual measurements over grids, and the reward table that follows.

A track's gate is an ellipsoid; its box in the first two dimensions touches few cells of a grid whose cells are as wide as the box. Widths are
powers of two, a grid for each that a frame's tracks have; a measurement has one cell in each of them. So tracks and measurements meet
by an equi-join on cells, whatever the tracks' spreads."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors

PAIR = "frame, track, meas, distance, ll"


def _cell(x: Column, level: Column) -> Column:
    return F.floor(x / F.pow(F.lit(2.0), level)).cast("long")


def candidates(tracks: DataFrame, meas: DataFrame, gate: float, dims: int) -> DataFrame:
    """Pairs of tracks (frame, track, x, s) and measurements (frame, meas, z) in a common cell, with the columns of both."""
    axes = min(dims, 2)
    half = [F.sqrt(gate * F.col("s")[k * dims + k]) for k in range(axes)]
    wide = F.greatest(*half) if axes > 1 else half[0]
    level = F.ceil(F.log2(F.greatest(2 * wide, F.lit(1e-300)))).cast("int")
    t = tracks.withColumn("level", level)
    for k in range(axes):
        t = t.withColumn(f"g{k}", F.explode(F.sequence(_cell(F.col("x")[k] - half[k], F.col("level")), _cell(F.col("x")[k] + half[k], F.col("level")))))
    levels = t.select("frame", "level").distinct()
    m = meas.join(levels, "frame").withColumns({f"g{k}": _cell(F.col("z")[k], F.col("level")) for k in range(axes)})
    keys = ["frame", "level", *(f"g{k}" for k in range(axes))]
    return t.join(m, keys).drop(*keys[1:])


def gated(tracks: DataFrame, meas: DataFrame, gate: float, dims: int, on_grid: bool = True) -> DataFrame:
    """frame, track, meas, distance, ll: pairs whose squared Mahalanobis distance is under the gate, and the log-density of the measurement.

    tracks: frame, track, x (array of predicted measurement), s (its covariance, rows end to end); meas: frame, meas, z. Tracks whose s isn't
    positive definite, null vectors and those with null or non-finite entries gate nothing. on_grid=False compares all pairs of a frame."""
    good = lambda c, n: F.coalesce((F.size(c) == n) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    t = tracks.select("frame", "track", F.col("x").cast("array<double>").alias("x"), F.col("s").cast("array<double>").alias("s")).filter(good("x", dims) & good("s", dims * dims))
    t = vectors.cholesky(t, "s", dims).filter(F.col(f"l{dims - 1}{dims - 1}").isNotNull())
    m = meas.select("frame", "meas", F.col("z").cast("array<double>").alias("z")).filter(good("z", dims))
    pairs = candidates(t, m, gate, dims) if on_grid else t.join(m, "frame")
    pairs = vectors.whitened(pairs, [F.col("z")[k] - F.col("x")[k] for k in range(dims)])
    near = pairs.withColumn("distance", vectors.squared(dims)).filter(F.col("distance") < gate)
    return near.select("frame", "track", "meas", "distance", vectors.log_normal(dims).alias("ll"))


def reward(tracks: DataFrame, pairs: DataFrame, detection: float, clutter: DataFrame | float) -> DataFrame:
    """REWARD of tracks with `exi`, and their gated pairs: a detection weighs exi * detection * N(z) / clutter, a missed one
    1 - exi + exi * (1 - detection). clutter: a constant, or (frame, meas, clutter) with what else may explain each measurement."""
    found = pairs.join(tracks.select("frame", "track", "exi"), ["frame", "track"])
    found = found.withColumn("clutter", F.lit(float(clutter))) if not isinstance(clutter, DataFrame) else found.join(clutter, ["frame", "meas"])
    hit = found.select("frame", "track", "meas", (F.col("ll") + math.log(detection) + F.ln("exi") - F.ln("clutter")).alias("ll"))
    missed = tracks.select("frame", "track", F.lit(0).alias("meas"), F.ln(1 - F.col("exi") + F.col("exi") * (1 - detection)).alias("ll"))
    return missed.unionByName(hit)
