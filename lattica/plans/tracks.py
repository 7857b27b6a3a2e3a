"""Queries of the multi-target tracker: targets that the users of the events table stand for, their measurements, and how far estimates are off.

Ten users are a scenario and a day is a scan. A user's target moves on a line that the user's number decides, from the day of its first event to
that of its last; the first event of a day measures it, with an error that the event's value decides, and further ones are clutter."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import kept
from ..operators.assignment import gospa_by
from ..streaming import pmbm
from .catalog import query, rounded

DAY_US, GROUP = 86_400_000_000, 10
#: Targets begin in a square of this side.
SIDE = 500.0


def model() -> pmbm.Model:
    birth = [(0.5, np.array([SIDE / 2, SIDE / 2, 0.0, 0.0]), np.diag([SIDE**2 / 4, SIDE**2 / 4, 25.0, 25.0]))]
    return pmbm.constant_velocity(birth=birth, acceleration=0.1, noise=5.0, detection=0.85, clutter=5e-5, hypotheses=50)


def _events(spark, sf_dir: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "value", us.alias("us"))
    ev = ev.select(F.floor(F.col("user_id") / GROUP).cast("long").alias("scenario"), F.floor(F.col("us") / DAY_US).cast("long").alias("scan"), "user_id", "value", "us", "event_id")
    return ev.withColumn("nth", F.row_number().over(Window.partitionBy("user_id", "scan").orderBy("us", "event_id")))


def _at(user: str, scan: str) -> list:
    """Where a user's target is."""
    u, d = F.col(user) % GROUP, F.col(scan) % 100
    start = [50.0 * u, 50.0 * ((3 * u) % GROUP)]
    speed = [((7 * u) % 5 - 2) * 3.0, ((F.lit(9) * u) % 4 - 1) * 2.0]
    return [(s + v * (d % 30)) for s, v in zip(start, speed, strict=True)]


def truth(spark, sf_dir: str) -> DataFrame:
    """scenario, scan, x of the targets there are."""
    lives = _events(spark, sf_dir).groupBy("scenario", "user_id").agg(F.min("scan").alias("a"), F.max("scan").alias("b"))
    days = lives.select("scenario", "user_id", F.explode(F.sequence("a", "b")).alias("scan"))
    return days.select("scenario", "scan", F.array(*_at("user_id", "scan")).alias("x"))


def measurements(spark, sf_dir: str) -> DataFrame:
    """scenario, scan, z."""
    cents = F.round(F.col("value") * 100).cast("long")
    error = [(cents % 9 - 4).cast("double"), (F.floor(cents / 9) % 9 - 4).cast("double")]
    target = F.array(*[a + 0.8 * e for a, e in zip(_at("user_id", "scan"), error, strict=True)])
    other = F.array((cents * 7 % int(SIDE)).cast("double"), (cents * 13 % int(SIDE)).cast("double"))
    return _events(spark, sf_dir).select("scenario", "scan", F.when(F.col("nth") == 1, target).otherwise(other).alias("z"))


@query()
def estimated_targets(spark, sf_dir):
    """The tracker's estimates after each day of each scenario."""
    out = pmbm.track(measurements(spark, sf_dir), model())
    return rounded(out.select("scenario", "scan", "track", F.col("x")[0].alias("x"), F.col("x")[1].alias("y"), "exi", "n_hypotheses", "n_components"), "x", "y", "exi")


@query()
def tracking_errors(spark, sf_dir):
    """Squared GOSPA of the estimates of each day against the table of true targets, and of all measurements taken as targets."""
    m, t = kept(measurements(spark, sf_dir)), truth(spark, sf_dir)
    est = pmbm.track(m, model()).select("scenario", "scan", F.slice("x", 1, 2).alias("x"))
    tracked = gospa_by(t, est, "scenario", "scan", c=20.0)
    raw = gospa_by(t, m.withColumnRenamed("z", "x"), "scenario", "scan", c=20.0).select("scenario", "scan", F.col("squared").alias("raw"))
    return rounded(tracked.join(raw, ["scenario", "scan"]), "squared", "localisation", "raw")
