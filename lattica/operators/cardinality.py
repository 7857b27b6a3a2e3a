"""How many targets there are: distributions of sums of independent existences, by convolution inside a row."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hypotheses import normalize


def bernoulli_sum(exi: Column) -> Column:
    """Distribution (from 0) of how many of independent events happen, of an array of their probabilities."""
    zero = F.array(F.lit(0.0))
    step = lambda acc, e: F.zip_with(F.concat(F.transform(acc, lambda a: a * (1 - e)), zero), F.concat(zero, F.transform(acc, lambda a: a * e)), lambda a, b: a + b)
    return F.aggregate(exi, F.array(F.lit(1.0)), step)


def convolved(distributions: Column) -> Column:
    """Distribution of the sum of independent numbers, of an array of their distributions."""
    zero = lambda n: F.transform(F.sequence(F.lit(0), n), lambda _: F.lit(0.0))

    def step(acc: Column, d: Column) -> Column:
        # a shifted copy of acc for each entry of d
        wide = F.transform(d, lambda p, k: F.concat(F.slice(zero(k), 1, k), F.transform(acc, lambda a: a * p), F.slice(zero(F.size(d)), 1, F.size(d) - 1 - k)))
        return F.aggregate(wide, F.slice(zero(F.size(acc) + F.size(d)), 1, F.size(acc) + F.size(d) - 1), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))

    return F.aggregate(distributions, F.array(F.lit(1.0)), step)


def by_cluster(h: DataFrame, tracks: DataFrame) -> DataFrame:
    """frame, cluster, distribution: the mixture over a cluster's hypotheses of how many of their tracks (frame, track, exi) exist. Tracks
    without a row there don't exist."""
    rows = normalize(h).select("frame", "cluster", "hypo", "prob", F.explode_outer("tracks").alias("track")).join(tracks.select("frame", "track", "exi"), ["frame", "track"], "left")
    per = rows.groupBy("frame", "cluster", "hypo").agg(F.first("prob").alias("prob"), bernoulli_sum(F.array_sort(F.collect_list("exi"))).alias("d"))
    entries = per.select("frame", "cluster", "prob", F.posexplode("d").alias("n", "p"))
    sums = entries.groupBy("frame", "cluster", "n").agg(F.sum(F.col("prob") * F.col("p")).alias("p"))
    return sums.groupBy("frame", "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "p"))), lambda s: s["p"]).alias("distribution"))


def by_frame(clusters: DataFrame, undetected: DataFrame | None = None, most: int = 20) -> DataFrame:
    """frame, n, p: how many targets a frame has, its clusters being independent. undetected (frame, rate): so many more by a Poisson law, whose
    numbers up to `most` are given (the rest of its mass is in none)."""
    d = clusters.groupBy("frame").agg(F.collect_list("distribution").alias("ds"))
    if undetected is not None:
        law = F.transform(F.sequence(F.lit(0), F.lit(most)), lambda k: F.exp(k * F.ln("rate") - F.col("rate") - F.element_at(F.array(*[F.lit(math.lgamma(i + 1)) for i in range(most + 1)]), k + 1)))
        law = F.when(F.col("rate") > 0, law)
        d = d.join(undetected.select("frame", "rate"), "frame", "left").withColumn("ds", F.concat("ds", F.when(law.isNotNull(), F.array(law)).otherwise(F.expr("CAST(array() AS array<array<double>>)"))))
    return d.select("frame", F.posexplode(convolved(F.col("ds"))).alias("n", "p"))


def moments(distribution: DataFrame, *by: str) -> DataFrame:
    """mean, variance and likeliest n (ties: the least) of (n, p)."""
    mean = F.sum(F.col("n") * F.col("p"))
    return distribution.groupBy(*by).agg(mean.alias("mean"), (F.sum(F.col("n") * F.col("n") * F.col("p")) - mean * mean).alias("variance"), F.max_by("n", F.struct(F.round("p", 12), -F.col("n"))).alias("likeliest"))
