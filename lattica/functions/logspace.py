"""Log-space aggregates and normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def log_normalized(log_weight: Column, *by: str) -> Column:
    """log_weight less the log-sum-exp of its group; NaN counts as no weight, and the largest finite value is taken out first."""
    w = Window.partitionBy(*by)
    x = F.when(F.isnan(log_weight), F.lit(float("-inf"))).otherwise(log_weight)
    top = F.max(F.when(x < float("inf"), x)).over(w)
    return x - top - F.ln(F.sum(F.exp(x - top)).over(w))


def normalized(weight: Column, *by: str) -> Column:
    return weight / F.sum(weight).over(Window.partitionBy(*by))


def logsumexp(df: DataFrame, column: str, *by: str, to: str = "lse") -> DataFrame:
    """One row for each group: the log of the sum of exponentials. The largest value is taken by a window over the partitioning that the
    sum needs, so rows are shuffled once."""
    top = df.withColumn("_top", F.max(column).over(Window.partitionBy(*by)))
    return top.groupBy(*by).agg((F.first("_top") + F.ln(F.sum(F.exp(F.col(column) - F.col("_top"))))).alias(to))
