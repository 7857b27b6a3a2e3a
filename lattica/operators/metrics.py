"""Errors of approximate results against exact ones, and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def errors(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """exact - approximate of each marginal; a side without a row counts as 0."""
    e, a = exact.select("frame", "track", "kind", F.coalesce("meas", F.lit(-1)).alias("meas"), F.col("p").alias("exact")), approximate.select("frame", "track", "kind", F.coalesce("meas", F.lit(-1)).alias("meas"), F.col("p").alias("approx"))
    both = e.join(a, ["frame", "track", "kind", "meas"], "full").fillna(0.0, ["exact", "approx"])
    return both.withColumn("error", F.col("exact") - F.col("approx"))


def by_kind(err: DataFrame) -> DataFrame:
    """Mean, population deviation and largest absolute error of each kind, and (kind null) of all."""
    return err.rollup("kind").agg(F.avg(F.abs("error")).alias("mean"), F.stddev_pop("error").alias("sd"), F.max(F.abs("error")).alias("largest"), F.count("*").alias("n"))


def largest_per_track(err: DataFrame) -> DataFrame:
    return err.groupBy("frame", "track").agg(F.max(F.abs("error")).alias("largest"))


def survival(err: DataFrame, decimals: int = 3) -> DataFrame:
    """Share of absolute errors at or above each value, over values rounded to `decimals`: counts first, so the window is small."""
    counts = err.groupBy(F.round(F.abs("error"), decimals).alias("x")).agg(F.count("*").alias("n"))
    above = Window.orderBy(F.col("x").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return counts.select("x", (F.sum("n").over(above) / F.sum("n").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("share"))


def histogram(err: DataFrame, bins: int = 100, low: float = -1.0, high: float = 1.0, column: str = "error") -> DataFrame:
    place = F.least(F.lit(bins - 1), F.floor((F.col(column) - low) / (high - low) * bins)).cast("int")
    return err.groupBy(place.alias("bin")).agg(F.count("*").alias("n"))


def heatmap(err: DataFrame, bins: int = 199) -> DataFrame:
    cell = lambda c: F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.round(F.col(c), 9) * bins))).cast("int")
    return err.groupBy(cell("exact").alias("row"), cell("approx").alias("col")).agg(F.count("*").alias("n"))


def relative(z: DataFrame) -> DataFrame:
    """Of exact and approx evidence: (exact - approx) / exact, and the percent error of opposite sign."""
    return z.withColumn("relative", (F.col("exact") - F.col("approx")) / F.col("exact")).withColumn("percent", (F.col("approx") - F.col("exact")) / F.col("exact") * 100)


def box(df: DataFrame, column: str) -> DataFrame:
    """Quartiles, whiskers (the last values within 1.5 quartile ranges) and the number outside."""
    q = df.agg(*[F.percentile(column, F.lit(x)).alias(n) for n, x in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))])
    x, low, high = F.col(column), F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    rows = df.select(column).join(F.broadcast(q))  # one row
    return rows.groupBy("q1", "median", "q3").agg(F.min(F.when(x >= low, x)).alias("low"), F.max(F.when(x <= high, x)).alias("high"), F.sum(F.when((x < low) | (x > high), 1).otherwise(0)).alias("outside"))


def overestimated(z: DataFrame) -> DataFrame:
    return z.agg(F.sum((F.col("approx") > F.col("exact")).cast("long")).alias("n_over"), F.count("*").alias("n"), (100 * F.avg((F.col("approx") > F.col("exact")).cast("double"))).alias("percent_over"))


def rank_profile(h: DataFrame, by: tuple[str, ...] = ("frame", "cluster")) -> DataFrame:
    """Mean and population deviation of the r-th largest probability over all distributions; a shorter one has 0 there."""
    ranked = h.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("prob").desc(), "hypo")))
    n = h.select(*by).distinct().agg(F.count("*").alias("n"))
    sums = ranked.groupBy("rank").agg(F.sum("prob").alias("s"), F.sum(F.col("prob") * F.col("prob")).alias("q")).join(F.broadcast(n))
    return sums.select("rank", (F.col("s") / F.col("n")).alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - (F.col("s") / F.col("n")) ** 2)).alias("sd"))


def thinned(df: DataFrame, column: str, gap: float) -> DataFrame:
    """Values in ascending order, each more than `gap` above the last that was kept. Distinct values on a grid of a tenth of the gap
    are gathered first, so what is folded is bounded by the range, not the rows."""
    grid = df.select(F.round(F.col(column) / (gap / 10)).alias("g")).distinct().agg(F.array_sort(F.collect_list("g")).alias("gs"))
    fold = "aggregate(gs, CAST(array() AS array<double>), (a, x) -> CASE WHEN size(a) = 0 OR x - element_at(a, -1) > 10 THEN array_append(a, x) ELSE a END)"
    return grid.select(F.explode(F.expr(fold)).alias("g")).select((F.col("g") * (gap / 10)).alias(column))


def by_method(exact: DataFrame, methods: dict[str, DataFrame]) -> DataFrame:
    """method, kind, mean and largest absolute error, n, of several methods' MARGINAL tables against the exact one. A row that one side lacks is 0
    there. Each method is one join; they're summed before they come together."""
    out = None
    for name, p in methods.items():
        one = errors(exact, p).groupBy("kind").agg(F.avg(F.abs("error")).alias("mean"), F.max(F.abs("error")).alias("largest"), F.count("*").alias("n"))
        one = one.select(F.lit(name).alias("method"), "kind", "mean", "largest", "n")
        out = one if out is None else out.unionByName(one)
    return out
