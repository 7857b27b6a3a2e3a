"""Drawing from weighted rows: global prefix sums from per-partition totals, and draws placed by range, with nothing gathered in one place.

Weights are whole units, so prefix sums are exact in any order of work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import kept


def units(weight: Column, per: float = 2.0**20) -> Column:
    """A weight in whole units; null, negative ones and NaN are 0."""
    return F.when(F.isnan(weight) | (weight <= 0), 0).otherwise(F.coalesce(F.round(weight * per), F.lit(0.0))).cast("long")


def prefixed(df: DataFrame, key: str, weight: str) -> tuple[DataFrame, int]:
    """df with `begin`, the sum of the weights (long) before a row in the order of `key`, and the whole sum. Rows of one key follow in the
    order of their weights. Partitions are ranges of the key; only their totals, one row each, come together."""
    ranged = kept(df.repartitionByRange(key, weight).withColumn("_part", F.spark_partition_id()))
    number = lambda c: F.col(c).cast("decimal(38,0)")
    totals = ranged.groupBy("_part").agg(F.sum(number(weight)).alias("_total"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_total").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("decimal(38,0)"))
    whole = totals.agg(F.sum("_total")).first()[0] or 0
    own = Window.partitionBy("_part").orderBy(key, weight)
    upto = F.sum(number(weight)).over(own.rowsBetween(Window.unboundedPreceding, 0))
    # as many rows as partitions
    out = ranged.join(F.broadcast(before.select("_part", "_before")), "_part").withColumn("begin", (F.col("_before") + upto - number(weight)).cast("decimal(38,0)"))
    return out.drop("_part", "_before"), int(whole)


def systematic(df: DataFrame, key: str, weight: str, n: int, start: float = 0.5) -> DataFrame:
    """df with `count`: how often each row is drawn by n points at equal distances, the first at `start` (0 to 1) of a distance. Every count is
    within one of n * weight / sum. Rows of weight 0 are never drawn; if all are, nothing is."""
    rows, whole = prefixed(df, key, weight)
    if not whole:
        return df.withColumn("count", F.lit(0).cast("long"))
    first = int(start * whole)
    # points at (k * whole + first) / n for k = 0 .. n - 1: how many lie before a place
    upto = lambda place: F.expr(f"CAST(greatest(0, least({n}, CAST(ceil((CAST({place} AS decimal(38,0)) * {n} - {first}) / CAST({whole} AS decimal(38,0))) AS decimal(38,0)))) AS long)")
    exact = lambda place: F.expr(f"CAST(greatest(0, least({n}, (({place}) * {n} - {first} + {whole} - 1) div {whole})) AS long)")
    small = whole * n < 2**62
    count = (exact if small else upto)
    begin, end = ("CAST(begin AS long)", f"CAST(begin AS long) + `{weight}`") if small else ("begin", f"begin + `{weight}`")
    return rows.withColumn("count", count(end) - count(begin)).drop("begin")


def roulette(df: DataFrame, key: str, weight: str, n: int, seed: int) -> DataFrame:
    """df's rows as n independent draws choose them: `draw` (0 to n - 1), and the row's columns. A draw's place follows from md5 of seed and
    number. The line of weights is cut to as many equal stretches as there are partitions; rows and draws meet in a stretch, sorted, and a draw
    takes the last row that begins before it."""
    spark = df.sparkSession
    rows, whole = prefixed(df.filter(F.col(weight) > 0), key, weight)
    if not whole:
        return df.limit(0).withColumn("draw", F.lit(0).cast("long"))
    parts = min(whole, int(spark.conf.get("spark.sql.shuffle.partitions")))
    wide = -(-whole // parts)
    place = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), 1, 15), 16, 10).cast("decimal(38,0)"), F.lit(whole).cast("decimal(38,0)"))
    draws = spark.range(n).select(F.col("id").alias("draw"), place.cast("decimal(38,0)").alias("at"))
    stretch = lambda c: F.floor(c / F.lit(wide).cast("decimal(38,0)")).cast("long")
    held = F.struct(*[F.col(c) for c in df.columns])
    last = (F.col("begin") + F.col(weight) - 1).cast("decimal(38,0)")
    items = rows.select(held.alias("row"), "begin", F.explode(F.sequence(stretch(F.col("begin")), stretch(last))).alias("part"))
    items = items.select("part", F.greatest(F.col("begin"), (F.col("part") * F.lit(wide)).cast("decimal(38,0)")).alias("at"), F.lit(None).cast("long").alias("draw"), "row")
    both = items.unionByName(draws.select(stretch(F.col("at")).alias("part"), "at", "draw", F.lit(None).cast(items.schema["row"].dataType).alias("row")))
    line = Window.partitionBy("part").orderBy("at", F.col("draw").isNotNull(), "draw").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("row", F.last("row", ignorenulls=True).over(line)).filter("draw is not null").select("draw", "row.*")
