"""Batch analytics over exact and approximate results: convergence, iterations, correlation, predicates and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def convergence(iterations: DataFrame, most: int) -> DataFrame:
    """iterations (frame, iterations, bethe_iterations, message_iterations) with `converged`: both criteria were met within `most`."""
    met = (F.col("bethe_iterations") > 0) & (F.col("message_iterations") > 0) & (F.col("iterations") <= most)
    return iterations.withColumn("converged", met)


def split_by_convergence(results: DataFrame, marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the frames that converged, and of those that didn't."""
    rows = results.join(marked.select("frame", "converged"), "frame")
    return rows.filter("converged").drop("converged"), rows.filter("NOT converged").drop("converged")


def iterations_by_cardinality(marked: DataFrame, h: DataFrame) -> DataFrame:
    """cardinality (prior hypotheses of a frame), mean_iterations of converged frames, n, n_diverged."""
    card = h.groupBy("frame").agg(F.count("*").alias("cardinality"))
    return marked.join(card, "frame").groupBy("cardinality").agg(F.avg(F.when(F.col("converged"), F.col("iterations"))).alias("mean_iterations"), F.count("*").alias("n"), F.sum((~F.col("converged")).cast("long")).alias("n_diverged"))


def convergence_summary(marked: DataFrame) -> DataFrame:
    """A row for converged and diverged frames each: n, mean and largest iterations."""
    return marked.groupBy("converged").agg(F.count("*").alias("n"), F.avg("iterations").alias("mean_iterations"), F.max("iterations").alias("most_iterations"))


def iteration_comparison(joint: DataFrame, per: DataFrame) -> DataFrame:
    """frame, iterations (of the joint graph), iterations_by_hypothesis (summed over joint hypotheses, each run alone)."""
    one = per.groupBy("frame", "master", "hypo").agg(F.first("iterations").alias("k")).groupBy("frame").agg(F.sum("k").alias("iterations_by_hypothesis"))
    return joint.select("frame", "iterations").join(one, "frame")


def survival(err: DataFrame, decimals: int, *by: str) -> DataFrame:
    """Share of absolute errors at or above each value for each value of `by` (kind, convergence): counts on a grid first."""
    from pyspark.sql import Window

    counts = err.groupBy(*by, F.round(F.abs("error"), decimals).alias("x")).agg(F.count("*").alias("n"))
    own = Window.partitionBy(*by)
    above = own.orderBy(F.col("x").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return counts.select(*by, "x", (F.sum("n").over(above) / F.sum("n").over(own)).alias("share"))


def theta_errors(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """frame, cluster, hypo, exact, approx, error of hypothesis posteriors."""
    keys = ["frame", "cluster", "hypo"]
    both = exact.select(*keys, F.col("p").alias("exact")).join(approximate.select(*keys, F.col("p").alias("approx")), keys, "full").fillna(0.0, ["exact", "approx"])
    return both.withColumn("error", F.col("exact") - F.col("approx"))


def correlation(pairs: DataFrame, *by: str) -> DataFrame:
    """n, correlation, slope and intercept of approx over exact; null where exact doesn't vary."""
    return pairs.groupBy(*by).agg(F.count("*").alias("n"), F.corr("exact", "approx").alias("correlation"), F.regr_slope("approx", "exact").alias("slope"), F.regr_intercept("approx", "exact").alias("intercept"))


def largest_by_frame(err: DataFrame) -> DataFrame:
    return err.groupBy("frame").agg(F.max(F.abs("error")).alias("largest"))


def divergence_comparison(err: DataFrame, marked: DataFrame) -> DataFrame:
    """For converged and diverged frames: mean, population deviation and maximum of the frames' largest errors."""
    return largest_by_frame(err).join(marked.select("frame", "converged"), "frame").groupBy("converged").agg(F.count("*").alias("n"), F.avg("largest").alias("mean"), F.stddev_pop("largest").alias("sd"), F.max("largest").alias("top"))


def scatter_table(err: DataFrame, reward: DataFrame, h: DataFrame) -> DataFrame:
    """frame, largest error, and what may explain it: tracks, hypotheses, gated measurements, most tracks that compete for one."""
    gates = reward.filter("meas > 0").groupBy("frame", "meas").agg(F.count("*").alias("c")).groupBy("frame").agg(F.count("*").alias("n_gated"), F.max("c").alias("most_competing"))
    tracks = reward.groupBy("frame").agg(F.countDistinct("track").alias("n_tracks"))
    hypos = h.groupBy("frame").agg(F.count("*").alias("n_hypos"))
    return largest_by_frame(err).join(tracks, "frame").join(hypos, "frame").join(gates, "frame", "left").fillna(0, ["n_gated", "most_competing"])


def scatter_matrix(table: DataFrame, *columns: str) -> DataFrame:
    """x, y, correlation of each two columns of a table, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = table.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in pairs])
    each = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"{a}|{b}").alias("correlation")) for a, b in pairs])
    return row.select(F.explode(each).alias("s")).select("s.*")


def evidence_scatter(z: DataFrame) -> DataFrame:
    """frame, log_exact, log_approx of (frame, exact, approx); frames without evidence are left out."""
    return z.filter("exact > 0 AND approx > 0").select("frame", F.ln("exact").alias("log_exact"), F.ln("approx").alias("log_approx"))


#: What counts as a large error of a marginal, a large error of the log-evidence, and a very right overestimate in percent.
LARGE_ERROR, LARGE_LOG, RIGHT_PERCENT = 0.4, 2.0, 1.0


def notable(err: DataFrame, z: DataFrame, large: float = LARGE_ERROR, log: float = LARGE_LOG, percent: float = RIGHT_PERCENT) -> DataFrame:
    """frame, large_error, larger_bethe, large_evidence_error, very_right: the predicates by which frames are picked for a closer look."""
    ratio = F.ln(F.col("approx") / F.col("exact"))
    p = (F.col("approx") - F.col("exact")) / F.col("exact") * 100
    rows = largest_by_frame(err).join(z.select("frame", "exact", "approx"), "frame")
    return rows.select("frame", (F.col("largest") >= large).alias("large_error"), (F.col("approx") > F.col("exact")).alias("larger_bethe"), (F.abs(ratio) > log).alias("large_evidence_error"), ((F.col("approx") < F.col("exact")) & (F.abs(p) < percent)).alias("very_right"))


def sampled(df: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """n rows (the feature is a sample) by a seeded hash of their key: the same rows whatever their partitions."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key])), *key).limit(n)


def heat_pivot(cells: DataFrame, bins: int) -> DataFrame:
    """Cells (row, col, n) as a row for each `row` with `bins` columns c0, c1, ...; cells without rows are 0."""
    wide = cells.groupBy("row").pivot("col", list(range(bins))).agg(F.sum("n")).fillna(0)
    return wide.select("row", *[F.col(str(k)).alias(f"c{k}") for k in range(bins)])


def histogram_map(df: DataFrame, column: str) -> DataFrame:
    """One row: the counts of a column's values as a map."""
    return df.groupBy(F.col(column).alias("k")).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("counts"))


def recycling_weights(loopy: DataFrame, truncated: DataFrame, z: DataFrame) -> DataFrame:
    """frame, track, meas, weight: (loopy - truncated) * Z / (Z - Z_k) of marginals, what the associations beyond the k best weigh. z: frame, whole,
    best; weights are null where nothing is beyond."""
    keys = ["frame", "track", "meas"]
    both = loopy.select(*keys, F.col("p").alias("l")).join(truncated.select(*keys, F.col("p").alias("t")), keys, "full").fillna(0.0, ["l", "t"]).join(z, "frame")
    rest = F.when(F.col("whole") > F.col("best") * (1 + 1e-9), F.col("whole") - F.col("best"))
    return both.select(*keys, (F.col("whole") / rest * (F.col("l") - F.col("t"))).alias("weight"))
