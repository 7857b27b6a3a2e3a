"""Sources and sinks: problem tables, results, matrices in text, lists of paths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import ragged
from ..operators.resampling import prefixed


def write_problem(path: str, reward: DataFrame, h: DataFrame, cluster_map: DataFrame) -> None:
    for name, df in (("reward", reward), ("hypothesis", h), ("cluster_map", cluster_map)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_problem(spark: SparkSession, path: str, expected_frames: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables by their schemas; raises if there aren't as many frames as expected."""
    reward, h, cluster_map = (spark.read.schema(s).parquet(f"{path}/{n}") for n, s in (("reward", schema.REWARD), ("hypothesis", schema.HYPOTHESIS), ("cluster_map", schema.CLUSTER_MAP)))
    if expected_frames is not None and (n := reward.select("frame").distinct().count()) != expected_frames:
        raise ValueError(f"{n} frames, not {expected_frames}")
    return reward, h, cluster_map


def write_results(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def read_results(spark: SparkSession, path: str, skip_corrupt: bool = False, start: int | None = None, stop: int | None = None) -> DataFrame:
    """Results of the frames from `start` to before `stop` (null: no bound). Files that can't be read raise, unless they're to be passed
    over; missing_frames tells what that lost."""
    rows = spark.read.option("ignoreCorruptFiles", str(skip_corrupt).lower()).parquet(path)
    return rows.filter((F.lit(start is None) | (F.col("frame") >= (start or 0))) & (F.lit(stop is None) | (F.col("frame") < (stop or 0))))


def missing_frames(expected: DataFrame, results: DataFrame) -> DataFrame:
    """Frames of `expected` without a row in the results."""
    return expected.select("frame").distinct().join(results.select("frame").distinct(), "frame", "left_anti")


def read_murty(spark: SparkSession, path: str, tolerance: float = 1e-6) -> DataFrame:
    """frame, track, meas, p, log_z of truncated results; raises on a row without evidence and on marginals of a track that don't sum to 1."""
    rows = spark.read.schema("frame long, track int, meas int, p double, log_z double").parquet(path)
    total = F.sum("p").over(Window.partitionBy("frame", "track"))
    good = F.col("log_z").isNotNull() & ~F.isnan("log_z") & (F.col("log_z") > float("-inf")) & (F.abs(total - 1) <= tolerance)
    return rows.withColumn("p", F.when(good, F.col("p")).otherwise(F.raise_error(F.lit("a truncated result isn't whole"))))


#: Doubles of a block of a raw column.
BLOCK = 1 << 20


def _sorted_doubles(df: DataFrame, column: str, order: tuple[str, ...]) -> DataFrame:
    return df.select(*order, F.col(column).cast("double").alias("x")).repartitionByRange(*order).sortWithinPartitions(*order).select("x")


def _blocks(batches, block: int) -> Iterator[bytes]:
    """Little-endian doubles of a partition, in blocks of so many."""
    held: list[bytes] = []
    size = 0
    for b in batches:
        raw = b["x"].to_numpy("<f8").tobytes()
        held.append(raw)
        size += len(raw)
        while size >= 8 * block:
            whole = b"".join(held)
            yield whole[: 8 * block]
            held = [whole[8 * block :]]
            size = len(held[0])
    if size:
        yield b"".join(held)


def write_column(df: DataFrame, column: str, path: str, *order: str, block: int = BLOCK) -> None:
    """A column as raw little-endian doubles in blocks of `block`, (part, block, data) rows of a table: parts are ranges of the rows sorted by
    `order`. Nulls are NaN."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for k, data in enumerate(_blocks(batches, block)):
            yield pd.DataFrame({"part": [part], "block": [k], "data": [data]})

    _sorted_doubles(df, column, order).mapInPandas(run, "part int, block int, data binary").write.mode("overwrite").parquet(path)


def write_binary(df: DataFrame, column: str, path: str, *order: str) -> int:
    """A column as files 00000000.bin, 00000001.bin, ... of raw little-endian doubles that any program reads, in a folder that all executors reach
    (a path or an address that Arrow knows); how many doubles there are. Files are ranges of the rows sorted by `order`. They're written under
    a name of their task's attempt and renamed when they're whole, so that a task may be repeated. Files that were there stay, if they've other
    names."""

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        place, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        name, out, n = f"{root.rstrip('/')}/{task.partitionId():08d}.bin", None, 0
        for data in _blocks(batches, BLOCK):
            if out is None:
                place.create_dir(root, recursive=True)
                out = place.open_output_stream(f"{name}.{task.taskAttemptId()}")
            out.write(data)
            n += len(data) // 8
        if out is not None:
            out.close()
            place.move(f"{name}.{task.taskAttemptId()}", name)
            yield pd.DataFrame({"n": [n]})

    return _sorted_doubles(df, column, order).mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_column(spark: SparkSession, path: str, raw: bool = False) -> DataFrame:
    """place (from 0), x: doubles of write_column's table, or (raw) of files *.bin in the order of their paths, each of which a task reads whole
    (Spark's limit for such files is 2 GB). Places are global prefix sums of the blocks' sizes, with nothing gathered on the driver."""
    if raw:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path).select("path", "length", F.col("content").alias("data"))
        keyed = files.select(F.struct("path").alias("key"), (F.col("length") / 8).cast("long").alias("n"), "data")
    else:
        keyed = spark.read.parquet(path).select(F.struct("part", "block").alias("key"), (F.length("data") / 8).cast("long").alias("n"), "data")
    starts, _ = prefixed(keyed.select("key", "n"), "key", "n")

    def run(batches):
        for batch in batches:
            for begin, data in zip(batch["begin"], batch["data"], strict=True):
                x = np.frombuffer(data, "<f8")
                for k in range(0, len(x), BLOCK):
                    yield pd.DataFrame({"place": int(begin) + np.arange(k, min(k + BLOCK, len(x))), "x": x[k : k + BLOCK]})

    return keyed.join(starts.select("key", F.col("begin").cast("long").alias("begin")), "key").select("begin", "data").mapInPandas(run, "place long, x double")


def decode_hypotheses(snapshots: DataFrame) -> DataFrame:
    """HYPOTHESIS rows of ragged snapshots: frame, hypos (flat tracks), hypos_card, clusters (flat hypothesis ids, from 1),
    clusters_card, log_probs. Probabilities are normalised in each cluster."""
    one = snapshots.select("frame", ragged.parts(F.col("hypos"), F.col("hypos_card")).alias("tracks"), "log_probs", F.posexplode(ragged.parts(F.col("clusters"), F.col("clusters_card"))).alias("cluster", "ids"))
    rows = one.select("frame", F.col("cluster").cast("int"), F.posexplode("ids").alias("hypo", "id"), "tracks", "log_probs")
    from ..functions.logspace import log_normalized

    rows = rows.select("frame", "cluster", "hypo", F.element_at("tracks", F.col("id")).alias("tracks"), F.element_at("log_probs", F.col("id")).alias("lp"))
    return rows.select("frame", "cluster", "hypo", "tracks", F.exp(log_normalized(F.col("lp"), "frame", "cluster")).alias("prob"))


def to_reward(matrices: DataFrame) -> DataFrame:
    """REWARD rows of a matrix column (rows of detections followed by the diagonal of missed detections); pairs of -inf are left out."""
    rows = matrices.select("frame", F.posexplode("matrix").alias("track", "row"), F.size("matrix").alias("n"))
    cells = rows.select("frame", (F.col("track") + 1).alias("track"), F.posexplode("row").alias("col", "ll"), (F.size("row") - F.col("n")).alias("m"))
    cells = cells.filter((F.col("col") < F.col("m")) | (F.col("col") - F.col("m") == F.col("track") - 1)).filter(F.col("ll") > float("-inf"))
    return cells.select("frame", "track", F.when(F.col("col") < F.col("m"), F.col("col") + 1).otherwise(0).alias("meas"), "ll")


def text_matrix(text: Column) -> Column:
    """Array of rows of a matrix in flow style text: rows, cols and row-major data."""
    number = lambda name: F.regexp_extract(text, rf"{name}:\s*(\d+)", 1).cast("int")
    data = F.transform(F.split(F.regexp_extract(text, r"data:\s*\[([^\]]*)\]", 1), r",\s*"), lambda x: F.trim(x).cast("double"))
    return ragged.matrix(number("rows"), number("cols"), data)


def frame_of_path(path: Column) -> Column:
    """The number in a file's name."""
    return F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"(\d+)", 1).cast("long")


def write_paths(df: DataFrame, path: str) -> None:
    df.select(F.col("path").cast("string")).write.mode("overwrite").text(path)


def write_sheet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)
