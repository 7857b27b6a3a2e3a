"""Shared helpers: the shared folder, written intermediate tables, Arrow batches cut by text size, word and ragged-array kernels."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Text bytes handled at once inside a Python worker; longer texts are handled alone.
BATCH_BYTES = 1 << 20
#: Rows per Arrow batch between the JVM and Python; keeps a batch of ordinary texts at a few MB.
ARROW_ROWS = 500


def tune(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Keep Arrow batches small, so that memory doesn't follow the length of texts; more rows only for narrow tables."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset (tests), below a folder of our own, which only a local master's tasks can
    reach: other masters are refused."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="lattica-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/lattica-{uuid.uuid4().hex}"


def written(df: DataFrame, **options: str) -> DataFrame:
    """Cut the lineage: write the table to the shared folder and read it back."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut batches so that each has about `limit` bytes of text; gives the rows and their texts as UTF-8 (null: empty)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        size = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, done = 0, 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(size, done + limit, "right")))
            part = batch.slice(at, end - at)
            texts = part.column(part.schema.get_field_index(column)).cast(pa.binary()).to_pylist()
            yield part, [t or b"" for t in texts]
            at, done = end, int(size[end - 1])


def ragged(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The concatenation of flat[starts[i] : starts[i] + lens[i]]."""
    lens = lens.astype(np.int64)
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    index = np.repeat(starts.astype(np.int64) - (ends - lens), lens)
    index += np.arange(total)
    return flat[index]


def offsets(lens: np.ndarray | list[int]) -> np.ndarray:
    out = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(np.asarray(lens, np.int64), out=out[1:])
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), elementwise on uint64."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def column_out(batch: pa.RecordBatch, names: list[str], extra: dict[str, pa.Array]) -> pa.RecordBatch:
    """Some columns of a batch followed by new ones."""
    arrays = [batch.column(batch.schema.get_field_index(n)) for n in names] + list(extra.values())
    return pa.RecordBatch.from_arrays(arrays, names=names + list(extra))


#: Keys that hold at least this share of all rows are looked up through a broadcast; there are at most as many as its inverse.
HOT_SHARE = 1 / 500


def lookup_hot(facts: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Left join of facts with a table that has one row for each key and, in `count`, how many facts have it.

    Keys with a share of HOT_SHARE or more are at most 1 / HOT_SHARE and go by broadcast; the others are shuffled."""
    from pyspark.sql import functions as F

    hot = table.filter(F.col(count) >= max(1000, total * HOT_SHARE))
    cold = table.filter(F.col(count) < max(1000, total * HOT_SHARE))
    by_broadcast = facts.join(F.broadcast(hot), key, "inner")
    rest = facts.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, "left")
    return by_broadcast.unionByName(rest)


#: Rows of a narrow table (ids and a few numbers, no texts) that are broadcast at most.
ID_LIMIT = 1_000_000


def by_ids(df: DataFrame, ids: DataFrame, how: str, on: str | list[str] = "doc_id", limit: int = ID_LIMIT) -> DataFrame:
    """Semi, anti or left join with a table of ids (and columns); broadcast if it's counted to have few rows, else shuffled."""
    from pyspark.sql import functions as F

    few = ids.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(ids) if few else ids, on, how)


#: Copies of a hot key's row in a salted join.
SALTS = 16


def join_salted(facts: DataFrame, table: DataFrame, key: str, by: str) -> DataFrame:
    """Inner join of facts with a table of one row for each key, of whatever size. Keys with a share of HOT_SHARE or more of the facts, of
    which there are at most 1 / HOT_SHARE, are dealt to SALTS tasks by the column `by`, and their rows of the table copied so often."""
    from pyspark.sql import functions as F

    counts = written(facts.groupBy(key).agg(F.count("*").alias("_n")))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = F.broadcast(counts.filter(F.col("_n") >= max(1000, total * HOT_SHARE)).select(key, F.lit(True).alias("_hot")))
    left = facts.join(hot, key, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.hash(by), F.lit(SALTS))).otherwise(0)).drop("_hot")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = table.join(hot, key, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return left.join(right, [key, "_salt"]).drop("_salt")
