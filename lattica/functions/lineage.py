"""Tables that several parts of a plan need, written once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, one of our own, which only a local master's tasks can reach, so
    other masters are refused."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="lattica-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/lattica-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The table, written to the shared folder and read back: it's computed once, and lost executors don't lose it."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """The table written, and never broadcast for its size on disk: sorted keys and repeated values take a hundredth there of what they take
    as rows, so a table of some MB would fill the driver."""
    return written(df).hint("merge")


def shuffles(spark: SparkSession) -> int:
    """How many tasks shuffles have."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows that take long each, dealt to as many tasks as shuffles have: by their bytes alone few tasks would get them."""
    return df.repartition(shuffles(df.sparkSession), *keys)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of few keys that take long each, dealt by ranges of the keys: by their bytes few tasks would get them, and by hashes some tasks several keys
    while others get none."""
    return df.repartitionByRange(shuffles(df.sparkSession), *keys)
