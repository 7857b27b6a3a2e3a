"""Contiguous shards of equal bytes: prefix sums from per-partition totals, cut at equal targets."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_out, partitions, tune, written


def assign_shards(docs: DataFrame, shards: int = 16, text: str = "text", order: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of each row.

    Rows are ordered by `order`, then by digest and size (null ids first); a row's size is the UTF-8 bytes of its text
    (null: none) plus 1. It goes to the shard in whose equal share of all bytes its middle falls, so shards are contiguous
    runs and differ by less than the largest row. slot counts from 0 in each shard. An empty table gives no rows; repeated
    rows each have a slot; other columns of docs aren't returned, so their names can't clash.

    Only (id, size, digest) is shuffled, never the text. The totals of the ordered partitions, one small row each, are
    summed on the driver."""
    spark = docs.sparkSession
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    narrow = docs.select(F.col(order).alias("doc_id"), (F.length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    keys = ["doc_id", "text_crc32", "size"]
    tune(spark, 50_000)
    ranged = narrow.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
    parts = written(ranged.mapInArrow(_running, T.StructType([*narrow.schema, *_PART])))
    totals = sorted(tuple(r) for r in parts.groupBy("part").agg(F.max("bytes_to"), F.max("row_at")).collect())
    total = sum(b for _, b, _ in totals)
    before_bytes = dict(zip([p for p, _, _ in totals], accumulate([b for _, b, _ in totals], initial=0), strict=False))
    before_rows = dict(zip([p for p, _, _ in totals], accumulate([r + 1 for _, _, r in totals], initial=0), strict=False))

    def place(batches):
        for batch in batches:
            part, size, to, at = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("part", "size", "bytes_to", "row_at"))
            end = to + np.array([before_bytes[p] for p in part.tolist()], np.int64)
            row = at + np.array([before_rows[p] for p in part.tolist()], np.int64)
            yield column_out(batch, ["doc_id", "size", "text_crc32"], {"shard": pa.array(((2 * end - size) * shards // (2 * total)).astype(np.int32)), "row": pa.array(row)})

    schema = T.StructType([*narrow.schema]).add("shard", "integer").add("row", "long")
    placed = parts.mapInArrow(place, schema)
    first = dict(tuple(r) for r in placed.groupBy("shard").agg(F.min("row")).collect())
    starts = F.create_map(*[F.lit(x) for s, r in first.items() for x in (s, int(r))]) if first else F.create_map(F.lit(0), F.lit(0))
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.element_at(starts, F.col("shard"))).cast("long").alias("slot"))


_PART = T.StructType().add("part", "integer").add("bytes_to", "long").add("row_at", "long")


def _running(batches):
    """Bytes up to and with each row and its place, within this partition."""
    from pyspark import TaskContext

    part, size, rows = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        n = batch.num_rows
        to = size + np.cumsum(batch.column(batch.schema.get_field_index("size")).to_numpy(zero_copy_only=False).astype(np.int64))
        yield column_out(batch, batch.schema.names, {"part": pa.array(np.full(n, part, np.int32)), "bytes_to": pa.array(to), "row_at": pa.array(np.arange(rows, rows + n))})
        size, rows = int(to[-1]) if n else size, rows + n


def write_shards(docs: DataFrame, placed: DataFrame, path: str, key: str = "doc_id") -> None:
    """Write the whole rows below path/shard=<n>/, in their order. `key` must be unique in docs, which have no columns shard and slot."""
    if {"shard", "slot"} & set(docs.columns):
        raise ValueError("docs have a column shard or slot already")
    where = placed.select(F.col("doc_id").alias(key), "shard", "slot")
    rows = docs.join(where, key)
    rows.repartitionByRange(partitions(docs.sparkSession), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
