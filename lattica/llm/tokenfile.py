"""Token ids in Parquet list columns: dictionary or delta encoding, controlled row groups and pages, selective reads."""

from __future__ import annotations

import json
import os
import zlib
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import ChunkTable
from .common import column_out, offsets, partitions, pieces, ragged, shared_dir, tune

#: Id that ends each document.
END = 2
#: Bytes of a row group and of a page, and rows of a page: the unit of a selective read.
ROW_GROUP, PAGE, PAGE_ROWS = 8 << 20, 256 << 10, 2000

#: How the vocabulary writes a leading space, and how many chunks of text the library gets as one text.
SPACE, JOINED = "\u0120", 500

FILE = T.StructType().add("doc_id", "long").add("part", "integer").add("local_start", "long").add("n_tokens", "long").add("tokens", T.ArrayType(T.IntegerType(), False))


def layout(encoding: str = "dictionary") -> dict[str, str]:
    """Writer options. "dictionary": ids by a dictionary for each column chunk; "delta": binary packed deltas (format version 2).
    Either way the writer adds column and offset indexes for its pages."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(encoding)
    return {
        "parquet.enable.dictionary": str(encoding == "dictionary").lower(), "parquet.writer.version": "PARQUET_1_0" if encoding == "dictionary" else "PARQUET_2_0",
        "parquet.block.size": str(ROW_GROUP), "parquet.page.size": str(PAGE), "parquet.dictionary.page.size": str(1 << 20), "parquet.page.row.count.limit": str(PAGE_ROWS), "compression": "zstd",
    }


@lru_cache(maxsize=2)
def library_table(path: str) -> ChunkTable:
    """Encodes through the tokenizers library, which gets each distinct chunk once; whole texts, if it cuts by another pattern than
    CUT_PATTERN."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    # the library takes these strings out of a text first, wherever they stand
    added = tuple(a["content"].encode() for a in spec.get("added_tokens") or [])
    spaced = np.array([(t.id_to_token(k) or "").startswith(SPACE) for k in range(t.get_vocab_size())])

    def alone(chunks: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in t.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)]

    newline = alone([b"\n"])[0]

    def encode(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Chunks between visible characters are joined to longer texts: those that begin with their only space directly, their ids
        parting again where one begins with a space; those without a space at newlines, whose ids part them."""
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        at, raw = offsets(size), np.frombuffer(b"".join(chunks) + b"  ", np.uint8)
        first, second, last = raw[at[:-1]], raw[at[:-1] + 1], raw[np.maximum(at[1:] - 1, 0)]
        seen = lambda x: (x > 32) & (x < 127)
        if any(s in chunk for s in added for chunk in chunks):
            first = np.where([any(s in chunk for s in added) for chunk in chunks], 0, first)  # those aren't joined
        n_space, n_line = (np.diff(offsets(raw[:-2] == c)[at]) for c in (32, 10))
        after = np.flatnonzero((size > 1) & (first == 32) & seen(second) & seen(last) & (n_space == 1)).tolist()
        bare = np.flatnonzero(seen(first) & seen(last) & (n_space == 0) & (n_line == 0)).tolist() if len(newline) == 1 else []
        runs = [(own[i : i + JOINED], join) for own, join in ((after, b""), (bare, b"\n")) for i in range(0, len(own), JOINED)]
        flat, lens, order = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], []
        for (run, join), ids in zip(runs, alone([join.join([chunks[k] for k in run]) for run, join in runs]), strict=True):
            if join:
                cut = ids == newline[0]
                ids, at = ids[~cut], np.append(0, np.flatnonzero(cut) - np.arange(cut.sum()))
            else:
                at = np.flatnonzero(spaced[ids])
            if len(at) == len(run):
                flat.append(ids), lens.append(np.diff(at, append=len(ids))), order.extend(run)
        place = np.full(len(chunks), -1, np.int64)
        place[order] = np.arange(len(order))
        rest = np.flatnonzero(place < 0)
        place[rest] = len(order) + np.arange(len(rest))
        got = alone([chunks[k] for k in rest.tolist()])
        flat, lens = np.concatenate([*flat, *got]), np.concatenate([*lens, np.array([len(x) for x in got], np.int64)])
        return ragged(flat, offsets(lens)[:-1][place], lens[place]), lens[place]

    own = spec.get("pre_tokenizer") or {}
    byte_level = own.get("type") == "ByteLevel" and own.get("use_regex", True) and not own.get("add_prefix_space", True)
    plain = all(a["special"] and not a.get("normalized") for a in spec.get("added_tokens") or [])
    return ChunkTable(encode, cut=byte_level and spec.get("normalizer") is None and plain, whole=added)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int = END, encoding: str = "dictionary") -> None:
    """Write FILE rows in ascending doc_id order: a file for each range of ids, in order of `part`; local_start counts the ids
    of the documents before it in its part.

    Null texts are empty and have only the end id; repeated rows each have their ids (equal doc_ids in the order of their texts);
    other columns aren't written. The ranges are dealt by doc_id and a digest, so one id may hold many rows."""
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    ranged = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)

    def run(batches):
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        chunks = library_table(tokenizer)
        for batch, texts in pieces(batches):
            flat, counts = chunks.encode(texts)
            flat = np.insert(flat, np.cumsum(counts), np.int32(end))
            at = offsets(counts + 1)
            new = {"part": pa.array(np.full(len(counts), part, np.int32)), "local_start": pa.array(before + at[:-1]), "n_tokens": pa.array(counts + 1)}
            new["tokens"] = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat, pa.int32()))
            yield column_out(batch, ["doc_id"], new)
            before += int(at[-1])

    ranged.mapInArrow(run, FILE).write.options(**layout(encoding)).parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens: a read of the metadata columns alone. The parts' totals, one
    small row each, are summed on the driver."""
    rows = spark.read.schema(FILE).parquet(path).select("doc_id", "part", "local_start", "n_tokens")
    return _started(rows, path).drop("part", "local_start")


def _started(rows: DataFrame, path: str) -> DataFrame:
    spark = rows.sparkSession
    totals = sorted(tuple(r) for r in spark.read.schema(FILE).parquet(path).groupBy("part").agg(F.sum("n_tokens")).collect())
    before = list(accumulate([n for _, n in totals], initial=0))
    table = spark.createDataFrame([(p, b) for (p, _), b in zip(totals, before, strict=False)], "part int, before long")
    return rows.join(F.broadcast(table), "part").withColumn("start", F.col("before") + F.col("local_start")).drop("before")


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """The rows of the documents from `low` to `high` (both included); others' row groups and pages are skipped."""
    rows = spark.read.schema(FILE).parquet(path)
    for bound, test in ((low, F.col("doc_id") >= (low or 0)), (high, F.col("doc_id") <= (high or 0))):
        if bound is not None:
            rows = rows.filter(test)
    return rows


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), from the files."""
    tune(spark)
    schema = T.StructType().add("doc_id", "long").add("part", "integer").add("local_start", "long").add("n_tokens", "long").add("ids_crc32", "long")

    def run(batches):
        for batch in batches:
            col = batch.column(batch.schema.get_field_index("tokens"))
            at, raw = col.offsets.to_numpy(), memoryview(np.ascontiguousarray(col.values.to_numpy(zero_copy_only=False).astype("<u4")).view(np.uint8))
            crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield column_out(batch, ["doc_id", "part", "local_start"], {"n_tokens": pa.array(np.diff(at).astype(np.int64)), "ids_crc32": pa.array(crc, pa.int64())})

    rows = read_tokens(spark, path).select("doc_id", "part", "local_start", "tokens").mapInArrow(run, schema)
    return _started(rows, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, end: int = END, encoding: str = "dictionary") -> DataFrame:
    """Write the documents' ids to a folder of the shared store and give digests() of the files."""
    path = shared_dir(docs.sparkSession)
    write_tokens(docs, path, tokenizer, end, encoding)
    return digests(docs.sparkSession, path)
