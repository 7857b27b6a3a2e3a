"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_ids, column_out, lookup_hot, pieces, shared_dir, tune, written

#: Fixed values of the format: the skippable frame that holds a dictionary, and the start of a zstd frame.
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
BLOCK_TYPE = "application/http;msgtype=response"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
ID = "urn:page:"
#: The dictionary is trained on a file's first records, up to so many bytes, to so many bytes.
SAMPLE_BYTES, DICTIONARY_BYTES = 1 << 20, 16 << 10


class BadArchive(ValueError):
    """The archive breaks the format."""


def digest_of(payload: bytes) -> str:
    """Bare base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit record (without the payload) that refers to a response."""
    revisit = refers_to is not None
    block = HTTP_HEAD % len(payload) + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{ID}{page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    target = "".join(c for c in url or "" if c.isprintable())
    head += [f"WARC-Target-URI: {target}"] * bool(target) + [f"WARC-Payload-Digest: sha1:{digest_of(payload)}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{ID}{refers_to}>"]
    head += [f"Content-Type: {BLOCK_TYPE}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary, or none where the samples are too few."""
    cut = [s[i : i + 2048] for s in samples for i in range(0, len(s), 2048)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, cut) if len(cut) >= 16 else None
    except zstandard.ZstdError:
        return None


def write_archive(out, records: Iterator[bytes], level: int = 3) -> tuple[int, int]:
    """Write records to a binary stream; the number of records and of bytes. Holds SAMPLE_BYTES of them at most."""
    held, size = [], 0
    for r in records:
        held.append(r)
        size += len(r)
        if size >= SAMPLE_BYTES:
            break
    made, n, wrote = train(held), 0, 0
    if made:
        raw = made.as_bytes()
        wrote += out.write(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw) or 0
    packer = zstandard.ZstdCompressor(level=level, dict_data=made, write_content_size=True, write_checksum=True)
    for source in (held, records):
        for r in source:
            frame = packer.compress(r)
            out.write(frame)
            n, wrote = n + 1, wrote + len(frame)
    return n, wrote


def frames(stream, chunk: int = 1 << 18) -> Iterator[bytes]:
    """The content of each frame of an archive, one at a time."""
    data, made = b"", None
    while len(data) < 8 and (more := stream.read(chunk)):
        data += more
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", data, 4)[0]
        while len(data) < 8 + size:
            if not (more := stream.read(chunk)):
                raise BadArchive("the dictionary is cut off")
            data += more
        raw, data = data[8 : 8 + size], data[8 + size :]
        if raw[:4] == struct.pack("<I", FRAME_MAGIC):
            raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 26)
        made = zstandard.ZstdCompressionDict(raw)
    unpacker = zstandard.ZstdDecompressor(dict_data=made)
    while data or (data := stream.read(chunk)):
        one, out = unpacker.decompressobj(), []
        while True:
            try:
                out.append(one.decompress(data))
            except zstandard.ZstdError as e:
                raise BadArchive(f"a frame is broken: {e}") from e
            if one.eof:
                data = one.unused_data
                break
            if not (data := stream.read(chunk)):
                raise BadArchive("a frame is cut off")
        yield b"".join(out)


def parse(data: bytes) -> dict:
    """Headers and payload of a record, after all checks."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode(errors="replace").split("\r\n")
    if not sep or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise BadArchive(f"not a record: {lines[0][:40]}")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise BadArchive(f"not a header: {line[:40]}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise BadArchive(f"no {name}")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise BadArchive("the length of the block isn't that of its header")
    kind, block = fields["warc-type"], rest[:-4]
    out = {"type": kind, "id": fields["warc-record-id"], "url": fields.get("warc-target-uri"), "digest": fields.get("warc-payload-digest", ""), "payload": block, "payload_bytes": len(block), "refers_to": fields.get("warc-refers-to")}
    if kind not in ("response", "revisit") or kind == "response" and not fields.get("content-type", "application/http").startswith("application/http"):
        return out  # warcinfo, request, metadata, resource and others, whose block is no page
    http, sep, payload = block.partition(b"\r\n\r\n")
    if kind == "revisit" and not block:  # the HTTP head of a revisit may be left out
        http, sep = b"HTTP/", b"\r\n\r\n"
    if not sep or not http.startswith(b"HTTP/"):
        raise BadArchive("the block isn't a response")
    length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), -1)
    told = out["digest"].partition(":")[0].lower() == "sha1"
    if kind == "response" and (0 <= length != len(payload) or told and out["digest"].partition(":")[2].upper() != digest_of(payload)):
        raise BadArchive("the payload isn't that of the headers")
    if kind == "revisit" and (payload or out["id"].strip("<>").startswith(ID) and (not out["refers_to"] or fields.get("warc-profile") != PROFILE)):
        raise BadArchive("the revisit isn't whole")
    return out | {"payload": payload, "payload_bytes": length if length >= 0 else len(payload)}


def _page(uri: str | None) -> int | None:
    """The page that a record of ours stands for; null for others' records, whose whole name is in record_id."""
    own = (uri or "").strip("<>")
    return int(own.removeprefix(ID)) if own.startswith(ID) and own.removeprefix(ID).lstrip("-").isdigit() else None


def _whole(spark: SparkSession, path: str) -> str:
    """A path with the scheme that Spark gives it, so that executors look where Spark does."""
    if "://" in path or path.startswith("file:"):
        return path.replace("file:///", "file:/").replace("file:/", "file:///")
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    return ("file://" if default.startswith("file:") else default.rstrip("/")) + path


def revisits(pages: DataFrame, smallest: int = 0, html: str = "html", key: str = "page_id") -> DataFrame:
    """key and refers_to of the rows that should be revisits: equal payloads (null: empty) of at least `smallest` bytes refer to
    the row of the largest key. Rows that share that key are all responses. Null keys are left out."""
    raw = F.coalesce(F.col(html), F.lit("")).cast("binary")
    digests = written(pages.filter(F.col(key).isNotNull()).select(key, F.sha1(raw).alias("sha"), F.length(raw).alias("size")).filter(F.col("size") >= smallest).drop("size"))
    groups = digests.groupBy("sha").agg(F.max(key).alias("refers_to"), F.count("*").alias("n")).filter("n > 1")
    # groups of one are responses whatever else holds, so only the others are looked up
    found = lookup_hot(digests, written(groups), "sha", "n", digests.count())
    return found.filter(F.col("refers_to").isNotNull() & (F.col(key) != F.col("refers_to"))).select(key, "refers_to").distinct()


_FILE = T.StructType().add("path", "string").add("n_records", "long").add("n_bytes", "long")


def write_archives(pages: DataFrame, folder: str, smallest: int = 0) -> DataFrame:
    """Write every page as a record, a file for each partition that has rows; path, n_records, n_bytes of the files.

    Null html is an empty payload; rows with a null page_id are left out; repeated rows are records each. A file's name
    has the attempt of its task, and the list of files is a written table, so that only files of tasks that Spark has
    committed are read. No file for an empty table."""
    tune(pages.sparkSession)
    folder = _whole(pages.sparkSession, folder)
    to = by_ids(pages.filter("page_id is not null").select("page_id", "url", "html"), written(revisits(pages, smallest)), "left", "page_id")

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        path = f"{folder}/pages-{task.partitionId():06d}-{task.taskAttemptId()}.warc.zst"

        def records():
            for part, htmls in pieces(batches, "html"):
                ids, urls, refers = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("page_id", "url", "refers_to"))
                yield from (record(*x) for x in zip(ids, urls, htmls, refers, strict=True))

        stream = records()
        if (first := next(stream, None)) is not None:
            store, at = fs.FileSystem.from_uri(folder)
            store.create_dir(at, recursive=True)
            with store.open_output_stream(f"{at}/{path.rpartition('/')[2]}", compression=None) as out:
                n, size = write_archive(out, _chain(first, stream))
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [n], "n_bytes": [size]})

    return written(to.mapInArrow(run, _FILE))


def _chain(first: bytes, rest: Iterator[bytes]) -> Iterator[bytes]:
    yield first
    yield from rest


RECORD = T.StructType().add("page_id", "long").add("url", "string").add("record_type", "string").add("payload_digest", "string").add("payload_bytes", "long").add("refers_to", "long").add("record_id", "string").add("payload", "binary")


def read_archives(files: DataFrame, payload: bool = True) -> DataFrame:
    """The records of the archives that the column path names; each frame is decoded and checked alone. Records that we didn't write
    have page_id null; those that are no pages (requests, metadata) have their block as payload."""
    default = _whole(files.sparkSession, "/")

    def whole(path: str) -> str:
        return path if "://" in path else default.rstrip("/") + path

    schema = RECORD if payload else T.StructType(RECORD.fields[:-1])

    def run(batches):
        for batch in batches:
            for path in batch.column(batch.schema.get_field_index("path")).to_pylist():
                store, at = fs.FileSystem.from_uri(whole(path))
                with store.open_input_stream(at, compression=None) as stream:
                    rows, size = [], 0
                    for data in frames(stream):
                        r = parse(data)
                        rows.append([_page(r["id"]), r["url"], r["type"], r["digest"].removeprefix("sha1:"), r["payload_bytes"], _page(r["refers_to"]), r["id"].strip("<>"), *[r["payload"]] * payload])
                        size += len(data) * payload + 200
                        if size > 4 << 20:
                            yield _records(rows, schema)
                            rows, size = [], 0
                    if rows:
                        yield _records(rows, schema)

    n = max(1, files.count())
    return files.select("path").repartition(n).mapInArrow(run, schema)


def _records(rows: list[list], schema: T.StructType) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.dataType.typeName()]) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], names=schema.names)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the pages to archives in a folder of the shared store and read the records back."""
    return read_archives(write_archives(pages, folder or shared_dir(pages.sparkSession)), payload=False)
