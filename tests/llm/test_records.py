import hashlib
import io
import random
import struct
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from lattica.llm import queries, sharding, sql, warc


def placed(docs, n):
    rows = sorted(docs, key=lambda r: (r[0], zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode())))
    sizes = [len((t or "").encode()) + 1 for _, t in rows]
    total, before, out, seen = sum(sizes), 0, [], {}
    for (k, t), s in zip(rows, sizes, strict=True):
        shard = (2 * before + s) * n // (2 * total)
        out.append((k, s, zlib.crc32((t or "").encode()), shard, seen.get(shard, 0)))
        seen[shard] = seen.get(shard, 0) + 1
        before += s
    return out


@pytest.mark.parametrize("n", [1, 3, 16])
def test_shards_equal_brute_force(odd_docs, odd_rows, n):
    docs = odd_docs.withColumn("shard", F.lit("mine")).withColumn("size", F.lit(-1))
    got = sharding.assign_shards(docs, n).collect()
    assert sorted(map(tuple, got)) == sorted(placed([(r[0], r[1]) for r in odd_rows if r[0] is not None], n))


def test_shards_equal_their_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.sql(sql.ORACLE["op2_shards"])
    assert sorted(map(tuple, queries.op2_shards(spark, sf_dir).select(*want.columns).collect())) == sorted(want.fetchall())


def test_shards_are_even(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(k, "x" * rng.randrange(400)) for k in range(3000)], "doc_id long, text string").repartition(7)
    sums = {r.shard: r.b for r in sharding.assign_shards(docs, 16).groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    assert len(sums) == 16 and max(sums.values()) - min(sums.values()) <= 2 * 400


def test_shards_of_nothing_and_of_one_id(spark, empty_docs):
    assert sharding.assign_shards(empty_docs, 4).count() == 0
    one = spark.createDataFrame([(None, None), (7, "a")] + [(7, "same")] * 50, "doc_id long, text string")
    got = sharding.assign_shards(one, 4).collect()
    assert len(got) == 52 and {r.shard for r in got} == {0, 1, 2, 3}


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(k, "t" * (k % 5)) for k in range(100)], "doc_id long, text string")
    sharding.write_shards(docs, sharding.assign_shards(docs, 4), str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 100 and back.select("shard").distinct().count() == 4


PAGES = "page_id long, url string, html string"


def expected(rows):
    last = {}
    for k, _, h in rows:
        if k is not None:
            last[h or ""] = max(last.get(h or "", k), k)
    return sorted((k, len((h or "").encode()), warc.digest_of((h or "").encode()), "response" if last[h or ""] == k else "revisit", None if last[h or ""] == k else last[h or ""]) for k, _, h in rows if k is not None)


def test_archives_round_trip(spark):
    rows = [(1, "http://a/", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://b/\n x", None), (4, "u", ""), (5, "ü://é", "é" * 4000), (6, "v", "x" * 300_000), (None, "w", "lost")]
    rows += [(k, f"http://c/{k}", f"<html><body>page {k % 40} of many</body></html>") for k in range(10, 400)] + [(1, "http://a/", "<p>one</p>")]
    pages = spark.createDataFrame(rows, PAGES).withColumn("refers_to", F.lit("mine")).repartition(3)
    got = warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(expected(rows), key=key)


def test_archives_of_nothing(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_payloads_come_back(spark, tmp_path):
    pages = spark.createDataFrame([(k, "u", f"<p>{k}</p>" * k) for k in range(60)], PAGES)
    back = warc.read_archives(warc.write_archives(pages, str(tmp_path / "w"), smallest=1))
    assert {r.page_id: bytes(r.payload).decode() for r in back.collect()} == {k: f"<p>{k}</p>" * k for k in range(60)}


def archive(n=100):
    out = io.BytesIO()
    warc.write_archive(out, iter([warc.record(k, "http://x/", b"<html>page %d</html>" % k * 30, None) for k in range(n)]))
    return out.getvalue()


def test_dictionary_leads_and_each_record_is_a_frame():
    raw = archive()
    assert struct.unpack_from("<I", raw)[0] == warc.DICTIONARY_MAGIC
    for chunk in (7, 100, 1 << 20):
        records = [warc.parse(x) for x in warc.frames(io.BytesIO(raw), chunk)]
        assert [r["id"] for r in records] == [f"<urn:page:{k}>" for k in range(100)]


def test_broken_archives_are_told():
    raw = archive()
    with pytest.raises(warc.BadArchive):
        list(warc.frames(io.BytesIO(raw[:-3])))
    with pytest.raises(warc.BadArchive):
        list(warc.frames(io.BytesIO(raw[:-200] + b"\0" * 40 + raw[-160:])))
    good = warc.record(1, "u", b"payload", None)
    for bad in (good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"payload\r\n", b"payloaf\r\n"), good[:-1], good.replace(b"WARC-Date", b"X-Date"), good + b"x"):
        with pytest.raises(warc.BadArchive):
            warc.parse(bad)
    assert warc.parse(good)["digest"] == "sha1:" + __import__("base64").b32encode(hashlib.sha1(b"payload").digest()).decode()


def test_archives_of_others_are_read(spark, tmp_path):
    """Records of all kinds, names that aren't ours, digests of other kinds, and headers that aren't UTF-8."""
    import io

    head = lambda kind, block, *more: ("\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:1-2>", "WARC-Date: 2020-01-01T00:00:00Z", *more, f"Content-Length: {len(block)}"])).encode("latin-1") + b"\r\n\r\n" + block + b"\r\n\r\n"
    page = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\nhello"
    records = [head("warcinfo", b"software: x"), head("request", b"GET / HTTP/1.1\r\n\r\n", "WARC-Target-URI: http://a/\xe9"), head("response", page, "WARC-Payload-Digest: md5:abc"), head("metadata", b"a: b")]
    out = io.BytesIO()
    warc.write_archive(out, iter(records))
    (tmp_path / "other.warc.zst").write_bytes(out.getvalue())
    files = spark.createDataFrame([(str(tmp_path / "other.warc.zst"),)], "path string")
    got = warc.read_archives(files).collect()
    assert [(r.record_type, r.page_id, r.record_id) for r in got] == [(k, None, "urn:uuid:1-2") for k in ("warcinfo", "request", "response", "metadata")]
    assert bytes(got[2].payload) == b"hello" and got[2].payload_bytes == 5 and bytes(got[0].payload) == b"software: x"


def test_files_hold_frames_as_they_are(spark, tmp_path):
    """A file begins with the dictionary's skippable frame, or a frame: nothing compresses it once more by its name."""
    pages = spark.createDataFrame([(k, f"http://a/{k}", f"<p>page {k} of many pages of one kind</p>" * 20) for k in range(200)], "page_id long, url string, html string").coalesce(1)
    (file,) = warc.write_archives(pages, str(tmp_path / "w")).collect()
    raw = open(file.path.removeprefix("file://"), "rb").read()
    assert len(raw) == file.n_bytes and struct.unpack_from("<I", raw)[0] == warc.DICTIONARY_MAGIC
    assert sum(1 for _ in warc.frames(io.BytesIO(raw))) == 200
