import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lattica.llm import bpe, queries, tokencount, tokenfile
from lattica.llm.common import ragged

RANKS = P.path("byte_bpe_50k.tiktoken")
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def by_library(text):
    return LIBRARY.encode_ordinary(text or "")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'st  \n\n\t　\x85\x1c1２éß×ªⅧ漢!?.,$_Z") | st.characters(exclude_categories=["Cs"]), max_size=80), min_size=1, max_size=6))
def test_encode_equals_library_and_decodes_exactly(texts):
    chunks, core = bpe.table(RANKS, P.PATTERN), bpe.load(RANKS, P.PATTERN)
    flat, counts = chunks.encode([t.encode() for t in texts])
    at = np.concatenate([[0], np.cumsum(counts)])
    for k, t in enumerate(texts):
        ids = flat[at[k] : at[k + 1]]
        assert ids.tolist() == by_library(t)
        assert core.decode(ids).tobytes() == t.encode()


def test_long_pretokens_use_the_heap_with_equal_results():
    core = bpe.load(RANKS, P.PATTERN)
    for word in (b"a" * 2000, b"ab" * 700, bytes(range(97, 123)) * 60):
        ids = core.merge([word])[0].tolist()
        assert ids == [i for i in LIBRARY._core_bpe.encode_ordinary(word.decode())]
        short = word[: bpe.LONG]
        assert core._merge_long(short).tolist() == core.merge([short])[0].tolist()


def test_full_table_is_emptied_without_harm():
    small = bpe.ChunkTable(bpe.load(RANKS, P.PATTERN).encode_chunks, rows=5)
    for t in ("one two three four five six", "seven eight nine ten", "one two"):
        assert small.encode([t.encode()])[0].tolist() == by_library(t)


def test_words_with_marks_and_lines_by_both_encoders():
    lib = tokenfile.library_table(P.path("byte_bpe_50k.json"))
    texts = ["word. word, word&&& word", "a.\nB c,\nd", "\n", "x\n", "\nx", "x\n\ny. z", "x \n y", "it's. don't, 'tis' 5. é. ×. ª!", "x" + "." * 40, "漢. 字,\n漢", ""]
    for made, want in ((bpe.ChunkTable(lib.encode_chunks, 4), own_ids), (bpe.ChunkTable(bpe.load(RANKS, P.PATTERN).encode_chunks, 4), lambda ts: [by_library(t) for t in ts])):
        for batch in (texts, texts[::-1], texts[2:5], [""]):
            flat, counts = made.encode([t.encode() for t in batch])
            assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == want(batch)


def test_ragged():
    assert ragged(np.arange(10), np.array([7, 2, 0]), np.array([2, 0, 3])).tolist() == [7, 8, 0, 1, 2]


def test_round_trip_of_all_rows(odd_docs, odd_rows, empty_docs):
    clash = odd_docs.withColumn("n_tokens", F.lit("mine")).withColumn("ids_sha256", F.lit(1))
    got = sorted(map(tuple, bpe.round_trip(clash, RANKS, P.PATTERN).collect()))
    want = []
    for k, t, *_ in odd_rows:
        if k is not None:
            ids = by_library(t)
            want.append((k, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.round_trip(empty_docs, RANKS, P.PATTERN).count() == 0


def test_encode_and_decode_tables(odd_docs):
    rows = bpe.decode(bpe.encode(odd_docs, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert rows and all(bytes(r.decoded).decode() == (r.text or "") and r.token_ids == by_library(r.text) for r in rows)


def own_ids(texts):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_file(spark, odd_docs, odd_rows, encoding, tmp_path):
    path = str(tmp_path / "tokens")
    tokenfile.write_tokens(odd_docs.withColumn("part", F.lit("mine")), path, P.path("byte_bpe_50k.json"), encoding=encoding)
    rows = [r for r in odd_rows if r[0] is not None]
    rows.sort(key=lambda r: r[0])
    want, start = [], 0
    for (k, *_), ids in zip(rows, own_ids([r[1] for r in rows]), strict=True):
        raw = np.array([*ids, 2], "<u4").tobytes()
        want.append((k, start, len(ids) + 1, zlib.crc32(raw)))
        start += len(ids) + 1
    assert sorted(map(tuple, tokenfile.digests(spark, path).collect())) == want
    assert sorted(map(tuple, tokenfile.read_index(spark, path).select("doc_id", "start", "n_tokens").collect())) == [w[:3] for w in want]
    some = tokenfile.read_tokens(spark, path, 4, 6)
    assert sorted(r.doc_id for r in some.collect()) == [4, 5, 6]
    import glob

    import pyarrow.parquet as pq

    meta = [pq.ParquetFile(f).metadata for f in sorted(glob.glob(f"{path}/*.parquet"))]
    columns = [m.row_group(0).column(m.num_columns - 1) for m in meta if m.num_row_groups]
    said = {e for c in columns for e in c.encodings}
    assert ("DELTA_BINARY_PACKED" in said) if encoding == "delta" else any("DICTIONARY" in e for e in said)
    assert all(c.has_column_index and c.has_offset_index for c in columns)


def test_token_file_of_nothing(spark, empty_docs, tmp_path):
    tokenfile.write_tokens(empty_docs, str(tmp_path / "t"), P.path("byte_bpe_50k.json"))
    assert tokenfile.digests(spark, str(tmp_path / "t")).count() == 0


def edited(text, edits):
    for at, gone, new in edits:
        at = min(max(0, at), len(text))
        text = text[:at] + new + text[min(at + max(0, gone), len(text)) :]
    return text


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab c  d\n\n　é1'st."), max_size=600), st.lists(st.tuples(st.integers(-1, 700), st.integers(-1, 300), st.text(st.sampled_from("xy \n1é"), max_size=6)), max_size=6))
def test_edits_equal_a_full_count(text, edits):
    chunks = bpe.table(RANKS, P.PATTERN)
    tree = tokencount.trees([text.encode()], chunks)[0]
    for e in edits:
        tree.edit(e[0], e[1], e[2].encode(), lambda t: int(chunks.count([t])[0]))
        text = edited(text, [e])
        assert tree.text.decode() == text and tree.n_tokens == len(by_library(text))
        assert tree.points[1] == len(text)


def test_edits_encode_little_of_a_long_text():
    chunks = bpe.table(RANKS, P.PATTERN)
    text = "some plain words in a row " * 20_000
    tree = tokencount.trees([text.encode()], chunks)[0]
    tree.edit(250_000, 3, b"new", lambda t: int(chunks.count([t])[0]))
    assert tree.encoded < 2000 and tree.n_tokens == len(by_library(edited(text, [(250_000, 3, "new")])))


def test_count_edited_table(spark, odd_docs, odd_rows, empty_docs):
    docs = queries.edits(odd_docs).withColumn("n_tokens", F.lit("mine"))
    given = {(r.doc_id, r.text): [(e["at"], e["deleted"], e["inserted"]) for e in r.edits] for r in docs.collect()}
    got = tokencount.count_edited(docs, RANKS, P.PATTERN, ["doc_id", "text"]).collect()
    assert len(got) == sum(r[0] is not None for r in odd_rows)
    for r in got:
        after = edited(r.text or "", given[r.doc_id, r.text])
        assert (r.n_tokens, r.n_tokens_edited, r.n_bytes_edited) == (len(by_library(r.text)), len(by_library(after)), len(after.encode()))
        assert r.tree[0] == r.n_tokens_edited
    assert tokencount.count_edited(queries.edits(empty_docs), RANKS, P.PATTERN).count() == 0
    none = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, edits array<struct<at:long,deleted:long,inserted:string>>")
    assert tokencount.count_edited(none, RANKS, P.PATTERN).first().n_tokens_edited == 2


def test_ranks_are_those_of_the_file():
    ranks = bpe.read_ranks(RANKS)
    assert ranks[b"a"] == LIBRARY.encode_ordinary("a")[0] and base64.b64encode(b"a")


def test_edits_of_a_stored_table_encode_little(spark, tmp_path):
    texts = {1: "some plain words in a row " * 2000, 2: None, 3: "short text", 4: "one. two, three " * 500}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    tokencount.build(docs, RANKS, P.PATTERN).write.parquet(str(tmp_path / "trees"))
    edits = {1: [(20_000, 3, "new words"), (5, 0, "x" * 9000)], 2: [(0, 0, "first")], 4: [(3, 900, "")]}
    later = spark.createDataFrame(list(edits.items()), "doc_id long, edits array<struct<at:long,deleted:long,inserted:string>>")
    again = tokencount.apply_edits(spark.read.parquet(str(tmp_path / "trees")), later, RANKS, P.PATTERN)
    for r in again.collect():
        want = edited(texts[r.doc_id] or "", edits.get(r.doc_id, []))
        assert b"".join(map(bytes, r.leaves)).decode() == want and r.n_tokens == sum(r.leaf_tokens) == len(by_library(want))
        assert r.n_bytes_encoded < 25_000 and (r.doc_id in edits or r.n_bytes_encoded == 0)


def test_other_patterns_are_not_cut():
    """Marks that take line ends with them, and a token of both."""
    ranks = bpe.read_ranks(RANKS) | {b"!\n": 60_000}
    pattern = r"[^\s\p{L}\p{N}]+[\r\n]*|\p{L}+|\s+|\p{N}+"
    core = bpe.ByteBPE(ranks, pattern)
    table = bpe.ChunkTable(core.encode_chunks, cut=pattern == bpe.CUT_PATTERN)
    want = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary("a!\nb")
    assert table.encode([b"a!\nb"])[0].tolist() == want and 60_000 in want


def test_hashes_of_one_value_do_not_harm():
    """Different chunks whose first hashes agree are told apart by the second."""
    made = bpe.ChunkTable(bpe.load(RANKS, P.PATTERN).encode_chunks)
    made.tables[0][:] = 0
    text = "all of these words have one first hash"
    for _ in range(2):
        assert made.encode([text.encode()])[0].tolist() == by_library(text)


def thue_morse(n, one, other):
    return bytes((other if bin(k).count("1") & 1 else one)[0] for k in range(n))


@pytest.mark.parametrize("pair", [(b"A", b"a"), (b"1", b"q"), (b"x", b"y"), (b"(", b"Z")])
def test_chosen_texts_have_hashes_of_their_own(pair):
    """Texts in which polynomials modulo a power of two agree for many bases: fresh tables tell them apart."""
    core, one, two = bpe.load(RANKS, P.PATTERN), *pair
    for n in (128, 256, 512):
        a, b = thue_morse(n, one, two), thue_morse(n, two, one)
        for k in range(50):
            made = bpe.ChunkTable(core.encode_chunks, cut=False)
            raw, begin = np.frombuffer(a + b, np.uint8), np.array([0, n])
            keys = made._hashes(raw, begin, begin + n)
            assert (keys[0] != keys[1]).all()
            if k < 2:
                flat, counts = made.encode([a, b])
                assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [by_library(a.decode()), by_library(b.decode())]


def test_special_strings_as_the_library_has_them():
    """By its default they stand for their ids wherever they are, and part the text."""
    end = "<|endoftext|>"
    texts = [f"hello {end} world", end, f"a{end}", f" {end}", f"{end}{end} b", f"x.{end}\ny", "<|endoftext", f"one\ntwo {end}\n three", "plain text", f"a {end}", " b", f"{end} c"]
    lib = tokenfile.library_table(P.path("byte_bpe_50k.json"))
    for made in (lib, bpe.ChunkTable(lib.encode_chunks, 4, whole=lib.whole)):
        for batch in (texts, texts[::-1], *([t] for t in texts)):
            flat, counts = made.encode([t.encode() for t in batch])
            assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == own_ids(batch)
    assert own_ids(texts)[0] == [31373, 220, 50256, 995]
