import hashlib
import random
import re
import sys

import public_tokenizers as P
import pytest
import tiktoken
import zstandard
from plain import components_by_force, near, words
from test_text import base_rules, base_spans

from lattica.llm import bpe, quality

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def plainly_kept(t):
    raw = (t or "").encode()
    if base_rules(t)[5]:
        return False
    size = lambda b: len(zstandard.ZstdCompressor(level=3).compress(b)) / len(b)
    band = [(lo, hi) for least, lo, hi in quality.BANDS if len(raw) >= least]
    chunks = [raw[i : i + 4096] for i in range(0, len(raw) - 4095, 4096)] if len(raw) >= 8192 else []
    outside = sum(not 0.12 <= size(c) <= 0.76 for c in chunks)
    return (not band or band[-1][0] <= size(raw) <= band[-1][1]) and outside <= len(chunks) / 2


def rows_and_items():
    rng = random.Random(21)
    base = words(rng, 120)
    items = [words(rng, 30) for _ in range(3)]
    texts = [base, base, near(rng, base, 1), near(rng, base, 90), words(rng, 60) + " " + items[0] + " " + words(rng, 60), None, "", "few words", "again and again " * 400]
    texts += [words(rng, 80) + " token = abcdef123456 and " + words(rng, 5), "password: hunter22x é " + words(rng, 70), words(rng, 5000), words(rng, 90)]
    return [(k, t, "en", f"s{k % 2}", None if t is None else len(t)) for k, t in enumerate(texts)], items


def test_run_equals_a_plain_version(spark, tmp_path):
    rows, items = rows_and_items()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    left = [r for r in rows if plainly_kept(r[1])]
    one = {x[0] for x in components_by_force([(r[0], r[1]) for r in left]) if x[3]}
    left = [r for r in left if r[0] in one and not any(i in r[1] for i in items)]
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = []
    for k, t, lang, source, _ in left:
        for b, _, e in reversed(base_spans(t)):
            t = t[:b] + "[SECRET]" + t[e:]
        ids = library.encode_ordinary(t)
        want.append((k, lang, source, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(want) and [w[0] for w in sorted(want)] == [0, 3, 9, 10, 11, 12]


def test_stages_keep_the_columns(spark, tmp_path):
    rows, items = rows_and_items()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_library_does_not_import_these_operators():
    import subprocess

    code = "import lattica.plans.catalog, lattica.sources.snapshots, lattica.streaming.tracker, sys; sys.exit(any(m.startswith('lattica.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], cwd=re.sub(r"/tests/llm.*", "", __file__)).returncode == 0
