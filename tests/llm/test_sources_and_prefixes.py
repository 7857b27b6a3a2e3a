"""Divergence of sources and prefix tries against their SQL and plain versions."""

import hashlib
import random
import zlib

import duckdb
import pyarrow as pa
import pytest

from lattica.llm import divergence, prefixtrie
from lattica.llm.sql import ORACLE

TURNS = "conv_id long, turn long, role string, text string"


def by_sql(name, **tables):
    con = duckdb.connect()
    for t, df in tables.items():
        con.register(t, df.toArrow())
    rel = con.sql(ORACLE[name])
    names = sorted(rel.columns)
    return sorted(map(repr, ([r[rel.columns.index(c)] for c in names] for r in rel.fetchall())))


def rows_of(df):
    return sorted(repr([r[c] for c in sorted(df.columns)]) for r in df.collect())


def test_audit_of_odd_documents(spark, odd_docs, empty_docs):
    many = odd_docs.unionByName(odd_docs).unionByName(odd_docs).unionByName(odd_docs)
    got = rows_of(divergence.audit(many))
    assert got == by_sql("op13_divergence", documents=many)
    assert any("'pair'" in x for x in got)
    assert divergence.audit(empty_docs).count() == 0


def plain_audit(rows):
    """Python integers, all terms of all pairs."""
    import re

    found, docs, groups = {}, {}, {(lang or "", source or "") for _, _, lang, source in rows}
    for k, (_, text, lang, source) in enumerate(rows):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low):
            found[lang or "", source or "", w] = found.get((lang or "", source or "", w), 0) + 1
            docs.setdefault((lang or "", w), set()).add(k)
    out = []
    for lang in {a for a, _ in groups}:
        sources = sorted(b for a, b in groups if a == lang)
        kept = sorted(w for (a, w), ids in docs.items() if a == lang and len(ids) >= 10)
        n = {s: {w: found.get((lang, s, w), 0) for w in kept} for s in sources}
        total = {s: sum(n[s].values()) for s in sources}
        p = {s: {w: 1 + 10**9 * (n[s][w] + 2) // (total[s] + 2 * len(kept)) for w in kept} for s in sources}
        every = {w: sum(n[s][w] for s in sources) for w in kept}
        q = {w: 1 + 10**9 * (every[w] + 2) // (sum(every.values()) + 2 * len(kept)) for w in kept}
        f = lambda x, y: (x - y) * (x - y) // (x + y)
        for s in sources:
            pair = [(sum(f(p[s][w], p[o][w]) for w in kept), o) for o in sources if o != s]
            term = [(f(p[s][w], q[w]), w) for w in kept if n[s][w] and p[s][w] > q[w]]
            for part, items in (("pair", pair), ("term", term)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, x, v, k) for k, (v, x) in enumerate(items, 1) if part == "pair" or k <= 10]
    return sorted(out)


def test_audit_against_integers_over_cut_runs(spark, monkeypatch):
    """Small batches and flushes: runs of one term span batches, tasks and flushes."""
    rng = random.Random(8)
    rows = [(rng.choice([None, k]), " ".join(rng.choice(["Été", "the", "THE", "日本", "x1y", *"abcdefgh", "straße"]) for _ in range(rng.randrange(30))), rng.choice(["en", None, "de"]), rng.choice([None, "s1", "s2", "Ünter", "s3"])) for k in range(400)]
    rows += [(1000 + k, None if k % 2 else "1 2 3", "empty", "one") for k in range(3)] + [(2000, "a few", "empty", "two")]
    rows += [(3000 + k, f"only{k} same", "single", "s") for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    monkeypatch.setattr(divergence, "RUN_ROWS", 7)
    monkeypatch.setattr(divergence, "HELD", 20)
    extra = docs.selectExpr("*", "1 as term", "2 as value", "3 as total", "'x' as item")
    got = sorted(tuple(r) for r in divergence.audit(extra).collect())
    assert got == plain_audit(rows)


def test_scaled_is_exact():
    import numpy as np

    rng = random.Random(2)
    pairs = [(c, rng.randrange(c, 8 * 10**15)) for c in (rng.randrange(1, 8 * 10**15) for _ in range(300))] + [(5, 5), (0, 7)]
    got = divergence.scaled(np.array([c for c, _ in pairs]), np.array([t for _, t in pairs]))
    assert got.tolist() == [1 + 10**9 * c // t for c, t in pairs]


def plain_trie(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16], role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in turns.items()}
    full = {}
    for c, ts in own.items():
        h, rest = zlib.crc32(str(c).encode()) % 6, abs(c) % 100
        base = c - (rest if c >= 0 else -rest)
        full[c] = tuple(own.get(base, [])[:h] + ts[h:])
    members = {}
    for c, ts in full.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
    kids = {x: [y for y in members if len(y) == len(x) + 1 and y[: len(x)] == x] for x in members}
    out = []
    for x, ids in members.items():
        under = [y for y in members if y[: len(x)] == x]
        here = sorted(c for c in ids if len(full[c]) == len(x))
        saved = sum((len(members[y]) - 1) * len(y[-1][1]) for y in under if y)
        out.append((min(ids), len(x), min(members[x[:-1]]) if x else None, len(ids), len(kids[x]), sum(not kids[y] for y in under), saved, hashlib.sha256(",".join(map(str, here)).encode()).hexdigest()))
    return sorted(out, key=repr)


def odd_turns(seed):
    rng = random.Random(seed)
    rows = [(rng.choice([0, 100, 200, -100, 5000]) + rng.choice([*range(6), -7, 99]), rng.choice([None, 0, 1, 2, 3, 4]), rng.choice([None, "user", "assistant"]), rng.choice([None, "", "hi", "é日", "same first turn"])) for _ in range(160)]
    rows += [(9000 + c, t, "user", "shared opening" if t < 7 else f"{c % 4}") for c in range(30) for t in range(9)]  # a long common opening
    rows += [(7000, t, "user", "one long conversation") for t in range(60)]
    rows += [(None, 1, "user", "no id"), rows[0], rows[0], (123456, 1, "user", "short"), (8100, 0, "user", "a base alone"), (8100 + 42, 0, "user", "taken from the base")]
    return rows


@pytest.mark.parametrize("limit", [1, 5, 40, 50_000])
def test_tries_against_plain_and_sql(spark, limit):
    rows = odd_turns(limit)
    table = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 as node", "2 as key", "3 as base").repartition(3)
    out = prefixtrie.build(table, limit)
    got = sorted(map(tuple, out.collect()), key=repr)
    assert got == plain_trie(rows)
    assert sum(r[1] == 0 for r in got) == 1
    if limit == 40:
        assert rows_of(out) == by_sql("op12_prefix_trie", conversations=table)


def test_empty_and_turnless(spark):
    assert prefixtrie.build(spark.createDataFrame([], TURNS)).count() == 0
    alone = [c for c in range(100, 200) if zlib.crc32(str(c).encode()) % 6][:2]  # no base, one turn that is left out
    got = [tuple(r) for r in prefixtrie.build(spark.createDataFrame([(c, 0, "user", "gone") for c in alone if c != 100], TURNS)).collect()]
    ids = sorted(c for c in alone if c != 100)
    assert got == [(ids[0], 0, None, len(ids), 0, 1, 0, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())]


def test_ends_are_streamed():
    names = {"node": pa.array([b"a"] * 3 + [b"b"]), "conv": pa.array([-5, 7, 100, 2])}
    out = [r for b in prefixtrie._ends([pa.record_batch({k: v.slice(0, 2) for k, v in names.items()}), pa.record_batch({k: v.slice(2) for k, v in names.items()})]) for r in b.to_pylist()]
    assert [(r["node"], r["n"], r["conv"]) for r in out] == [(b"a", 3, -5), (b"b", 1, 2)]
    assert out[0]["ends_sha256"] == hashlib.sha256(b"-5,7,100").hexdigest()
