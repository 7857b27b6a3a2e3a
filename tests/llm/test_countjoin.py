"""The n-gram join against all pairs of full sets, and the parts that let it skip pairs."""

import random

import numpy as np
import pytest
from plain import near, words

from lattica.llm import countjoin
from lattica.llm.minhash import shingles

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def by_force(rows, percent=85):
    sets = [set(shingles([(t or "").encode()], 4)[0].tolist()) for _, t in rows]
    parent = {k: k for k, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = root(rows[i][0]), root(rows[j][0])
                parent[max(x, y)] = min(x, y)
    return sorted((k, len(s), root(k)) for (k, _), s in zip(rows, sets, strict=True))


def test_odd_documents(spark, odd_docs, odd_rows, empty_docs):
    extra = odd_docs.unionByName(spark.createDataFrame([(None, "no id", None, None, None)], DOCS)).selectExpr("*", "1 as id", "2 as key", "3 as head", "4 as own")
    rows = [(k, t) for k, t, *_ in odd_rows if k is not None]
    assert sorted(map(tuple, countjoin.joined(extra).collect())) == by_force(rows)
    assert countjoin.joined(empty_docs).count() == 0


def corpus(seed):
    """Chains of near copies at the limit, a common passage, a crowd of copies, short texts."""
    rng = random.Random(seed)
    passage, out = words(rng, 40, 10**6), []
    for n in (5, 7, 9, 10, 11, 30, 33, 80, 200, 700):
        base = words(rng, n)
        out += [base, *(near(rng, base, c) for c in (0, 1, 1, 2, 3)), base + " " + words(rng, max(1, n // 9)), " ".join(base.split()[: n - n // 10])]
    for _ in range(60):
        out.append(words(rng, rng.randrange(0, 30), 10**6) + " " + passage + " " + words(rng, rng.randrange(30), 10**6))
    crowd = words(rng, 120)
    out += [near(rng, crowd, rng.randrange(6)) for _ in range(60)]
    out += [words(rng, 4, 3) for _ in range(30)]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("hot", "block", "percent"), [(200, 1024, 85), (4, 7, 85), (1, 1000, 90), (6, 16, 70)])
def test_all_links_are_found(spark, monkeypatch, hot, block, percent):
    """Few sets a key and small blocks: skipped keys, sets without room, searched buckets in blocks."""
    monkeypatch.setattr(countjoin, "HOT", hot)
    monkeypatch.setattr(countjoin, "BLOCK", block)
    rows = corpus(hot)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, countjoin.joined(docs, percent).collect())) == by_force(rows, percent)


def test_linked_sets_share_a_key():
    """At the limit of what may differ, whatever the sizes, a pair has a group alike, or both skip as much as they may."""
    rng = np.random.default_rng(4)
    classes = countjoin.Classes(85)
    for _ in range(400):
        x = int(rng.integers(6, 400))
        y = int(rng.integers(x, x * 100 // 85 + 1))
        both = -(-85 * (x + y) // 185)
        if both > x:
            continue
        pool = rng.integers(0, 2**63, x + y - both).astype(np.uint64)
        a, b = np.sort(pool[:x]), np.sort(np.concatenate([pool[:both], pool[x:]]))
        kind = classes.of(np.array([y]))
        counts, keys, _ = countjoin.points([a, b], np.repeat(kind, 2), classes)
        g = int(classes.groups[kind[0]])
        alike, empty = keys[:g] == keys[g:], counts[:g] == 0
        assert alike.sum() >= g - classes.differ[kind[0]]
        assert np.minimum(counts[:g], counts[g:]).sum() >= both
        assert (alike & ~empty).any() or empty.sum() >= g - classes.differ[kind[0]]
        assert classes.of(np.array([x]))[0] == kind[0] or classes.also_next(np.array([x]))[0]


def test_tree_finds_what_all_pairs_give():
    rng = np.random.default_rng(6)
    vectors = rng.poisson(2, (600, 24)).astype(np.uint16)
    for k in range(300, 600):
        vectors[k] = np.maximum(vectors[k - 300].astype(int) + rng.integers(-1, 2, 24) * (rng.random(24) < 0.2), 0)
    sizes = vectors.sum(axis=1, dtype=np.int64)
    tree = countjoin.CountTree(vectors, sizes, 85)
    seen = 0
    for k in range(0, 600, 7):
        bound = np.minimum(vectors, vectors[k]).sum(axis=1, dtype=np.int64)
        want = np.flatnonzero(countjoin.may_link(bound, sizes, sizes[k], 85))
        assert sorted(tree.near(vectors[k], sizes[k]).tolist()) == want.tolist()
        seen += len(want)
    assert seen > 100
    assert len(countjoin.CountTree(vectors[:0], sizes[:0], 85).near(vectors[0], 3)) == 0


def test_keys_of_many_batches():
    import pyarrow as pa

    rows = [(1, 1), (2, 1), (2, 1), (2, 5), *((3, k) for k in range(9)), (4, 2), (5, 7), (5, 7), (6, 1), (6, 2), (6, 3)]
    want = [(k, i, min(x for y, x in rows if y == k), len({x for y, x in rows if y == k}) > 3) for k, i in sorted(set(rows)) if len({x for y, x in rows if y == k}) > 1]
    for size in (1, 2, 3, 5, 50):
        batches = [pa.record_batch({"key": pa.array([k for k, _ in rows[n : n + size]]), "id": pa.array([i for _, i in rows[n : n + size]])}) for n in range(0, len(rows), size)]
        got = [tuple(r.values()) for b in countjoin._shared_keys(batches, 3) for r in b.to_pylist()]
        assert sorted(got) == want


def test_forest_keeps_components(spark, monkeypatch):
    rng = random.Random(3)
    links = [(rng.randrange(60), 60 + rng.randrange(60)) for _ in range(400)] + [(200 + k, 201 + k) for k in range(30)]
    monkeypatch.setattr(countjoin, "FOREST", 1000)
    df = spark.createDataFrame(links, "a long, b long")
    left = countjoin._forest(df)
    whole = lambda x: sorted(map(tuple, countjoin.components(x).collect()))
    assert whole(left) == whole(df) and left.count() < 160
    assert countjoin._forest(df.limit(0)).count() == 0
