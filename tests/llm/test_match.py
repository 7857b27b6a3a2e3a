import random
import re

import numpy as np
import pytest
from plain import components_by_force, near, words
from pyspark.sql import functions as F

from lattica.llm import decontaminate, minhash


def test_near_duplicates_equal_brute_force(spark, odd_docs, odd_rows, empty_docs):
    docs = odd_docs.withColumn("kept", F.lit("mine")).withColumn("set_hash", F.lit(1))
    got = sorted(map(tuple, minhash.near_duplicates(docs).collect()))
    assert got == components_by_force([(r[0], r[1]) for r in odd_rows if r[0] is not None])
    assert minhash.near_duplicates(empty_docs).count() == 0
    left = minhash.keep_one(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {x[0] for x in got if x[3]}


@pytest.mark.parametrize("small", [24, 3])
def test_chains_and_large_groups(spark, small, monkeypatch):
    """Chains whose ends aren't similar, groups around a text, and pairs close to the limit on both sides."""
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(8)
    texts = []
    for _ in range(4):
        t = words(rng, 150)
        for _ in range(25):
            texts.append(t)
            t = near(rng, t, 1)
    for changes in (1, 2, 3):
        t = words(rng, 160)
        texts += [near(rng, t, changes) for _ in range(40)]
    texts += [words(rng, 40) for _ in range(60)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted(map(tuple, got)) == components_by_force(rows)


def test_sketches_merge_and_tell_similarity():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 2**63, 3000, dtype=np.uint64), rng.integers(0, 2**63, 500, dtype=np.uint64)
    x, y, both = minhash.sketches([np.unique(a), np.unique(b), np.unique(np.concatenate([a, b]))])
    assert (np.maximum(x, y) == both).all()
    for j in (0.6, 0.85, 0.95):
        n = 1000
        shared = int(2 * n * j / (1 + j))
        kept = []
        for _ in range(40):
            z = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
            p, q = minhash.sketches([z[:n], np.concatenate([z[:shared], z[n : 2 * n - shared]])])
            kept.append(bool(minhash.likely(np.array([(p > q).sum()]), np.array([(p < q).sum()]), np.array([n]), np.array([n]))[0]))
        assert all(kept) if j >= 0.85 else not any(kept)


def test_limits_that_the_bands_would_miss_are_refused(spark, empty_docs):
    with pytest.raises(ValueError):
        minhash.near_duplicates(empty_docs, 84)
    with pytest.raises(ValueError):
        minhash.keep_one(empty_docs, 80)


ITEMS = [
    (1, "Alice buys 12 apples at the old market for 3 dollars each and then sells 5 of them to Bob near the river."),
    (2, "the quick brown fox jumps over the lazy dog while seven sleepy cats watch from a warm wooden fence nearby"),
    (3, "two words"),
    (4, None),
]


def test_templates_find_verbatim_and_reparameterised_items(spark, empty_docs):
    pad = "Some plain sentence stands here first. "
    docs = [
        (1, pad + ITEMS[0][1] + " And more."),
        (2, pad + ITEMS[0][1].replace("12", "48").replace("Bob", "Carol").replace("dollars", "euros")),
        (3, pad + ITEMS[1][1].upper()),
        (4, pad + "the quick brown fox jumps over nothing else at all today because it is tired of all that"),
        (5, None),
        (6, ""),
        (7, pad + "Alice buys 12 pears in a new shop."),
        (8, pad + ITEMS[1][1] + " " + ITEMS[0][1]),
    ]
    table = spark.createDataFrame(docs + docs[:1], "doc_id long, text string").withColumn("item_id", F.lit("mine"))
    bench = spark.createDataFrame(ITEMS + ITEMS[:1], "item_id long, text string")
    got = {r.doc_id: (r.item_ids, r.reparameterised) for r in decontaminate.contaminated(table, bench).collect()}
    assert got == {1: ([1], False), 2: ([1], True), 3: ([2], False), 8: ([1, 2], False)}
    assert sorted(r.doc_id for r in decontaminate.remove(table, bench).collect()) == [4, 5, 6, 7]
    assert decontaminate.contaminated(empty_docs, bench).count() == 0
    assert decontaminate.contaminated(table, bench.limit(0)).count() == 0


def test_slots_must_be_consistent(spark):
    item = [(1, "if x has 7 coins and y has 7 stones then how many more than 7 do they both hold in total now")]
    docs = [(1, item[0][1].replace("7", "9")), (2, "if x has 8 coins and y has 9 stones then how many more than 5 do they both hold in total now")]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(item, "item_id long, text string"))
    assert [r.doc_id for r in got.collect()] == [1]


def test_short_and_slot_dense_items_are_found(spark):
    items = [
        (1, "which river crosses the old town"),
        (2, "Sum 12 14 16 18 20 22 24 26 28 30"),
        (3, "Compute 17 + 25"),
        (4, "Seven tall trees stand behind the small house"),
        (5, "Anna met Bob, Carl met Dora, Emil met Fritz"),
    ]
    pad = "some plain sentence stands before it and goes on with "
    docs = [(k, pad + t + " and then the text goes on for quite a while") for k, t in items] + [(6, pad * 3), (7, pad + items[1][1].replace("2", "3") + " " + pad), (8, items[0][1])]
    docs.append((9, pad + "Which river crosses the old 5 town"))
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id: (r.item_ids, r.reparameterised) for r in got.collect()} == {**{k: ([k], False) for k in range(1, 6)}, 8: ([1], False)}


def test_short_items_with_other_names_are_found_in_long_documents(spark):
    items, docs = [(1, "which river crosses the town of Bern")], [(1, "some plain sentence asks: which river crosses the town of Graz and ends")]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_ids, r.reparameterised) for r in got] == [(1, [1], True)]


def test_near_verbatim_copies_with_one_of_equal_values_changed_are_found(spark):
    item = [(1, "if x has 7 coins and y has 7 stones then how many more of them do both hold in total when all is counted again")]
    docs = [(1, "so " + item[0][1].replace("7 coins", "8 coins") + " indeed")]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(item, "item_id long, text string"))
    assert [(r.doc_id, r.item_ids) for r in got.collect()] == [(1, [1])]


def test_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(4)
    items = [(k, words(rng, 30)) for k in range(50)]
    docs = [(k, words(rng, 20) + " " + items[k % 50][1] + " " + words(rng, 20)) for k in range(0, 100, 3)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {k: [k % 50] for k, _ in docs}
    for most in (1_000_000, 300):
        monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", most)
        assert {r.doc_id: r.item_ids for r in decontaminate.contaminated(d, b).collect()} == want


def test_verbatim_items_of_the_small_tables(spark, sf_dir):
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    norm = lambda t: " ".join(re.findall(r"\S+", t.lower()))
    items = [norm(r.text) for r in bench.collect()]
    want = {r.doc_id for r in docs.collect() if any(x in norm(r.text or "") for x in items)}
    assert {r.doc_id for r in decontaminate.contaminated(docs, bench).collect()} == want


@pytest.mark.parametrize("seed", range(6))
def test_items_of_all_lengths_and_slots_are_found(seed):
    """Items of 3 to 40 tokens with no slots to all, planted verbatim and with other values: all with two literals or eight tokens are found, and only
    those of another item's template besides."""
    rng = random.Random(seed)
    items, planted, want = [], [], []
    for k in range(60):
        n, share = rng.randrange(3, 41), rng.choice([0, 0.2, 0.5, 0.8, 1])
        slots = [rng.random() < share for _ in range(n)]
        used = rng.sample(range(1000, 9999), n)
        other = rng.sample(range(10_000, 99_999), n)
        words = [f"lit{rng.randrange(10**6)}" for _ in range(n)]
        items.append(" ".join(str(u) if s else w for s, u, w in zip(slots, used, words, strict=True)))
        again = rng.random() < 0.7
        body = " ".join(str(o if again else u) if s else w for s, u, o, w in zip(slots, used, other, words, strict=True))
        planted.append(f"some words before {body} and after")
        if not again or n >= 8 or sum(not s for s in slots) >= 2 or n == sum(not s for s in slots):
            want.append(k)
    index = decontaminate.Index(list(range(60)), [t.encode() for t in items])
    found = {(k, int(index.ids[i])) for k, i, *_ in index.find(*decontaminate.Templates()([t.encode() for t in planted]))}
    assert all((k, k) in found for k in want)
    clean = [" ".join(f"plain{rng.randrange(10**6)}" for _ in range(200)).encode() for _ in range(5)]
    assert not index.find(*decontaminate.Templates()(clean))


def test_few_literals_need_the_whole_template_and_consistent_slots(spark):
    bench = spark.createDataFrame([(1, "What is 7 plus 9?"), (2, "12 34 56"), (3, "3 km 4 km 5 km 3 km 6 km and 7 km")], "item_id long, text string")
    rows = ["He asked: What is 70 plus 90? he said", "what is 70 plus cats", "99 98 97 in a row", "12 34 56", "x 30 km 40 km 50 km 30 km 60 km and 70 km y", "x 30 km 40 km 50 km 31 km 60 km and 70 km y", "What is 8 plus 8?"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {(r.doc_id, tuple(r.item_ids), r.reparameterised) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(0, (1,), True), (3, (2,), False), (4, (3,), True), (6, (1,), True)}
