"""Near-duplicates by SetSketch: exponentially spaced truncated minima, banded registers, a joint likelihood, then a check on full sets.

One pass over the texts gives each document's shingle set as a digest and a sketch. Documents with equal sets form a class; only
classes go on. Bands of registers give buckets. A small bucket gives its pairs; a large one gives pairs with its least member (and
after those are linked, what is apart from its largest component is held against the rest). Pairs whose joint likelihood has its peak under a
floor go; the others are checked on their full sets. Links are joined to components by label propagation with pointer jumping.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_ids, column_out, join_salted, lookup_hot, mix, offsets, pieces, tune, written

#: Words of a shingle.
SHINGLE = 5
#: Registers, and the sketch's base, rate and largest value (two bytes).
REGISTERS, BASE, RATE, LARGEST = 256, 1.001, 20.0, 65535
#: Registers of a band, and bands. Two sets of similarity 0.85 share no band with probability 9e-7.
BAND, BANDS = 7, 36
#: Pairs go on if their joint likelihood peaks at this similarity at least; 4.5 standard deviations under 0.85.
FLOOR = 0.75
#: Bands and floor are set for limits from here on; at lower ones pairs would be missed.
LEAST_PERCENT = 85
#: Buckets up to this size give all their pairs; larger ones go the other way.
SMALL = 24
#: Rows, and shingles, of a block on average when what a large bucket still keeps apart is compared.
BLOCK, BLOCK_SHINGLES = 256, 500_000

SKETCH = T.StructType().add("n_shingles", "long").add("set_hash", "binary").add("registers", "binary")


def shingles(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles: A-Z in lower case, words between ASCII white space; with fewer words
    than `size`, the whole sequence is one shingle; without words, none."""
    words = [t.lower().split() for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    at = offsets(n)
    total = int(at[-1])
    get = xxhash.xxh3_64_intdigest
    h = mix(np.fromiter((get(x) for w in words for x in w), np.uint64, total))
    out, few = [], n < size
    if total >= size:
        s = np.full(total - size + 1, size, np.uint64)
        for k in range(size):
            s = mix(s ^ h[k : k + len(s)])
    for k in range(len(texts)):
        if not n[k]:
            out.append(np.zeros(0, np.uint64))
        elif few[k]:
            one = np.array([n[k]], np.uint64)
            for x in h[at[k] : at[k + 1]]:
                one = mix(one ^ x)
            out.append(one)
        else:
            out.append(np.unique(s[at[k] : at[k + 1] - size + 1]))
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row of registers for each set (all 0 for an empty one).

    Each element has a Poisson process of rate RATE on each register, drawn from its hash in ascending order; a register keeps the
    least point of all elements as floor(1 - log_BASE(point)), cut to two bytes. So sketches of unions are the registers' maxima.
    Points beyond what can still matter for a set of that size aren't drawn; if a register stays empty, the limit is doubled."""
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    sizes = np.array([len(s) for s in sets], np.int64)
    todo, limit = np.flatnonzero(sizes), math.log(REGISTERS) + 4.0
    while len(todo):
        got = _sketch([sets[k] for k in todo], limit / (RATE * sizes[todo]))
        full = (got >= 0).all(axis=1)
        out[todo[full]] = got[full]
        todo, limit = todo[~full], limit * 2
    return out


def _sketch(sets: list[np.ndarray], limit: np.ndarray) -> np.ndarray:
    regs = np.full(len(sets) * REGISTERS, -1, np.int32)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    state, x, most = np.concatenate(sets), np.zeros(len(row)), limit[row]
    scale, ln_b = 1 / (REGISTERS * RATE), math.log(BASE)
    while len(state):
        state = mix(state)
        x = x - scale * np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        alive = x <= most
        state, x, most, row = state[alive], x[alive], most[alive], row[alive]
        value = np.clip(np.floor(1 - np.log(x) / ln_b), 0, LARGEST).astype(np.int32)
        np.maximum.at(regs, row * REGISTERS + (state & np.uint64(REGISTERS - 1)).astype(np.int64), value)
    return regs.reshape(-1, REGISTERS)


def bands(registers: np.ndarray) -> np.ndarray:
    """A key for each row and band."""
    r = registers[:, : BAND * BANDS].astype(np.uint64).reshape(len(registers), BANDS, BAND)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), r.shape[:2]).copy()
    for k in range(BAND):
        key = mix(key ^ r[:, :, k])
    return key


def likely(more: np.ndarray, less: np.ndarray, n1: np.ndarray, n2: np.ndarray, floor: float = FLOOR) -> np.ndarray:
    """Whether the joint likelihood of similarity J peaks at `floor` or above, from the registers in which the first sketch is
    larger and those in which it's smaller. It's concave in J, so its slope at `floor` tells. P(larger) = p(u - v J), P(smaller) =
    p(v - u J), p(x) = -log_b(1 - x (b - 1) / b), where u and v are the shares of the sizes."""
    n1, n2 = n1.astype(float), n2.astype(float)
    u, v, c, ln_b = n1 / (n1 + n2), n2 / (n1 + n2), (BASE - 1) / BASE, math.log(BASE)
    possible = np.minimum(n1, n2) >= floor * np.maximum(n1, n2)
    x, y = np.maximum(u - v * floor, 1e-12), np.maximum(v - u * floor, 1e-12)
    p, q = -np.log1p(-x * c) / ln_b, -np.log1p(-y * c) / ln_b
    dp, dq = c / ln_b / (1 - x * c), c / ln_b / (1 - y * c)
    same = REGISTERS - more - less
    slope = -more * v * dp / p - less * u * dq / q + same * (v * dp + u * dq) / np.maximum(1 - p - q, 1e-12)
    return possible & (slope >= 0)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = np.intersect1d(a, b, assume_unique=True).size
    return bool(len(a) and len(b)) and 100 * both >= percent * (len(a) + len(b) - both)


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id and SKETCH of each row; set_hash and registers are null for texts without words."""
    tune(docs.sparkSession)

    def run(batches):
        for part, texts in pieces(batches):
            sets = shingles(texts)
            regs = sketches(sets)
            new = {
                "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "set_hash": pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                "registers": pa.array([r.tobytes() if len(s) else None for r, s in zip(regs, sets, strict=True)], pa.binary()),
            }
            yield column_out(part, ["doc_id"], new)

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], *SKETCH]))


def _np(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _registers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(name)).to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _band_rows(batches):
    for batch in batches:
        ids = _np(batch, "rep")
        keys = bands(_registers(batch, "registers"))
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(ids, BANDS)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(ids)))], names=["key", "id", "band"])


_ROW = T.StructType().add("key", "long").add("id", "long").add("band", "integer")
_FOUND = T.StructType().add("a", "long").add("b", "long").add("key", "long").add("band", "integer")


def _bucket_pairs(batches):
    """Pairs (a, b) of each bucket of a partition sorted by (band, key, id): all in a small one, those with the least member in a large
    one, of which the members (a null) go out too. Holds SMALL ids at most, however large a bucket is."""
    at, head, count = None, [], 0
    a, b, key, band = [], [], [], []

    def close():
        if 1 < count <= SMALL:
            for i, x in enumerate(head):
                for y in head[i + 1 :]:
                    a.append(x), b.append(y), key.append(None), band.append(None)

    def out():
        batch = pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(key, pa.int64()), pa.array(band, pa.int32())], names=_FOUND.names)
        for x in (a, b, key, band):
            x.clear()
        return batch

    for batch in batches:
        keys, ids, of = _np(batch, "key"), _np(batch, "id"), _np(batch, "band")
        start = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])]))
        end = np.append(start[1:], len(keys))
        for s, e in zip(start.tolist(), end.tolist(), strict=True):
            here = (int(of[s]), int(keys[s]))
            if here != at:
                close()
                at, head, count = here, [], 0
            for x in ids[s:e].tolist():
                count += 1
                if count <= SMALL:
                    head.append(x)
                    continue
                if count == SMALL + 1:
                    for y in head:
                        a.append(None), b.append(y), key.append(here[1]), band.append(here[0])
                    for y in head[1:]:
                        a.append(head[0]), b.append(y), key.append(None), band.append(None)
                a.append(None), b.append(x), key.append(here[1]), band.append(here[0])
                a.append(head[0]), b.append(x), key.append(None), band.append(None)
        if len(a) > 20_000:
            yield out()
    close()
    yield out()


def _prune(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose sketches make a link likely."""
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("registers").alias(f"r{x}"), F.col("n_shingles").alias(f"n{x}"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                p, q = _registers(batch, "ra"), _registers(batch, "rb")
                keep = likely((p > q).sum(1), (p < q).sum(1), _np(batch, "na"), _np(batch, "nb"))
                yield pa.RecordBatch.from_arrays([pa.array(_np(batch, x)[keep]) for x in ("a", "b")], names=["a", "b"])

    tune(pairs.sparkSession, 2000)
    joined = join_salted(pairs, side("a"), "a", "b").join(side("b"), "b")
    return written(joined.select("a", "b", "ra", "rb", "na", "nb").mapInArrow(run, _PAIR))


_PAIR = T.StructType().add("a", "long").add("b", "long")


def verified(pairs: DataFrame, docs: DataFrame, percent: int, size: int = SHINGLE) -> DataFrame:
    """The pairs that are links, by their full sets."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    needed = by_ids(docs.select("doc_id", "text"), written(ids), "left_semi")
    tune(pairs.sparkSession, 200)

    def run(batches):
        for batch in batches:
            known: dict[int, np.ndarray] = {}

            def sets(ids: str, texts: str, batch=batch, known=known) -> list[np.ndarray]:
                n, col = _np(batch, ids).tolist(), batch.column(batch.schema.get_field_index(texts))
                out = []
                for k, x in enumerate(n):
                    t = col[k].as_buffer()
                    seen = (x, xxhash.xxh3_64_intdigest(t) if t is not None else 0)
                    if seen not in known:
                        if len(known) > 200:
                            known.clear()
                        known[seen] = shingles([t.to_pybytes() if t is not None else b""], size)[0]
                    out.append(known[seen])
                return out

            keep = [similar(x, y, percent) for x, y in zip(sets("a", "ta"), sets("b", "tb"), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(_np(batch, x)[np.array(keep, bool)]) for x in ("a", "b")], names=["a", "b"])

    side = lambda x: needed.select(F.col("doc_id").alias(x), F.col("text").alias(f"t{x}"))
    joined = join_salted(pairs, side("a"), "a", "b").join(side("b"), "b").select("a", "b", "ta", "tb")
    return written(joined.mapInArrow(run, _PAIR).distinct())


def components(links: DataFrame) -> DataFrame:
    """id and component (the least id that links reach) of every linked id.

    Each round takes the least label of the neighbours and then the label's label, until nothing changes; rounds grow with the
    logarithm of the longest path. The table of a round is written to the shared folder."""
    both = written(links.select(F.col("a").alias("id"), F.col("b").alias("to")).union(links.select("b", "a")).distinct())
    labels = written(both.groupBy("id").agg(F.min("to").alias("to")).select("id", F.least("id", "to").alias("component")))
    while True:
        near = both.join(labels.select(F.col("id").alias("to"), F.col("component").alias("near")), "to").groupBy("id").agg(F.min("near").alias("near"))
        step = labels.join(near, "id").select("id", F.least("component", "near").alias("next"), "component")
        jump = labels.select(F.col("id").alias("next"), F.col("component").alias("far"))
        new = written(step.join(jump, "next", "left").select("id", F.least("next", "far").alias("component"), (F.least("next", "far") != F.col("component")).alias("changed")))
        labels = new.select("id", "component")
        if not new.filter("changed").limit(1).count():
            return labels


def _apart(hot: DataFrame, classes: DataFrame, labels: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links within large buckets between what isn't in one component yet: strays, which aren't of the bucket's largest component, are held
    against all of the bucket. Blocks of strays meet blocks of all rows, both bounded on average in rows and shingles, so a row goes to
    as many places as the other side has blocks. There, pairs that share no earlier band are held against the likelihood and then by
    full sets. Only links leave."""
    now = by_ids(hot, labels, "left", "id").withColumn("component", F.coalesce("component", "id"))
    now = written(now.join(classes.select(F.col("rep").alias("id"), "n_shingles"), "id"))
    of = now.groupBy("band", "key", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    most = of.groupBy("band", "key").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.max(F.struct("n", "component", "s"))["s"].alias("s_largest"), F.max("n").alias("n_largest"), F.sum("n").alias("n"), F.sum("s").alias("s"))
    size = lambda n, s: F.ceil(F.greatest(n / BLOCK, s / BLOCK_SHINGLES)).cast("int")
    mixed = written(most.filter("n > n_largest").select("band", "key", "largest", size(F.col("n"), F.col("s")).alias("blocks"), size(F.col("n") - F.col("n_largest"), F.col("s") - F.col("s_largest")).alias("stray_blocks")))
    rows = by_ids(now, mixed, "inner", ["band", "key"]).withColumn("stray", F.col("component") != F.col("largest"))
    rows = written(rows.join(classes.select(F.col("rep").alias("id"), "registers"), "id"))
    ids = written(rows.select(F.col("id").alias("doc_id")).distinct())
    texts = by_ids(docs.select("doc_id", "text"), ids, "left_semi").withColumnRenamed("doc_id", "id")
    rows = rows.join(texts, "id")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.hash("id"), F.col(n))
    left = rows.filter("stray").withColumns({"lo": own("stray_blocks"), "side": F.lit(0)}).withColumn("hi", every("blocks"))
    right = rows.withColumns({"hi": own("blocks"), "side": F.lit(1)}).withColumn("lo", every("stray_blocks"))
    names = ["band", "key", "lo", "hi", "side", "stray", "id", "component", "n_shingles", "registers", "text"]
    rows = left.select(names).unionByName(right.select(names))

    def run(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        ids, comp, side, n = (t.column(c).to_numpy() for c in ("id", "component", "side", "n_shingles"))
        stray = t.column("stray").to_numpy(zero_copy_only=False)
        regs = np.frombuffer(b"".join(t.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        band, left, right = t.column("band")[0].as_py(), np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        key, text, sets = bands(regs), t.column("text"), {}

        def full(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = shingles([(text[k].as_py() or "").encode()])[0]
            return sets[k]

        out = []
        for i in left.tolist():
            j = right[(comp[right] != comp[i]) & (~stray[right] | (ids[right] > ids[i]))]
            if len(j):
                j = j[~(key[j, :band] == key[i, :band]).any(axis=1)]
                j = j[likely((regs[i] > regs[j]).sum(1), (regs[i] < regs[j]).sum(1), np.full(len(j), n[i]), n[j])]
                out += [sorted((int(ids[i]), int(ids[k]))) for k in j.tolist() if similar(full(i), full(k), percent)]
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return written(rows.groupBy("band", "key", "lo", "hi").applyInArrow(run, _PAIR).distinct())


def labelled(rows: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of rows (doc_id, n_shingles, set_hash), from their classes (set_hash, rep, n) and the labels of reps."""
    # classes of one that nothing is linked with need no lookup; a class' rows may be many
    of_class = by_ids(classes.select("set_hash", "rep", "n"), labels.withColumnRenamed("id", "rep"), "left", "rep")
    of_class = written(of_class.select("set_hash", F.coalesce("component", "rep").alias("component_id"), "n"))
    total = rows.count()
    looked = lookup_hot(rows.filter("set_hash is not null"), of_class, "set_hash", "n", total).select("doc_id", "n_shingles", "component_id")
    return looked.union(rows.filter("set_hash is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row.

    Documents with 100 * |A and B| >= percent * |A or B| are linked; component_id is the least doc_id that links reach, itself
    included; kept says whether it's the row's own. Null and empty texts have no shingles and stay alone. Rows that share a
    doc_id are one document: each row has its own n_shingles, and what one of them is linked with, all are. Rows with a null
    doc_id are left out. Other columns aren't returned. An empty table gives no rows. percent is LEAST_PERCENT or more."""
    if percent < LEAST_PERCENT:
        raise ValueError(f"bands and floor miss pairs at limits under {LEAST_PERCENT} percent: {percent}")
    spark = docs.sparkSession
    docs = docs.filter("doc_id is not null")
    base = written(sketch(docs))
    filled = base.filter("set_hash is not null")
    classes = written(filled.groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.min_by("registers", "doc_id").alias("registers"), F.first("n_shingles").alias("n_shingles")))
    tune(spark)
    rows = classes.select("rep", "registers").mapInArrow(_band_rows, _ROW)
    rows = rows.repartition("band", "key").sortWithinPartitions("band", "key", "id")
    tune(spark, 20_000)
    found = written(rows.mapInArrow(_bucket_pairs, _FOUND))
    pairs = written(found.filter("a is not null and a <> b").select("a", "b").distinct())
    links = verified(_prune(pairs, classes), docs, percent)
    labels = components(links)
    hot = found.filter("a is null").select(F.col("b").alias("id"), "key", "band")
    if hot.limit(1).count():
        more = _apart(hot, classes, labels, docs, percent)
        if more.limit(1).count():
            labels = components(links.union(more))
    return labelled(base.select("doc_id", "n_shingles", "set_hash"), classes, labels).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def keep_one(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of docs whose doc_id is the least of its component, with all their columns; rows with a null doc_id stay."""
    gone = written(near_duplicates(docs, percent).filter("not kept").select("doc_id").distinct())
    return by_ids(docs, gone, "left_anti")
