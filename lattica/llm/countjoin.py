"""Jaccard join of word n-gram sets with count vectors: shingles are hashed to groups, a set is the point of its counts by group, a tree
over points bounds overlaps by summed coordinate minima, and what survives is held against the full sets.

Where to look is decided without loss. Two sets of x and y shingles that link differ in at most (100 - p) (x + y) / (100 + p) of them, so
of more groups than that, some hold the same shingles in both. Each set therefore has a key for each of its groups, made from what the
group holds; linked sets share a key. The number of groups follows from the size: sizes are cut to classes, a pair is looked for among the
groups of its larger set's class, and a set near its class's end has keys for the next class, too. There are a fifth more groups than needed:
a set may skip empty groups, and keys that very many sets share (as passages do that are common), while what it skips is less than that
surplus. Sets that skip more have keys for all their groups.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_ids, column_out, join_salted, mix, offsets, pieces, tune, written
from .minhash import components, labelled, shingles, similar, verified

#: Words of a shingle.
SHINGLE = 4
#: The next class begins at this multiple of a class's least size; groups for each one needed.
GROWTH, SURPLUS = 1.5, 1.2
#: Bits of a key that tell the class, and as many classes (sizes up to 10^10).
CLASS_BITS = 6
#: Sets sharing a key from which on it's skipped by sets that can.
HOT = 64
#: Points of a leaf, and children of a node.
FAN = 16
#: Rows of a block on average when a bucket's points are searched.
BLOCK = 1024

SKETCH = T.StructType().add("n_shingles", "long").add("set_hash", "binary").add("own", "binary").add("next", "binary").add("spare", "integer").add("next_spare", "integer").add("keys", "binary")
_ROW = T.StructType().add("key", "long").add("id", "long")
_SHARED = T.StructType().add("key", "long").add("id", "long").add("head", "long").add("hot", "boolean")
_PAIR = T.StructType().add("a", "long").add("b", "long")


class Classes:
    """Classes of sizes for one limit: least size, most differences of a pair, groups."""

    def __init__(self, percent: int):
        differ = lambda n: (100 - percent) * 2 * n // (100 + percent)
        least = [1, next(n for n in range(1, 1000) if differ(n))]
        while len(least) <= 1 << CLASS_BITS:
            least.append(max(least[-1] + 1, int(least[-1] * GROWTH)))
        self.percent, self.least = percent, np.array(least, np.int64)
        self.differ = np.array([differ(n - 1) for n in least[1:]], np.int64)
        self.groups = np.ceil(SURPLUS * (self.differ + 1)).astype(np.int64)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.least, sizes, "right") - 1

    def also_next(self, sizes: np.ndarray) -> np.ndarray:
        """Whether sets of these sizes can link with some of the next class."""
        return 100 * sizes >= self.percent * self.least[self.of(sizes) + 1]


def group_keys(sums: np.ndarray, kind: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Keys from what groups hold, telling the class in their last bits."""
    k = kind.astype(np.uint64)
    h = mix(sums ^ mix(k << np.uint64(48) | group.astype(np.uint64)))
    return h >> np.uint64(CLASS_BITS) << np.uint64(CLASS_BITS) | k


def points(sets: list[np.ndarray], kind: np.ndarray, classes: Classes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts and keys of each set's groups, flat, and where each set begins."""
    at = offsets(classes.groups[kind])
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    h = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    # the hashes' middle bits choose the group, so that groups are filled alike whatever their number
    place = at[row] + ((h >> np.uint64(20) & np.uint64(0xFFFFFFFF)) * classes.groups[kind][row].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    counts, sums = np.bincount(place, minlength=int(at[-1])), np.zeros(int(at[-1]), np.uint64)
    np.add.at(sums, place, mix(h ^ np.uint64(0x5851F42D4C957F2D)))
    of = np.repeat(np.arange(len(sets)), np.diff(at))
    return counts, group_keys(sums, kind[of], np.arange(len(of)) - at[of]), at


def sketch(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id and SKETCH of each row: size, digest of the set, its points in its own and the next class (null if it can't link there), how many
    more groups than empty ones it may skip in each, and the keys of its filled groups."""
    classes = Classes(percent)
    tune(docs.sparkSession)

    def run(batches):
        for part, texts in pieces(batches):
            sets = shingles(texts, SHINGLE)
            n = np.array([len(s) for s in sets], np.int64)
            own, nxt, spare, next_spare, keys = ([None] * len(sets) for _ in range(5))
            for up, put, room in ((0, own, spare), (1, nxt, next_spare)):
                kind = classes.of(np.maximum(n, 1)) + up
                use = np.flatnonzero((n > 0) & (classes.also_next(np.maximum(n, 1)) if up else classes.differ[kind] > 0))
                counts, key, at = points([sets[k] for k in use], kind[use], classes)
                for i, k in enumerate(use.tolist()):
                    c, filled = counts[at[i] : at[i + 1]], counts[at[i] : at[i + 1]] > 0
                    # a byte for each count; should one not fit (hashes fill groups with some five each), the point bounds nothing
                    put[k] = (c if c.max() < 256 else np.full(len(c), 255)).astype(np.uint8).tobytes()
                    room[k] = int(len(c) - classes.differ[kind[k]] - (len(c) - filled.sum()))
                    keys[k] = (keys[k] or b"") + key[at[i] : at[i + 1]][filled].tobytes()
            hashes = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            new = [pa.array(n), pa.array(hashes, pa.binary()), pa.array(own, pa.binary()), pa.array(nxt, pa.binary()), pa.array(spare, pa.int32()), pa.array(next_spare, pa.int32()), pa.array(keys, pa.binary())]
            yield column_out(part, ["doc_id"], dict(zip(SKETCH.names, new, strict=True)))

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], *SKETCH]))


def _np(batch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _key_rows(batches):
    for batch in batches:
        keys = batch.column(batch.schema.get_field_index("keys")).to_pylist()
        ids = np.repeat(_np(batch, "id"), [len(k) // 8 for k in keys])
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(keys), np.int64)), pa.array(ids)], names=["key", "id"])


def _shared_keys(batches, most: int):
    """Of a partition sorted by (key, id) the rows of keys that several ids have, with the least id, and whether over `most` have it. Holds so
    many ids of one key at most."""
    key, ids, head, hot = 0, np.zeros(0, np.int64), 0, False
    for batch in batches:
        if not batch.num_rows:
            continue
        k, i = np.concatenate([np.full(len(ids), key), _np(batch, "key")]), np.concatenate([ids, _np(batch, "id")])
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (i[1:] != i[:-1])
        k, i = k[new], i[new]
        at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        size, heads = np.diff(np.append(at, len(k))), i[at]
        over = size > most
        if hot and k[0] == key:
            over[0], heads[0] = True, head
        key, head, hot = k[-1], heads[-1], bool(over[-1])
        shown = over | (size > 1)
        if not hot:
            shown[-1], ids = False, i[at[-1] :]
        else:
            ids = np.zeros(0, np.int64)
        run = np.repeat(np.arange(len(at)), size)
        keep = shown[run]
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (k, i, heads[run], over[run])], names=_SHARED.names)
    if len(ids) > 1:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(ids), key), ids, np.full(len(ids), ids[0]), np.zeros(len(ids), bool))], names=_SHARED.names)


def _shared(rows: DataFrame) -> DataFrame:
    return written(rows.repartition("key").sortWithinPartitions("key", "id").mapInArrow(partial(_shared_keys, most=HOT), _SHARED))


def may_link(bound: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of x and y elements can link that share at most `bound` of them."""
    return bound * (100 + percent) >= percent * (x + y)


class CountTree:
    """An R-tree over count vectors, packed by splitting at the median of the coordinate that varies most. A node has its points' largest
    counts and least size, from which the overlap with any of them is bounded."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, percent: int):
        self.vectors, self.sizes, self.percent = vectors, sizes, percent
        self.nodes: list[tuple[np.ndarray, np.ndarray, list[int], np.ndarray]] = []  # maxima and least sizes of children, nodes or points
        self.root = self._packed(np.arange(len(sizes))) if len(sizes) else None

    def _packed(self, rows: np.ndarray) -> int:
        """The node of some points; the depth of calls is the tree's height."""
        if len(rows) <= FAN:
            self.nodes.append((self.vectors[rows], self.sizes[rows], [], rows))
            return len(self.nodes) - 1
        parts = [rows]
        while len(parts) < FAN and len(parts[0]) > FAN:
            part = parts.pop(0)
            by = int(np.argmax(self.vectors[part].var(axis=0)))
            part = part[np.argsort(self.vectors[part, by], kind="stable")]
            parts += [part[: len(part) // 2], part[len(part) // 2 :]]
        below = [self._packed(p) for p in parts]
        self.nodes.append((np.array([self.vectors[p].max(axis=0) for p in parts]), np.array([self.sizes[p].min() for p in parts]), below, rows[:0]))
        return len(self.nodes) - 1

    def near(self, vector: np.ndarray, size: int) -> np.ndarray:
        """The points whose sets can link with the vector's."""
        out, todo = [], [self.root] if self.root is not None else []
        while todo:
            most, least, below, rows = self.nodes[todo.pop()]
            bound = np.minimum(most, vector).sum(axis=1, dtype=np.int64)
            keep = np.flatnonzero(may_link(bound, least, size, self.percent))
            if below:
                todo += [below[k] for k in keep]
            else:
                out.append(rows[keep])
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def _bounded(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose points leave a link possible."""
    side = lambda x: sets.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("own").alias(f"own{x}"), F.col("next").alias(f"next{x}"))

    def run(batches):
        for batch in batches:
            owna, nexta, ownb, nextb = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("owna", "nexta", "ownb", "nextb"))
            bound = np.zeros(batch.num_rows, np.int64)
            for k, (p, q, r, s) in enumerate(zip(owna, nexta, ownb, nextb, strict=True)):
                for x, y in ((p, r), (q, r), (p, s)):
                    if x is not None and y is not None and len(x) == len(y):
                        bound[k] = np.minimum(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)).sum(dtype=np.int64)
                        break
            keep = may_link(bound, _np(batch, "na"), _np(batch, "nb"), percent)
            yield pa.RecordBatch.from_arrays([pa.array(_np(batch, x)[keep]) for x in ("a", "b")], names=["a", "b"])

    tune(pairs.sparkSession, 1000)
    joined = join_salted(pairs, side("a"), "a", "b").join(side("b"), "b")
    return written(joined.select("a", "b", "na", "nb", "owna", "nexta", "ownb", "nextb").mapInArrow(run, _PAIR).distinct())


#: Links that a task takes on average when those that say nothing new are left out.
FOREST = 200_000


def _spanning(batches):
    """Of a partition's links those that join what isn't joined by the ones before."""
    top: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := top.setdefault(x, x)) != x:
            top[x] = x = top[up]
        return x

    for batch in batches:
        keep = []
        for a, b in zip(_np(batch, "a").tolist(), _np(batch, "b").tolist(), strict=True):
            p, q = root(a), root(b)
            keep.append(p != q)
            if p != q:
                top[max(p, q)] = min(p, q)
        yield batch.filter(pa.array(keep, pa.bool_()))


def _forest(links: DataFrame) -> DataFrame:
    """Links with the same components, fewer than each task's share has ids: a crowd has many links that say the same."""
    return written(links.select("a", "b").repartition(max(1, -(-links.count() // FOREST))).mapInArrow(_spanning, _PAIR))


def _parts(shared: DataFrame, labels: DataFrame, alone: str) -> tuple[DataFrame, DataFrame]:
    """Members of shared keys with their components, and of each key how they part: largest component, its n, all n, parts. Without the
    members that `alone` says, which have met all others already."""
    now = written(by_ids(shared.filter(alone).select("key", "id", "head"), labels, "left", "id").withColumn("component", F.coalesce("component", "id")))
    of = now.groupBy("key", "component").agg(F.count("*").alias("n"))
    most = of.groupBy("key").agg(F.max(F.struct("n", "component")).alias("largest"), F.sum("n").alias("n"), F.count("*").alias("parts"))
    return now, most.filter("parts > 1").select("key", F.col("largest.component").alias("largest"), F.col("largest.n").alias("n_largest"), "n")


def _searched(shared: DataFrame, labels: DataFrame, sets: DataFrame, classes: Classes) -> DataFrame:
    """Pairs of sets that share a key and aren't in one component, as far as their points let them link. The points of a bucket over FAN are
    searched by trees: what isn't of its largest component is looked for among all, blocks of the one meeting blocks of the other, bounded
    on average, so that a row goes to as many places as the other side has blocks. A smaller bucket would be one leaf: its pairs are
    bounded one by one, each once however many buckets have it."""
    now, parts = _parts(shared, labels, "id <> head")
    small = by_ids(now, written(parts.filter(F.col("n") <= FAN).select("key")), "left_semi", "key").select("key", "id", "component")
    other = small.select("key", F.col("id").alias("b"), F.col("component").alias("apart"))
    pairs = small.join(other, "key").filter("id < b and component <> apart").select(F.col("id").alias("a"), "b").distinct()
    pairs = _bounded(written(pairs), sets, classes.percent)
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    mixed = written(parts.filter(F.col("n") > FAN).select("key", "largest", blocks(F.col("n")).alias("blocks"), blocks(F.col("n") - F.col("n_largest")).alias("stray_blocks")))
    rows = by_ids(now, mixed, "inner", "key").withColumn("stray", F.col("component") != F.col("largest"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.hash("id"), F.col(n))
    left = rows.filter("stray").withColumns({"lo": own("stray_blocks"), "side": F.lit(0)}).withColumn("hi", every("blocks"))
    right = rows.withColumns({"hi": own("blocks"), "side": F.lit(1)}).withColumn("lo", every("stray_blocks"))
    names = ["key", "lo", "hi", "side", "stray", "id", "component"]
    at = written(left.select(names).unionByName(right.select(names)))
    at = at.join(sets.select("id", "n_shingles", "own", "next"), "id")
    mask, groups, percent = (1 << CLASS_BITS) - 1, classes.groups, classes.percent

    def run(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        ids, comp, side, n = (t.column(c).to_numpy() for c in ("id", "component", "side", "n_shingles"))
        stray = t.column("stray").to_numpy(zero_copy_only=False)
        width = int(groups[t.column("key")[0].as_py() & mask])
        chosen = [p if p is not None and len(p) == width else q for p, q in zip(t.column("own").to_pylist(), t.column("next").to_pylist(), strict=True)]
        vectors = np.frombuffer(b"".join(chosen), np.uint8).reshape(-1, width)
        left, right, out = np.flatnonzero(side == 0), np.flatnonzero(side == 1), []
        tree = CountTree(vectors[right], n[right], percent)
        for i in left.tolist():
            j = right[tree.near(vectors[i], n[i])]
            j = j[(comp[j] != comp[i]) & (~stray[j] | (ids[j] > ids[i]))]  # of two strays the lesser one finds the other
            out += [sorted((int(ids[i]), int(x))) for x in ids[j]]
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return written(at.groupBy("key", "lo", "hi").applyInArrow(run, _PAIR).union(pairs).distinct())


def _crowded(hot: DataFrame, labels: DataFrame, sets: DataFrame, docs: DataFrame, classes: Classes) -> DataFrame:
    """Links that join the components of crowds: of sets that keys over HOT connect, in so many keys each that they're brought together once
    for the crowd. What isn't of a crowd's largest component is looked for among all, block by block as in `_searched`; what trees find is held
    against the full sets there, and once two components are joined in a block, no more pairs of theirs are looked at. So at most one
    link less than a block has components leaves it."""
    now, parts = _parts(hot, labels, "true")
    rows = written(by_ids(now, written(parts.select("key")), "left_semi", "key"))
    # a key's least member, which its rows name, connects them
    crowd = components(_forest(rows.select(F.col("head").alias("a"), F.col("id").alias("b")).filter("a <> b").distinct()))
    own = rows.select("id", "component").distinct().join(crowd.withColumnRenamed("component", "crowd"), "id")
    most = own.groupBy("crowd", "component").agg(F.count("*").alias("n")).groupBy("crowd").agg(F.max(F.struct("n", "component")).alias("largest"), F.sum("n").alias("n"), F.count("*").alias("parts")).filter("parts > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    most = written(most.select("crowd", F.col("largest.component").alias("largest"), blocks(F.col("n")).alias("blocks"), blocks(F.col("n") - F.col("largest.n")).alias("stray_blocks")))
    own = by_ids(written(own), most, "inner", "crowd").withColumn("stray", F.col("component") != F.col("largest"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    at = lambda n: F.pmod(F.hash("id"), F.col(n))
    left = own.filter("stray").withColumns({"lo": at("stray_blocks"), "side": F.lit(0)}).withColumn("hi", every("blocks"))
    right = own.withColumns({"hi": at("blocks"), "side": F.lit(1)}).withColumn("lo", every("stray_blocks"))
    names = ["crowd", "lo", "hi", "side", "id", "component"]
    places = written(left.select(names).unionByName(right.select(names)))
    ids = written(places.select(F.col("id").alias("doc_id")).distinct())
    texts = by_ids(docs, ids, "left_semi").withColumnRenamed("doc_id", "id")
    full = places.join(sets.select("id", "n_shingles", "own", "next"), "id").join(texts, "id")
    percent, kinds = classes.percent, {int(g): k for k, g in enumerate(classes.groups)}

    def run(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        ids, comp, side, n = (t.column(c).to_numpy() for c in ("id", "component", "side", "n_shingles"))
        text, known, top, out = t.column("text"), {}, {}, []

        def full_set(k: int) -> np.ndarray:
            if k not in known:
                known[k] = shingles([(text[k].as_py() or "").encode()], SHINGLE)[0]
            return known[k]

        def root(c: int) -> int:
            while top.get(c, c) != c:
                c = top[c]
            return c

        by_kind: dict[int, dict[int, bytes]] = {}
        for column in ("own", "next"):
            for k, p in enumerate(t.column(column).to_pylist()):
                if p is not None:
                    by_kind.setdefault(kinds[len(p)], {})[k] = p
        for points_of in by_kind.values():
            members = np.array(list(points_of))
            vectors = np.frombuffer(b"".join(points_of.values()), np.uint8).reshape(len(members), -1)
            left, right = np.flatnonzero(side[members] == 0), np.flatnonzero(side[members] == 1)
            tree = CountTree(vectors[right], n[members[right]], percent)
            for i in left.tolist():
                a = int(members[i])
                for b in members[right[tree.near(vectors[i], n[a])]].tolist():
                    p, q = root(int(comp[a])), root(int(comp[b]))
                    if p != q and similar(full_set(a), full_set(b), percent):
                        top[max(p, q)] = min(p, q)
                        out.append(sorted((int(ids[a]), int(ids[b]))))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return written(full.groupBy("crowd", "lo", "hi").applyInArrow(run, _PAIR).distinct())


def joined(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of each row.

    Documents whose sets A and B of SHINGLE-word shingles have 100 * |A and B| >= percent * |A or B| are linked; component_id is the
    least doc_id that links reach, itself included. A text with fewer words has its whole sequence as one shingle; null texts and those without
    words have none and stay alone. Rows that share a doc_id are one document: each row has its own n_shingles, and what one of them
    is linked with, all are. Rows with a null doc_id are left out. Other columns aren't read. An empty table gives no rows."""
    spark, classes = docs.sparkSession, Classes(percent)
    docs = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = written(sketch(docs, percent))
    narrow = base.select("doc_id", "n_shingles", "set_hash")
    same = written(narrow.filter("set_hash is not null").groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    # one row of each class of equal sets goes on
    sets = by_ids(base, same.filter("n > 1").select("set_hash", "rep"), "left", "set_hash").filter("set_hash is not null and (rep is null or rep = doc_id)").drop("rep", "set_hash").withColumnRenamed("doc_id", "id")
    tune(spark)
    shared = _shared(sets.filter("keys is not null").select("id", "keys").mapInArrow(_key_rows, _ROW))
    # what sets with room skip, and the empty groups of those without
    kind = F.col("key").bitwiseAND((1 << CLASS_BITS) - 1)
    hots = shared.filter("hot").groupBy("id", kind.alias("kind")).agg(F.count("*").alias("hots"))
    least = F.array(*[F.lit(int(x)).cast("long") for x in classes.least])
    own = F.size(F.filter(least, lambda x: x <= F.col("n_shingles"))) - 1
    room = F.explode(F.array(F.struct(own.cast("long").alias("kind"), F.col("spare").alias("spare")), F.struct((own + 1).cast("long").alias("kind"), F.col("next_spare").alias("spare"))))
    spares = sets.select("id", room.alias("r")).select("id", "r.*").filter("spare is not null")
    tight = written(spares.join(hots, ["id", "kind"], "left").filter(F.coalesce("hots", F.lit(0)) >= F.col("spare")).select("id", "kind").distinct())
    every = written(by_ids(shared.filter("hot").withColumn("kind", kind), tight, "left_semi", ["id", "kind"]).drop("kind"))
    groups = classes.groups

    def empty_rows(batches):
        for batch in batches:
            k, i = [], []
            for x, c, p, q in zip(*(batch.column(batch.schema.get_field_index(name)).to_pylist() for name in ("id", "kind", "own", "next")), strict=True):
                v = np.frombuffer(next(y for y in (p, q) if y is not None and len(y) == groups[c]), np.uint8)
                none = np.flatnonzero(v == 0)
                k.append(group_keys(np.zeros(len(none), np.uint64), np.full(len(none), c), none).view(np.int64)), i.append(np.full(len(none), x))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(y) if y else np.zeros(0, np.int64)) for y in (k, i)], names=["key", "id"])

    tune(spark)
    empties = _shared(by_ids(sets.select("id", "own", "next"), tight, "inner", "id").select("id", "kind", "own", "next").mapInArrow(empty_rows, _ROW))
    shared = shared.filter("not hot").unionByName(every).unionByName(empties)
    shared = written(shared)
    sets = written(by_ids(sets.select("id", "n_shingles", "own", "next"), written(shared.select("id").distinct()), "left_semi", "id"))
    # a bucket's least member meets all; what is apart then is searched
    links = _forest(verified(_bounded(written(shared.filter("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()), sets, percent), docs, percent, SHINGLE))
    labels = components(links)
    if shared.filter("hot").limit(1).count():
        links = _forest(links.union(_crowded(shared.filter("hot"), labels, sets, docs, classes)))
        labels = components(links)
    more = _searched(shared.filter("not hot"), labels, sets, classes)
    if more.limit(1).count():
        labels = components(_forest(links.union(verified(more, docs, percent, SHINGLE))))
    return labelled(narrow, same, labels)
