"""Prefix tries of conversations: which openings are shared, by how many, and what sharing them would save.

One shuffle brings the turns of 100 conversations and of their common base together, in order; a scan gives each rebuilt conversation's
turns with the digest of the sequence up to each (its node). Of equal sequences one stays, with their number. Sequences are dealt by the
digest of their first turn, and tries are built from them inside applyInPandas. First-turn groups over a limit of rows are dealt again by
the turn after the longest opening that all of the group share, round by round, until each fits; such openings are chains of nodes whose
sums come from the groups below, last round first.
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import chain, groupby, islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_ids, partitions, tune, written

#: Conversations of a block, whose multiple of it is their base; and one more than the most turns taken from the base.
BLOCK, HEADS = 100, 6
#: Rows of sequences that a trie is built from at most, and that a task gets on average.
LIMIT = 50_000
#: Rows of a batch.
ROWS = 10_000
#: The node of the empty sequence.
ROOT = bytes(16)

_PATH = "conv long, depth long, node binary, first binary, chars long, last boolean"
_ENDS = "node binary, n long, conv long, ends_sha256 string"
_NODE = "node binary, depth long, conv long, parent_conv long, n_convs long, n_children long, n_leaves long, saved long, up binary"


def _rows(batches, names):
    for batch in batches:
        yield from zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names), strict=True)


def _batches(rows, schema: pa.Schema):
    rows = iter(rows)
    while some := list(islice(rows, ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


def shared_turns(conv: int) -> int:
    """How many turns a conversation takes from its base."""
    return zlib.crc32(str(conv).encode()) % HEADS


def _walk(conv, turns):
    """(conv, depth, node, first node, chars, whether it's the last) of each turn; depth 0 alone for no turns."""
    node, first, held, depth = ROOT, ROOT, (conv, 0, ROOT, ROOT, 0), 0
    for digest, chars in turns:
        if depth:
            yield *held, False
        node, depth = hashlib.blake2b(node + digest, digest_size=16).digest(), depth + 1
        first = node if depth == 1 else first
        held = (conv, depth, node, first, chars)
    yield *held, True


def _rebuilt(batches):
    """The turns of rebuilt conversations from rows (base, conv, digest, chars), sorted, a base before the others of its block."""

    def paths():
        for base, block in groupby(_rows(batches, ("base", "conv", "digest", "chars")), key=lambda r: r[0]):
            head = []

            def kept(turns, head=head):
                for t in turns:
                    if len(head) < HEADS:
                        head.append(t)
                    yield t

            for conv, rows in groupby(block, key=lambda r: r[1]):
                turns, h = (r[2:] for r in rows), shared_turns(conv)
                yield from _walk(conv, kept(turns) if conv == base else chain(head[:h], islice(turns, h, None)))

    types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_())
    return _batches(paths(), pa.schema(list(zip(("conv", "depth", "node", "first", "chars", "last"), types, strict=True))))


def _ends(batches):
    """Of each node of a partition sorted by (node, conv): how many end there, the least, and the digest of all, which are not held."""

    def sums():
        for node, rows in groupby(_rows(batches, ("node", "conv")), key=lambda r: r[0]):
            sha, n, least = hashlib.sha256(), 0, None
            for _, conv in rows:
                sha.update(f",{conv}".encode() if n else str(conv).encode())
                n, least = n + 1, conv if least is None else least
            yield node, n, least, sha.hexdigest()

    return _batches(sums(), pa.schema([("node", pa.binary()), ("n", pa.int64()), ("conv", pa.int64()), ("ends_sha256", pa.string())]))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv, depth, node, first, chars, last of each turn of the rebuilt conversations, and of depth 0 for those without turns."""
    turn = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    named = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = named.select((F.col("conv") - F.col("conv") % BLOCK).alias("base"), "conv", "turn", F.unhex(F.substring(F.sha2(turn, 256), 1, 32)).alias("digest"), F.length("text").cast("long").alias("chars"))
    tune(conversations.sparkSession, ROWS)
    return rows.repartition("base").sortWithinPartitions("base", F.col("conv") != F.col("base"), "conv", F.asc_nulls_first("turn"), "digest").mapInArrow(_rebuilt, _PATH)


def _tries(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of the tries of some keys; `up` only of the tops."""
    rows = rows.sort_values(["key", "conv", "depth"], kind="stable")
    below: list[dict] = []
    node, depth, conv, above, n, chars, up = [], [], [], [], [], [], []
    tops: dict = {}
    last = -1
    for key, at, over, c, d, x, size, w in zip(*(rows[k].tolist() for k in ("key", "at", "up", "conv", "depth", "node", "chars", "weight")), strict=True):
        among = tops if d == at else below[last]
        if (k := among.get(x)) is None:
            k = among[x] = len(node)
            node.append(x), depth.append(d), conv.append(c), above.append(-1 if d == at else last), n.append(0), chars.append(size), up.append(over if d == at else None), below.append({})
        n[k] += w
        conv[k] = min(conv[k], c)
        last = k
    leaves, saved = [0] * len(node), [0] * len(node)
    # postorder without recursion: what a stack gives from the tops down, backwards
    stack, order = list(tops.values()), []
    while stack:
        order.append(k := stack.pop())
        stack += below[k].values()
    for k in reversed(order):
        leaves[k] = sum(leaves[x] for x in below[k].values()) or 1
        saved[k] = (n[k] - 1) * chars[k] + sum(saved[x] for x in below[k].values())
    parent = pd.array([None if a < 0 else conv[a] for a in above], "Int64")
    return pd.DataFrame({"node": node, "depth": depth, "conv": conv, "parent_conv": parent, "n_convs": n, "n_children": [len(b) for b in below], "n_leaves": leaves, "saved": saved, "up": up})


def _openings(rows: DataFrame) -> DataFrame:
    """Of each key the nodes that all its sequences share from `at` on: key, at, up, depth, node, n, conv, chars."""
    levels = rows.groupBy("key", "at", "up", "depth").agg(F.count("*").alias("seqs"), F.sum("weight").alias("n"), F.min("conv").alias("conv"), F.min("node").alias("node"), F.max("node").alias("other"), F.max("chars").alias("chars"))
    of = Window.partitionBy("key")
    parted = F.when((F.col("node") != F.col("other")) | (F.col("seqs") < F.max("seqs").over(of)), F.col("depth"))
    return levels.withColumn("parted", parted).withColumn("parted", F.min("parted").over(of)).filter("parted is null or depth < parted").drop("parted", "other", "seqs")


def build(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node of the trie of rebuilt
    conversations (conv_id and depth name a node).

    Turns are in the order of `turn`, null first; turns with one number by the SHA-256 of role and text, repeated rows are turns of their
    own. Null role and text are empty strings. Rows with a null conv_id are left out. Other columns aren't read. The root holds all
    conversations; an empty table has none and gives no rows."""
    spark = conversations.sparkSession
    paths = written(rebuilt(conversations))
    last = paths.filter("last").select("node", "conv").repartition("node").sortWithinPartitions("node", "conv")
    tune(spark, ROWS)
    ends = written(last.mapInArrow(_ends, _ENDS))
    # of equal sequences one goes on, with their number as its weight
    seqs = by_ids(paths.filter("depth > 0").drop("last"), ends.select("conv", F.col("n").alias("weight")), "inner", "conv")
    active = written(seqs.withColumnRenamed("first", "key").withColumns({"at": F.lit(1).cast("long"), "up": F.lit(ROOT)}))
    fits, openings = [], []
    while True:
        over = written(active.groupBy("key").agg(F.count("*").alias("rows")).filter(F.col("rows") > limit).select("key"))
        if not over.limit(1).count():
            fits.append(active)
            break
        fits.append(by_ids(active, over, "left_anti", "key"))
        large = written(by_ids(active, over, "left_semi", "key"))
        openings.append(written(_openings(large)))
        tails = openings[-1].groupBy("key").agg(F.max("depth").alias("end"), F.max_by("node", "depth").alias("tail"))
        rest = written(by_ids(large.drop("at", "up"), tails, "inner", "key").filter("depth > end").withColumnsRenamed({"end": "at", "tail": "up"}).withColumn("at", F.col("at") + 1).drop("key"))
        active = written(rest.join(rest.filter("depth = at").select("conv", F.col("node").alias("key")), "conv"))
    small = fits[0]
    for f in fits[1:]:
        small = small.unionByName(f)
    buckets = max(partitions(spark), -(-paths.count() // limit))
    dealt = small.select("key", "at", "up", "conv", "depth", "node", "chars", "weight", F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"))
    forest = written(dealt.groupBy("bucket").applyInPandas(lambda rows: _tries(rows.drop(columns="bucket")), _NODE))

    every = ends.agg(F.sum("n").alias("n_convs"), F.min("conv").alias("conv")).first()
    tops = forest.filter("up is not null").select("up", "n_leaves", "saved")
    chains = []
    for opening in reversed(openings):
        sums = tops.groupBy("up").agg(F.count("*").alias("n_below"), F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("below")).withColumnRenamed("up", "tail")
        tails = opening.groupBy("key").agg(F.max("depth").alias("end"), F.max_by("node", "depth").alias("tail"))
        tails = tails.join(sums, "tail", "left").drop("tail").fillna(0, ["n_below", "below"]).fillna(1, ["leaves"])
        down = Window.partitionBy("key").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
        own = F.sum((F.col("n") - 1) * F.col("chars")).over(down)
        top = F.col("depth") == F.col("at")
        nodes = opening.join(tails, "key").select("node", "depth", "conv", F.when(~top, F.col("conv")).alias("parent_conv"), F.col("n").alias("n_convs"), F.when(F.col("depth") == F.col("end"), F.col("n_below")).otherwise(1).alias("n_children"), F.col("leaves").alias("n_leaves"), (own + F.col("below")).alias("saved"), F.when(top, F.col("up")).alias("up"))
        chains.append(written(nodes))
        tops = tops.unionByName(chains[-1].filter("up is not null").select("up", "n_leaves", "saved"))
    below = tops.filter(F.col("up") == F.lit(ROOT)).agg(F.count("*").alias("n_children"), F.coalesce(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved"))
    if every["n_convs"] is None:
        below = below.limit(0)
    nil = F.lit(None).cast("long")
    root = below.select(F.lit(ROOT).alias("node"), F.lit(0).cast("long").alias("depth"), F.lit(every["conv"]).cast("long").alias("conv"), nil.alias("parent_conv"), F.lit(every["n_convs"]).cast("long").alias("n_convs"), "n_children", "n_leaves", "saved", F.lit(None).cast("binary").alias("up"))
    nodes = forest
    for c in chains:
        nodes = nodes.unionByName(c)
    if chains:
        inner = chains[0].select(F.col("node").alias("up"), F.col("conv").alias("_above"))
        for c in chains[1:]:
            inner = inner.unionByName(c.select(F.col("node").alias("up"), F.col("conv").alias("_above")))
        nodes = by_ids(nodes, written(inner), "left", "up")
    else:
        nodes = nodes.withColumn("_above", nil)
    above = F.coalesce("parent_conv", "_above", F.when(F.col("up").isNotNull(), F.lit(every["conv"])))
    nodes = nodes.withColumn("parent_conv", above).drop("_above").unionByName(root)
    out = nodes.join(ends.select("node", "ends_sha256"), "node", "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
