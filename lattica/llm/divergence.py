"""Divergence of sources by sort-based streaming: rows of (lang, term, source, document) in runs, scanned with constant memory.

A task first sums what it reads to short runs (a term's occurrences and documents in one group since the last flush). The runs are
dealt by (lang, term) and sorted by (lang, term, source, document); a scan over them gives each term's documents and, of kept terms,
the counts of its sources. With the groups' totals known, a second scan over the kept runs gives each term's values and partial sums for
the pairs of sources that share the term; what a pair owes to terms that one or neither of its sources has follows from the counts alone.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_ids, pieces, tune, written

#: Documents of a language that must hold a term, and terms listed for each group.
LEAST_DOCS, TOP = 10, 10
#: What probabilities are multiplied by (a power of 1000), and what is added to each count.
SCALE_STEPS, ADDED = 3, 2
#: Terms that a task holds before it emits them.
HELD = 250_000
#: Rows of a batch of runs.
RUN_ROWS = 20_000

#: Letters of terms: A-Z as a-z, a-z and all bytes of other scripts; all else parts terms.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_RUN = "lang string, term string, source string, document long, docs long, n long"
_KEPT = "lang string, term string, source string, n long, first int"
_FOUND = "lang string, source string, part string, item string, value long"


def terms(text: bytes) -> list[bytes]:
    """The terms of a text, in order."""
    return text.translate(_LETTERS).split()


def scaled(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * count / total), exact for 0 <= count <= total < 9 * 10^15."""
    out, rest = np.zeros_like(count), count
    for _ in range(SCALE_STEPS):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


def value(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _scaled(count: Column, total: Column) -> Column:
    """`scaled` as a column."""
    out, rest = F.lit(0).cast("long"), count
    for _ in range(SCALE_STEPS):
        rest = rest * 1000
        out, rest = out * 1000 + F.call_function("div", rest, total), rest % total
    return out + 1


def _value(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _starts(*cols: pa.Array) -> np.ndarray:
    """Where rows begin that differ from the one before in any column."""
    n = len(cols[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in cols:
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _summed_runs(batches, held: int):
    """Runs of what this task reads: for each (lang, source) and term its occurrences and documents since the last flush."""
    n: dict = defaultdict(Counter)
    docs: dict = defaultdict(Counter)
    least: dict = {}

    def flush():
        for (lang, source), of in n.items():
            words = list(of)
            for k in range(0, len(words), RUN_ROWS):
                some = words[k : k + RUN_ROWS]
                own = docs[lang, source]
                columns = [[lang] * len(some), pa.array(some, pa.binary()).cast(pa.string()), [source] * len(some), [least[lang, source]] * len(some), [own[w] for w in some], [of[w] for w in some]]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, (pa.string(), None, pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["lang", "term", "source", "document", "docs", "n"])
        n.clear(), docs.clear(), least.clear()

    for part, texts in pieces(batches):
        lang, source, ids = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("lang", "source", "doc_id"))
        for a, b, i, text in zip(lang, source, ids, texts, strict=True):
            words = terms(text)
            n[a, b].update(words)
            docs[a, b].update(set(words))
            i = -1 if i is None else i
            least[a, b] = min(least.get((a, b), i), i)
        if sum(map(len, n.values())) > held:
            yield from flush()
    yield from flush()


def _whole_terms(batches, of_run):
    """Give of_run whole (lang, term) runs of a partition sorted by them; what a batch cuts waits for the next one, as of_run left it."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t.combine_chunks()
        at = _starts(t["lang"].chunk(0), t["term"].chunk(0))
        if len(at) > 1:
            yield from of_run(t.slice(0, at[-1]).combine_chunks(), at[:-1])
        held = t.slice(at[-1])
        if held.num_rows > RUN_ROWS and "document" in held.column_names:
            held = _by_source(held.combine_chunks())
    if held is not None:
        yield from of_run(held.combine_chunks(), np.zeros(1, np.int64))


def _by_source(t: pa.Table) -> pa.Table:
    """One row for each run of (lang, term, source)."""
    at = _starts(*(t[c].chunk(0) for c in ("lang", "term", "source")))
    sums = {c: np.add.reduceat(t[c].to_numpy(), at) for c in ("docs", "n")}
    return pa.table({c: pa.array(sums[c]) if c in sums else t[c].take(pa.array(at)).combine_chunks() for c in t.column_names})


def _kept(batches):
    """The counts by source of terms with enough documents."""

    def of_run(t, _):
        t = _by_source(t).combine_chunks()
        at = _starts(t["lang"].chunk(0), t["term"].chunk(0))
        enough = np.add.reduceat(t["docs"].to_numpy(), at) >= LEAST_DOCS
        first = np.zeros(t.num_rows, np.int32)
        first[at] = 1
        keep = np.repeat(enough, np.diff(np.append(at, t.num_rows)))
        t = t.select(["lang", "term", "source", "n"]).append_column("first", pa.array(first)).filter(pa.array(keep))
        yield from t.to_batches()

    return _whole_terms(batches, of_run)


def _pairs_and_terms(batches):
    """Of each kept run: the values of its term in its sources, and what its sources' pairs owe to their sharing it, summed in this task."""
    pairs: Counter = Counter()

    def out(rows):
        lang, source, part, item, v = zip(*rows, strict=True) if rows else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (lang, source, part, item)] + [pa.array(v, pa.int64())], names=["lang", "source", "part", "item", "value"])

    def flush():
        rows = [(lang, a, "pair", b, v) for (lang, a, b), v in pairs.items()]
        pairs.clear()
        for k in range(0, len(rows), RUN_ROWS):
            yield out(rows[k : k + RUN_ROWS])

    def of_run(t, at):
        n, total, all_n, v = (t[c].to_numpy() for c in ("n", "total", "all_n", "terms"))
        size = np.diff(np.append(at, t.num_rows))
        run = np.repeat(np.arange(len(at)), size)
        p, z = scaled(n + ADDED, total + 2 * v), scaled(np.full_like(n, ADDED), total + 2 * v)
        q = scaled(np.add.reduceat(n, at) + ADDED, (all_n + 2 * v)[at])[run]
        more = pa.array(np.flatnonzero(p > q))
        found = t.take(more)
        yield pa.RecordBatch.from_arrays([found["lang"].combine_chunks(), found["source"].combine_chunks(), pa.array(["term"] * len(more), pa.string()), found["term"].combine_chunks(), pa.array(value(p, q)[more.to_numpy()])], names=["lang", "source", "part", "item", "value"])
        lang, source = (t[c].combine_chunks().dictionary_encode() for c in ("lang", "source"))
        group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
        names, code = np.unique(group, return_inverse=True)
        for d in range(1, int(size.max(initial=1))):
            i = np.flatnonzero(run[d:] == run[:-d])
            j = i + d
            both = value(p[i], p[j]) - value(p[i], z[j]) - value(z[i], p[j]) + value(z[i], z[j])
            where, of = np.unique(code[i] * len(names) + code[j], return_inverse=True)
            sums = np.zeros(len(where), np.int64)
            np.add.at(sums, of, both)
            for k, s in zip(where.tolist(), sums.tolist(), strict=True):
                a, b = names[k // len(names)], names[k % len(names)]
                pairs[lang.dictionary[int(a) // len(source.dictionary)].as_py(), source.dictionary[int(a) % len(source.dictionary)].as_py(), source.dictionary[int(b) % len(source.dictionary)].as_py()] += s
        if len(pairs) > HELD:
            yield from flush()

    yield from _whole_terms(batches, of_run)
    yield from flush()


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: how each (lang, source) differs from the other sources of its lang (part `pair`, all ranks) and
    by which terms it exceeds its lang (part `term`, the first TOP).

    Null lang, source and text are empty strings. Each row is a document, whatever its doc_id (nulls and repeats too). Terms are maximal
    runs of ASCII letters (A-Z lower-cased) and of characters beyond ASCII; a lang keeps those in LEAST_DOCS of its documents. A group
    without terms, or of a lang without kept terms, is compared like others (values 0 without kept terms); a lang of one source has
    no pairs. Ties go by the item's UTF-8 bytes. Other columns aren't read. An empty table gives no rows."""
    spark = docs.sparkSession
    # a term's rows in one task number the tasks' flushes times its sources, however many documents hold it
    tune(spark)
    named = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    runs = named.mapInArrow(partial(_summed_runs, held=HELD), _RUN).repartition("lang", "term").sortWithinPartitions("lang", "term", "source", "document")
    tune(spark, RUN_ROWS)
    kept = written(runs.mapInArrow(_kept, _KEPT))
    counted = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("first").alias("firsts"))
    groups = named.select("lang", "source").distinct().join(counted, ["lang", "source"], "left").withColumns({"total": F.coalesce("total", F.lit(0)), "firsts": F.coalesce("firsts", F.lit(0))})
    langs = Window.partitionBy("lang")
    groups = written(groups.select("lang", "source", "total", F.sum("total").over(langs).alias("all_n"), F.sum("firsts").over(langs).alias("terms")))
    stats = by_ids(kept.select("lang", "term", "source", "n"), groups, "inner", ["lang", "source"])
    sorted_kept = stats.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    tune(spark, RUN_ROWS)
    found = written(sorted_kept.mapInArrow(_pairs_and_terms, _FOUND))
    # pairs: neither source has the term, one has it (by how many terms it has how often), and what sharing it changes
    z = groups.select("lang", "source", "terms", "total", _scaled(F.lit(ADDED).cast("long"), F.greatest(F.col("total") + 2 * F.col("terms"), F.lit(ADDED))).alias("z"))
    other = z.select("lang", F.col("source").alias("item"), F.col("z").alias("zo"))
    neither = by_ids(z, other, "inner", "lang").filter("source <> item").select("lang", "source", "item", (F.col("terms") * _value(F.col("z"), F.col("zo"))).alias("value"))
    often = by_ids(kept.groupBy("lang", "source", "n").agg(F.count("*").alias("often")), z, "inner", ["lang", "source"])
    often = written(often.select("lang", "source", "often", "z", _scaled(F.col("n") + ADDED, F.col("total") + 2 * F.col("terms")).alias("p")))
    one = by_ids(often, other, "inner", "lang").filter("source <> item").select("lang", "source", "item", (F.col("often") * (_value(F.col("p"), F.col("zo")) - _value(F.col("z"), F.col("zo")))).alias("value"))
    shared = found.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    swapped = lambda x: x.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    parts = neither.unionByName(one).unionByName(swapped(one)).unionByName(shared).unionByName(swapped(shared))
    pair = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    first = found.filter("part = 'term'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP)
    names = ["lang", "source", "part", "item", "value", "rank"]
    return pair.withColumn("rank", F.row_number().over(order)).select(names).unionByName(first.select(names))
