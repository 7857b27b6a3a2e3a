"""Benchmark decontamination by templates: numbers, names and units become typed placeholders, windows are joined by hash,
and what stands in the slots must be consistent."""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_ids, column_out, mix, offsets, pieces, tune, written

#: Tokens of a window, and how many of them must be no placeholder in a window of templates. Shorter items are one window of
#: their length. Windows of the words as they stand have no such limit. An item none of whose windows has so many is one window as a whole, if it
#: has WINDOW tokens, or this many literals.
WINDOW, LITERALS, FEW = 8, 5, 2
#: Kinds of windows: of templates, of words as they stand, of whole templates.
TEMPLATE, WORD, WHOLE = 0, 1, 2
#: An item is in a document if so large a share of its windows match there in their order, or so many windows in a row.
COVERAGE, RUN = 0.5, 6
#: Windows of each kind (templates, words) of benchmark items that are held in a worker at once; more are taken in blocks, each against all documents.
BLOCK_WINDOWS = 1_000_000
#: Distinct words remembered in a worker.
WORDS = 400_000

#: Number words and units.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half".split()
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram kilograms oz ounce ounces lb lbs pound pounds ton tons "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "mph kph km/h m/s hz khz mhz ghz w kw mw v kv a ma j kj cal kcal pa kpa k c f % percent degree degrees cent cents dollar dollars usd eur euro euros gbp meter meters metre metres kilometer kilometers centimeter centimeters"
).split()
_NUMBER = re.compile(rb"[+-]?[$\xe2\x82\xac]*[0-9][0-9.,:/%-]*[a-z]{0,3}")
_STRIP = b".,;:!?\"'()[]{}"
_NUM, _NAME, _UNIT = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b"\0num", b"\0name", b"\0unit"))
IS_NUM, IS_CAP, IS_UNIT, ENDS, NOTHING = 1, 2, 4, 8, 16
_NUMBER_WORDS, _UNITS = {w.encode() for w in NUMBER_WORDS}, {w.encode() for w in UNITS}
_POWERS = mix(np.arange(1, WINDOW + 1, dtype=np.uint64)) | np.uint64(1)


class _Words(dict):
    """Word as it stands in a text to a row of literal hashes and flags."""

    def __init__(self) -> None:
        super().__init__()
        self.literal: list[int] = []
        self.flags: list[int] = []

    def __missing__(self, raw: bytes) -> int:
        self[raw] = at = len(self.literal)
        bare = raw.strip(_STRIP)
        low = bare.lower()
        flags = ENDS * (raw.rstrip(b"\"')]}")[-1:] in (b".", b"!", b"?", b":"))
        if not low:
            flags |= NOTHING
        elif _NUMBER.fullmatch(low) or low in _NUMBER_WORDS:
            flags |= IS_NUM
        else:
            flags |= IS_UNIT * (low in _UNITS) | IS_CAP * (bare.decode(errors="replace")[0].isupper() and bare != bare.upper())
        self.literal.append(xxhash.xxh3_64_intdigest(low))
        self.flags.append(flags)
        return at


class Templates:
    """Turns texts into template tokens: `token` (placeholders by type), `value` (what stands there) and `at` (tokens of each text)."""

    def __init__(self) -> None:
        self.words = _Words()

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(self.words) > WORDS:
            self.words = _Words()
        split = [t.split() for t in texts]
        n = np.array([len(w) for w in split], np.int64)
        rows = np.array([r for w in split for r in map(self.words.__getitem__, w)], np.int64)
        value, flags = np.array(self.words.literal, np.uint64)[rows], np.array(self.words.flags, np.uint8)[rows]
        doc = np.repeat(np.arange(len(texts)), n)
        real = (flags & NOTHING) == 0
        # a sentence may also end in a mark that stands alone, which is no token
        ends = np.concatenate([[True], (flags[:-1] & ENDS) > 0]) if len(flags) else np.zeros(0, bool)
        if len(doc):
            ends[1:] |= doc[1:] != doc[:-1]
            ends[1:] |= ~real[:-1] & ends[:-1]
        value, flags, doc, ends = value[real], flags[real], doc[real], ends[real]
        num = (flags & IS_NUM) > 0
        unit = (flags & IS_UNIT) > 0
        if len(unit):
            unit[1:] &= num[:-1] & (doc[1:] == doc[:-1])
            unit[0] = False
        name = ((flags & IS_CAP) > 0) & ~ends & ~unit
        token = np.where(num, _NUM, np.where(unit, _UNIT, np.where(name, _NAME, value)))
        return token, value, offsets(np.bincount(doc, minlength=len(texts)))


def windows(mixed: np.ndarray, lit: np.ndarray, at: np.ndarray, length: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First token and hash of each window of `length` tokens of a text that has at least `least` literals. mixed: hashes of tokens,
    lit: literals before each token."""
    m = len(mixed) - length + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    whole = np.ones(m, bool)
    for k in range(1, length):  # no window begins where it would run into the next text
        edge = at[1:-1] - k
        whole[edge[(edge >= 0) & (edge < m)]] = False
    if least:
        whole &= lit[length:] - lit[:m] >= least
    start = np.flatnonzero(whole)
    key = np.full(m, np.uint64(length))
    for k in range(length):
        key += mixed[k : k + m] * _POWERS[k]
    return start, mix(key[start])


def whole_windows(mixed: np.ndarray, at: np.ndarray, lengths: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """First token and hash of every window of each length, from one running sum. Chosen texts may have equal hashes: who finds one compares
    tokens."""
    power, back = np.full(len(mixed) + 1, _POWERS[0]), np.full(len(mixed) + 1, np.uint64(pow(int(_POWERS[0]), -1, 1 << 64)))
    power[0] = back[0] = 1
    power, back = np.multiply.accumulate(power), np.multiply.accumulate(back)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * power[:-1], dtype=np.uint64)])
    out = []
    for n in lengths:
        m = max(0, len(mixed) - n + 1)
        start = np.arange(m)
        start = start[np.searchsorted(at, start, "right") == np.searchsorted(at, start + n - 1, "right")]
        out.append((start, mix((total[start + n] - total[start]) * back[start] ^ mix(np.full(1, n, np.uint64)))))
    return out


class Index:
    """Windows of a block of benchmark items, by hash: of templates, of the words as they stand, whatever stands before them, and of whole templates
    of items with few literals."""

    def __init__(self, ids: list[int], texts: list[bytes]):
        self.ids = np.array(ids, np.int64)
        self.token, self.value, self.at = Templates()(texts)
        size = np.minimum(np.diff(self.at), WINDOW)
        self.lengths = [(kind, int(n)) for kind in (TEMPLATE, WORD) for n in np.unique(size) if n >= (1 if kind else LITERALS)]
        self.dense: list[int] = []
        start, key, kind, length = self._windows(self.token, self.value, self.at)
        item = np.searchsorted(self.at, start, "right") - 1
        has = np.bincount(item[(kind == TEMPLATE) & (size[item] == length)], minlength=len(ids))
        n_tokens = np.diff(self.at)
        literals = np.array([int((~np.isin(self.token[a:b], (_NUM, _NAME, _UNIT))).sum()) for a, b in zip(self.at[:-1], self.at[1:], strict=True)], np.int64)
        dense = (has == 0) & ((n_tokens >= WINDOW) | (literals >= FEW)) & (n_tokens > 0)
        self.dense = np.unique(n_tokens[dense]).tolist()
        start, key, kind, length = self._windows(self.token, self.value, self.at)
        item = np.searchsorted(self.at, start, "right") - 1
        own = np.where(kind == WHOLE, dense[item] & (n_tokens[item] == length), size[item] == length)
        start, key, kind, item = start[own], key[own], kind[own], item[own]
        order = np.argsort(key, kind="stable")
        self.key, self.start, self.kind, self.item = key[order], start[order], kind[order], item[order]
        self.count = np.stack([np.bincount(item[kind == k], minlength=len(ids)) for k in (TEMPLATE, WORD, WHOLE)])
        self.bits = np.zeros(1 << (22 if len(key) <= BLOCK_WINDOWS else 23), bool)
        self.bits[self.key & np.uint64(len(self.bits) - 1)] = True

    def _windows(self, token: np.ndarray, value: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """First token, hash, kind and length of the windows of all kinds and lengths that items have."""
        lit = offsets(~((token == _NUM) | (token == _NAME) | (token == _UNIT)))
        mixed, parts = (mix(token), mix(value ^ _POWERS[0])), []
        found = [(kind, n, windows(mixed[kind], lit, at, n, 0 if kind else LITERALS)) for kind, n in self.lengths]
        found += [(WHOLE, n, x) for n, x in zip(self.dense, whole_windows(mixed[0], at, self.dense) if self.dense else [], strict=True)]
        for kind, n, (start, key) in found:
            if hasattr(self, "bits"):
                maybe = np.flatnonzero(self.bits[key & np.uint64(len(self.bits) - 1)])
                start, key = start[maybe], key[maybe]
            parts.append((start, key, np.full(len(start), kind), np.full(len(start), n)))
        return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)]

    def find(self, token: np.ndarray, value: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, int, int, bool]]:
        """(text, item, windows that match, windows of the item, windows in a row, first token, whether slots differ) of the items
        found. What windows of templates find is told by them, unless the item also stands there word for word and they say it differs."""
        start, key, _, _ = self._windows(token, value, at)
        lo, hi = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        n = hi - lo
        if not n.sum():
            return []
        start, row = np.repeat(start, n), np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(offsets(n)[:-1], n)
        text, item, kind, there = np.searchsorted(at, start, "right") - 1, self.item[row], self.kind[row], self.start[row]
        if (kind == WHOLE).any():  # these hashes may be forged
            sure = kind != WHOLE
            for r in np.flatnonzero(~sure).tolist():
                a, b = int(self.at[item[r]]), int(self.at[item[r] + 1])
                sure[r] = np.array_equal(self.token[a:b], token[start[r] : start[r] + b - a])
            text, item, kind, there, start = text[sure], item[sure], kind[sure], there[sure], start[sure]
        order = np.lexsort((start, start - there, kind, item, text))
        text, item, kind, there, start = text[order], item[order], kind[order], there[order], start[order]
        again = np.concatenate([[False], (text[1:] == text[:-1]) & (item[1:] == item[:-1]) & (kind[1:] == WORD) & (kind[:-1] == WORD)])[: len(text)]
        first = np.flatnonzero(~(again & (self.count[WORD, item] == 1)))  # of items of one window of words the first place says all
        text, item, kind, there, start = text[first], item[first], kind[first], there[first], start[first]
        edge = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (kind[1:] != kind[:-1]) | ((start - there)[1:] != (start - there)[:-1])]))
        best: tuple[dict[tuple[int, int], tuple], ...] = ({}, {}, {})
        for s, e in zip(edge.tolist(), [*edge[1:].tolist(), len(start)], strict=True) if len(start) else ():
            k, i, words, steps = int(text[s]), int(item[s]), int(kind[s]), there[s:e]
            count = int(self.count[words, i])
            if e - s < COVERAGE * count and e - s < RUN:
                continue
            row_of = np.flatnonzero(np.concatenate([[True], np.diff(steps) != 1]))
            run = int(np.diff(np.append(row_of, len(steps))).max())
            if e - s < COVERAGE * count and run < RUN:
                continue
            same, differ = True, False
            if words != WORD:
                spot = np.arange(self.at[i], self.at[i + 1]) if words == WHOLE else np.unique(np.minimum(steps[:, None] + np.arange(WINDOW), self.at[i + 1] - 1))
                spot = spot[(spot + start[s] - there[s] < at[k + 1])]
                other = spot + (start[s] - there[s])
                held = (self.token[spot] == token[other]) & np.isin(self.token[spot], (_NUM, _NAME, _UNIT))
                mine, theirs = self.value[spot[held]], value[other[held]]
                differ = bool((mine != theirs).any())
                if differ:  # one value of the item always stands for one value of the document
                    pairs = np.unique(np.stack([mine, theirs], 1), axis=0)
                    same = len(np.unique(pairs[:, 0])) == len(pairs)
            if same and (e - s) > best[words].get((k, i), (0,))[0]:
                best[words][k, i] = (e - s, count, run, int(start[s] - at[k]), differ)
        told = best[WHOLE] | best[TEMPLATE]
        for at_, x in best[WORD].items():
            if at_ not in told or told[at_][-1] and x[0] == x[1]:
                told[at_] = x
        return [(k, i, *x) for (k, i), x in told.items()]


MATCH = T.StructType().add("item_id", "long").add("n_windows", "long").add("n_item_windows", "long").add("longest_run", "long").add("first_token", "long").add("reparameterised", "boolean")


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id and MATCH for each benchmark item that a row of docs holds, as it is or with other numbers, names or units.

    A row and an item match if their windows of templates agree along one diagonal for COVERAGE of the item's windows or RUN
    windows in a row, and no value of the item's slots stands for two values of the document; or if their windows of words (case
    and outer marks aside) agree so, which finds verbatim copies of every item, also of a word or two; or, of an item none of whose windows of
    templates has LITERALS literals, if its whole template stands there (items of under WINDOW tokens need FEW literals) with such slots. Null and empty texts match
    nothing; n_windows and n_item_windows are of the kind of windows that found the item; repeated rows match each; items with equal ids and texts count once. The
    benchmark is read in blocks of BLOCK_WINDOWS windows of each kind, each sent to all workers and dropped before the next; a block's size
    is bounded, their number isn't. A block takes an item longer than it whole."""
    spark = docs.sparkSession
    items = written(benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").distinct())
    size = F.size(F.split("text", r"\s+"))
    total = items.agg(F.sum(size)).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_WINDOWS))
    tune(spark)
    out = None
    for b in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        rows = part.collect()
        held = spark.sparkContext.broadcast(([r.item_id for r in rows], [r.text.encode() for r in rows], uuid.uuid4().hex))
        found = docs.select("doc_id", "text").mapInArrow(_finder(held), T.StructType([docs.schema["doc_id"], *MATCH]))
        if blocks > 1:  # one block after the other, so that the driver and the workers hold one
            found = written(found)
            held.destroy()
        out = found if out is None else out.union(found)
    return out


_CACHE: dict[str, tuple[Index, Templates]] = {}


def _finder(held):
    def run(batches):
        key = held.value[2]  # a worker lives on over tasks and queries
        if key not in _CACHE:
            _CACHE.clear()
            _CACHE[key] = (Index(*held.value[:2]), Templates())
        index, templates = _CACHE[key]
        for part, texts in pieces(batches):
            found = index.find(*templates(texts))
            if found:
                rows = np.array([(k, index.ids[i], *x[:-1]) for k, i, *x in found], np.int64)
                part = part.take(pa.array(rows[:, 0]))
                new = dict(zip(MATCH.names, [*(pa.array(rows[:, c]) for c in range(1, 6)), pa.array([bool(x[-1]) for x in found])], strict=True))
                yield column_out(part, ["doc_id"], new)

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each doc_id (null ids together) that holds a benchmark item: doc_id, n_items, item_ids (ascending), n_windows (of the item that
    matches in most), reparameterised (whether every item found has other values in its slots)."""
    found = matches(docs, benchmark)
    return found.groupBy("doc_id").agg(F.countDistinct("item_id").alias("n_items"), F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("n_windows").alias("n_windows"), F.min("reparameterised").alias("reparameterised"))


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item, with all their columns; rows with a null doc_id stay."""
    gone = written(matches(docs.filter("doc_id is not null"), benchmark).select("doc_id").distinct())
    return by_ids(docs, gone, "left_anti")
