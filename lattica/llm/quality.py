"""Quality rules: word and line repetition, and bands of zstandard ratios over whole documents and fixed chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import column_out, mix, offsets, pieces, tune

#: Smallest and largest ratio of compressed to raw bytes, by the least number of bytes to which the band applies. Short texts
#: compress badly whatever they say, so their bands are wide; below the first there's no verdict.
BANDS = ((64, 0.30, 1.25), (256, 0.22, 0.85), (1024, 0.15, 0.78), (4096, 0.10, 0.74), (32768, 0.08, 0.72))
#: The same for fixed chunks of a longer text, and the share of chunks outside the band that a text may have.
CHUNK, CHUNK_BAND, CHUNK_SHARE = 4096, (0.12, 0.76), 0.5
#: Fixed values of the base rules.
WINDOW, MIN_WORDS, REPEAT_PERCENT = 8, 20, 30
SYMBOLS = b"#*$%&|<>"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_START = np.array([(b & 0xC0) != 0x80 for b in range(256)])
_WEIGHTS = mix(np.arange(1, WINDOW + 1, dtype=np.uint64)) | np.uint64(1)

RESULT = (
    T.StructType().add("n_words", "long").add("word_chars", "long").add("n_symbols", "long").add("n_dup_lines", "long").add("n_repeat_words", "long")
    .add("base_failed", "boolean").add("ratio", "double").add("bad_chunks", "long").add("n_chunks", "long").add("kept", "boolean")
)


def repeated_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and how many of them lie in a window of WINDOW words that the text holds more than once."""
    words = [t.split() for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    at = offsets(n)
    total = int(at[-1])
    repeat = np.zeros(len(texts), np.int64)
    if total < WINDOW:
        return n, repeat
    h = np.fromiter((hash(x) for w in words for x in w), np.int64, total).astype(np.uint64)
    doc = np.repeat(np.arange(len(texts)), n)
    m = total - WINDOW + 1
    key = np.zeros(m, np.uint64)
    for k in range(WINDOW):
        key += mix(h[k : k + m]) * _WEIGHTS[k]
    here = np.flatnonzero(doc[:m] == doc[WINDOW - 1 :])
    key = mix(key[here] + mix(doc[here].astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    key, start = key[order], here[order]
    same = (key[1:] == key[:-1]) & (doc[start[1:]] == doc[start[:-1]])
    pairs = np.flatnonzero(same)
    for k in range(WINDOW):  # equal keys are held against the words
        pairs = pairs[h[start[pairs] + k] == h[start[pairs + 1] + k]]
    hit = np.zeros(total + 1, np.int64)
    twice = np.unique(np.concatenate([start[pairs], start[pairs + 1]]))
    np.add.at(hit, twice, 1)
    np.add.at(hit, np.minimum(twice + WINDOW, total), -1)
    covered = np.cumsum(hit[:-1]) > 0
    return n, np.diff(offsets(covered)[at])


def duplicate_lines(text: bytes) -> int:
    """Lines that have a word and equal an earlier line."""
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def in_band(ratio: float, size: int) -> bool:
    low, high = 0.0, float("inf")
    for least, lo, hi in BANDS:
        if size >= least:
            low, high = lo, hi
    return low <= ratio <= high


def judge(texts: list[bytes], level: int = 3) -> list:
    """The columns of RESULT for some texts."""
    pack = zstandard.ZstdCompressor(level=level).compress
    n, repeat = repeated_words(texts)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    at = offsets([len(t) for t in texts])
    chars = np.diff(offsets(_START[raw] & ~_SPACE[raw])[at])
    symbols = np.diff(offsets(_SYMBOL[raw])[at])
    failed = (n < MIN_WORDS) | (100 * repeat > REPEAT_PERCENT * n)
    ratio = [len(pack(t)) / len(t) if t else None for t in texts]
    bad, of, kept = [], [], []
    for t, r, f in zip(texts, ratio, failed.tolist(), strict=True):
        chunks = [t[i : i + CHUNK] for i in range(0, len(t), CHUNK)] if len(t) >= CHUNK else []
        outside = sum(not (CHUNK_BAND[0] <= len(pack(c)) / CHUNK <= CHUNK_BAND[1] if len(c) == CHUNK else in_band(len(pack(c)) / len(c), len(c))) for c in chunks)
        bad.append(outside), of.append(len(chunks))
        kept.append(not f and r is not None and in_band(r, len(t)) and outside <= CHUNK_SHARE * len(chunks))
    return [n, chars, symbols, [duplicate_lines(t) for t in texts], repeat, failed, ratio, bad, of, kept]


def score(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default doc_id) and RESULT for each row; columns named as the new ones are replaced.

    A text (null: empty) fails the base rules with fewer than MIN_WORDS words or over REPEAT_PERCENT percent of its words in
    repeated windows. It is kept if it passes them, its ratio lies in the band of its length, and no more than CHUNK_SHARE of
    its chunks of CHUNK bytes lie outside CHUNK_BAND (a shorter last one: outside the band of its length); texts under CHUNK have no chunks. Empty texts have ratio null and aren't kept; repeated rows get a row each."""
    tune(docs.sparkSession)
    keep = [c for c in keep or ["doc_id"] if c not in RESULT.names]

    def run(batches):
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()]
        for part, texts in pieces(batches):
            yield column_out(part, keep, {name: pa.array(v, k) for name, v, k in zip(RESULT.names, judge(texts), kinds, strict=True)})

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, T.StructType([*(docs.schema[c] for c in keep), *RESULT]))


def filter_docs(docs: DataFrame) -> DataFrame:
    """The rows of docs that score() keeps, with all their columns as they are."""
    tune(docs.sparkSession)

    def run(batches):
        for part, texts in pieces(batches):
            yield part.filter(pa.array(judge(texts)[-1], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
