"""Byte-level BPE encoding and decoding over padded numpy matrices.

Where the pattern is the one that CUT_PATTERN names, texts are cut at single spaces and newlines between visible characters and between
letters and marks, which it never crosses; each distinct chunk is pre-tokenised once and remembered in a bounded table, which is looked up
by arrays of hashes. Other patterns get whole texts. Distinct pre-tokens are put into matrices by
length (powers of two). In each round every row looks up the ranks of its adjacent pairs in a hash table, merges its
leftmost pair of least rank and is compacted; rows without a pair leave.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import column_out, offsets, pieces, ragged, tune

#: White space by any of the libraries' definitions; a chunk that starts or ends with it is joined to its neighbour.
SPACES = tuple(c.encode() for c in "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　")
#: Fixed value: the pattern whose pre-tokens never cross the places where ChunkTable cuts.
CUT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct chunks kept in a worker's table before it is emptied, and bytes of the longest chunk that is kept.
TABLE_ROWS, CHUNK_BYTES = 1_200_000, 512
#: Bytes that are hashed at once.
HASHED = 1 << 18
#: Pre-tokens of more bytes are merged through a heap: rounds over a matrix would cost the square of the length.
LONG = 512
NONE = np.int32(2**31 - 1)
EMPTY = np.zeros(0, np.int32)


def _bytes(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


LETTER = _bytes((65, 90), (97, 122))
MARK = _bytes((33, 38), (40, 47), (58, 64), (91, 96), (123, 126))
#: Visible characters that a text is cut beside: ASCII ones, and by their first bytes those that are never white space.
_VISIBLE = _bytes((33, 126))
_LEAD = (_bytes((0xC3, 0xDF)), _bytes((0xE4, 0xED)), _bytes((0xF0, 0xF4)))
_BEGINS = _VISIBLE | _LEAD[0] | _LEAD[1] | _LEAD[2]


class PairTable:
    """Open-addressed hash table from a pair of ids to the id of the merged token."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        bits = max(8, int(len(left) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            s = slot[todo]
            free = self.keys[s] < 0
            _, first = np.unique(np.where(free, s, -1 - np.arange(len(s))), return_index=True)
            won = first[free[first]]
            self.keys[s[won]], self.values[s[won]] = keys[todo[won]], merged[todo[won]]
            left_over = np.ones(len(todo), bool)
            left_over[won] = False
            todo = todo[left_over]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of merged pairs, NONE where the pair has none or a side is negative."""
        out = np.full(len(left), NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left[todo].astype(np.int64) << 32 | right[todo].astype(np.int64)
        slot = self._slot(keys)
        while len(todo):
            there = self.keys[slot]
            hit = there == keys
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (there >= 0)
            todo, keys, slot = todo[on], keys[on], (slot[on] + 1) & self.mask
        return out


class ByteBPE:
    """Encoder and decoder for a rank file; ids equal ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_to_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None:
                    left.append(a), right.append(b), merged.append(rank)
        self.pairs = PairTable(np.array(left, np.int64), np.array(right, np.int64), np.array(merged, np.int32))
        self.pair_dict: dict[tuple[int, int], int] | None = None
        self._pairs = (left, right, merged)
        by_id: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            by_id[rank] = token
        self.token_len = np.array([len(t) for t in by_id], np.int64)
        self.token_flat = np.frombuffer(b"".join(by_id), np.uint8)
        self.token_at = offsets(self.token_len)[:-1]
        said = [f" {i}".encode() for i in range(len(by_id))]
        self.said_len = np.array([len(t) for t in said], np.int64)
        self.said_flat = np.frombuffer(b"".join(said), np.uint8)
        self.said_at = offsets(self.said_len)[:-1]

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each pre-token."""
        out: list[np.ndarray | None] = [None] * len(words)
        buckets: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if (whole := self.ranks.get(w)) is not None:
                out[i] = np.array([whole], np.int32)
            elif len(w) > LONG:
                out[i] = self._merge_long(w)
            else:
                buckets.setdefault((len(w) - 1).bit_length(), []).append(i)
        for bits, rows in buckets.items():
            width = 1 << bits
            step = max(1, (1 << 19) // width)
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                for i, ids in zip(part, self._merge_rows([words[i] for i in part], width), strict=True):
                    out[i] = ids
        return out  # type: ignore[return-value]

    def _merge_rows(self, words: list[bytes], width: int) -> list[np.ndarray]:
        lens = np.array([len(w) for w in words], np.int64)
        m = np.full((len(words), width), -1, np.int32)
        m[np.arange(width) < lens[:, None]] = self.bytes_to_id[np.frombuffer(b"".join(words), np.uint8)]
        p = np.full((len(words), width), NONE, np.int32)
        if width > 1:
            p[:, :-1] = self.pairs.get(m[:, :-1].ravel(), m[:, 1:].ravel()).reshape(len(words), -1)
        out: list[np.ndarray] = [None] * len(words)  # type: ignore[list-item]
        rows, cols = np.arange(len(words)), np.arange(width)
        while len(rows):
            at = p.argmin(axis=1)
            best = p[np.arange(len(rows)), at]
            done = best == NONE
            if done.any():
                for k in np.flatnonzero(done):
                    out[rows[k]] = m[k, : lens[k]].copy()
                keep = ~done
                rows, m, p, lens, at, best = rows[keep], m[keep], p[keep], lens[keep], at[keep], best[keep]
                if not len(rows):
                    break
                most = int(lens.max())
                if most <= m.shape[1] // 2:
                    m, p, cols = m[:, :most].copy(), p[:, :most].copy(), cols[:most]
            r, width = np.arange(len(rows)), m.shape[1]
            m[r, at] = best
            source = np.minimum(cols + (cols > at[:, None]), width - 1)
            m = np.take_along_axis(m, source, 1)
            p = np.take_along_axis(p, np.minimum(cols + (cols >= at[:, None]), width - 1), 1)
            lens -= 1
            m[r, lens], p[r, lens] = -1, NONE
            right = np.where(at + 1 < lens, m[r, np.minimum(at + 1, width - 1)], -1)
            p[r, at] = self.pairs.get(m[r, at], right)
            before = np.flatnonzero(at > 0)
            p[before, at[before] - 1] = self.pairs.get(m[before, at[before] - 1], m[before, at[before]])
        return out

    def _merge_long(self, word: bytes) -> np.ndarray:
        """The same merges in O(n log n) over a linked list."""
        if self.pair_dict is None:
            self.pair_dict = dict(zip(zip(self._pairs[0], self._pairs[1], strict=True), self._pairs[2], strict=True))
        pair = self.pair_dict.get
        ids = self.bytes_to_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        nxt, prv = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pair((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = nxt[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], nxt[i] = rank, -1, nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
                if (r := pair((rank, ids[nxt[i]]))) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[nxt[i]]))
            if prv[i] >= 0 and (r := pair((ids[prv[i]], rank))) is not None:
                heapq.heappush(heap, (r, prv[i], ids[prv[i]], rank))
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode_chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks of text in a row, and how many each has."""
        words: dict[bytes, int] = {}
        parts = [[words.setdefault(w.encode(), len(words)) for w in self.pattern.findall(c.decode())] for c in chunks]
        ids = self.merge(list(words))
        flat, lens = np.concatenate([EMPTY, *ids]), np.array([len(x) for x in ids], np.int64)
        rows = np.array([k for p in parts for k in p], np.int64)
        at = offsets([len(p) for p in parts])
        return ragged(flat, offsets(lens)[:-1][rows], lens[rows]), np.diff(offsets(lens[rows])[at])

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a run of ids."""
        return ragged(self.token_flat, self.token_at[ids], self.token_len[ids])

    def decimal(self, ids: np.ndarray) -> np.ndarray:
        """The ids in decimal, each after a space."""
        return ragged(self.said_flat, self.said_at[ids], self.said_len[ids])


def cuts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where chunks of texts begin: at[:-1] (offsets of the texts in raw) and every place that CUT_PATTERN never crosses: before a single
    space, on both sides of a single newline (both between visible characters), and between ASCII letters and marks (no apostrophe)."""
    n = len(raw)
    begin = np.zeros(n + 2, bool)
    letter, mark = LETTER[raw], MARK[raw]
    begin[1:n] = (letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])
    k = np.flatnonzero((raw == 32) | (raw == 10))
    k = k[(k > 0) & (k < n - 1)]
    k = k[_BEGINS[raw[k + 1]]]
    before = raw[k - 1]
    ok = _VISIBLE[before]
    high = np.flatnonzero(before >= 0x80)
    for back, lead in enumerate(_LEAD, 2):
        ok[high] |= lead[raw[np.maximum(k[high] - back, 0)]]
    inside = np.zeros(n + 1, bool)  # whether a text begins here: no cut looks over its border
    inside[at] = True
    k = k[ok & ~inside[k] & ~inside[k + 1]]
    begin[k] = True
    begin[k[raw[k] == 10] + 1] = True
    begin[at[:-1]] = True
    return np.flatnonzero(begin[:n])


class ChunkTable:
    """Encodes texts chunk by chunk through `encode_chunks`, remembering distinct chunks by two 64-bit hashes of their bytes.

    `cut` says whether the encoder's pre-tokens never cross the places of cuts(); else whole texts are chunks, as are those that hold one
    of the strings `whole`."""

    def __init__(self, encode_chunks, rows: int = TABLE_ROWS, cut: bool = True, whole: tuple[bytes, ...] = ()):
        self.encode_chunks, self.rows, self.cut, self.whole = encode_chunks, rows, cut, whole
        #: A random number for each place in a chunk and each byte there, twice.
        self.tables = [np.frombuffer(os.urandom(8 * 256 * CHUNK_BYTES), np.uint64).copy() for _ in range(2)]
        self._clear()

    def _clear(self) -> None:
        self.flat, self.used, self.n = EMPTY, 0, 0
        self.one, self.two = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64)
        self.at, self.len, self.size, self.again = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, bool)
        self._slots(1 << 12)

    def _slots(self, size: int) -> None:
        """An empty index of `size` slots, filled with the rows that the table has."""
        self.slots, self.shift = np.full(size, -1, np.int32), np.uint64(65 - size.bit_length())
        self._index(np.arange(self.n))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _index(self, rows: np.ndarray) -> None:
        slot, mask = self._slot(self.one[rows]), len(self.slots) - 1
        while len(rows):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = rows[free]  # of rows that want one slot the last stays
            on = self.slots[slot] != rows
            rows, slot = rows[on], (slot[on] + 1) & mask

    def _find(self, key: np.ndarray) -> np.ndarray:
        """Rows of the hashes, -1 where there's none."""
        one, two, mask = np.ascontiguousarray(key[:, 0]), np.ascontiguousarray(key[:, 1]), len(self.slots) - 1
        slot = self._slot(one)
        out = self.slots[slot].astype(np.int64)
        on = np.flatnonzero((out >= 0) & ((self.one[out] != one) | (self.two[out] != two)))
        slot = slot[on]
        while len(on):  # another chunk has the slot
            slot = (slot + 1) & mask
            row = self.slots[slot]
            out[on] = row
            left = (row >= 0) & ((self.one[row] != one[on]) | (self.two[row] != two[on]))
            on, slot = on[left], slot[left]
        return out

    def _hashes(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Two hashes of each chunk: sums of random numbers, one for each place and byte, that each process draws. So two different chunks
        agree in both with probability 2^-128, whatever texts somebody chooses. Long chunks have a digest."""
        out = np.empty((len(begin), 2), np.uint64)
        k = 0
        while k < len(begin):
            e = max(k + 1, int(np.searchsorted(end, begin[k] + HASHED, "right")))
            if end[k] - begin[k] <= HASHED:
                at = begin[k:e] - begin[k]
                part = raw[begin[k] : end[e - 1]]
                place = np.arange(len(part), dtype=np.int32) - np.repeat(at, end[k:e] - begin[k:e]).astype(np.int32)
                index = np.minimum(place, CHUNK_BYTES - 1) << 8 | part
                for side, table in enumerate(self.tables):
                    out[k:e, side] = np.add.reduceat(table[index], at)
            k = e
        for k in np.flatnonzero(end - begin > CHUNK_BYTES).tolist():
            out[k] = np.frombuffer(xxhash.xxh3_128_digest(raw[begin[k] : end[k]].tobytes()), np.uint64)
        return out

    def _learn(self, key: np.ndarray, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Encode new chunks; their rows."""
        _, first, of = np.unique(key[:, 0], return_index=True, return_inverse=True)
        if (key[first[of], 1] != key[:, 1]).any():
            _, first, of = np.unique(key, axis=0, return_index=True, return_inverse=True)
        lens = end[first] - begin[first]
        text, to = ragged(raw, begin[first], lens).tobytes(), np.cumsum(lens).tolist()
        flat, counts = self.encode_chunks([text[a:b] for a, b in zip([0, *to[:-1]], to, strict=True)])
        n, self.n = self.n, self.n + len(first)
        if self.n > len(self.at):
            room = max(self.n - len(self.at), len(self.at) // 2)
            self.one, self.two, self.at, self.len, self.size, self.again = (np.concatenate([x, np.zeros(room, x.dtype)]) for x in (self.one, self.two, self.at, self.len, self.size, self.again))
        self.one[n : self.n], self.two[n : self.n] = key[first].T
        self.size[n : self.n], self.len[n : self.n] = lens, counts
        self.at[n : self.n] = self.used + offsets(counts)[:-1]
        if self.used + len(flat) > len(self.flat):
            grown = np.zeros(max(len(self.flat) * 3 // 2, self.used + len(flat)), np.int32)
            grown[: self.used] = self.flat[: self.used]
            self.flat = grown
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        if 3 * self.n > len(self.slots):
            self._slots(1 << (6 * self.n).bit_length())
        else:
            self._index(np.arange(n, self.n))
        return n + of.ravel()

    def _forget(self) -> None:
        """Keep the chunks that were met again, if they're few enough; they have to be met again to stay once more."""
        keep = np.flatnonzero(self.again[: self.n])
        if len(keep) > 2 * self.rows // 3:
            self._clear()
            return
        self.flat, n = ragged(self.flat, self.at[keep], self.len[keep]), len(keep)
        for x in (self.one, self.two, self.len, self.size):
            x[:n] = x[keep]
        self.at[:n], self.used, self.n = offsets(self.len[:n])[:-1], len(self.flat), n
        self.again[:] = False
        self._slots(len(self.slots))

    def bytes_of(self, rows: np.ndarray) -> np.ndarray:
        """Bytes of text of each chunk."""
        return self.size[rows]

    def rows_of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Table rows of all chunks of the texts, and how many each text has. They hold until the next call."""
        if self.n > self.rows:
            self._forget()
        at = offsets([len(t) for t in texts])
        raw = np.frombuffer(b"".join(texts), np.uint8)
        if not len(raw):
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        begin = cuts(raw, at) if self.cut else np.unique(at[:-1][np.diff(at) > 0])
        if self.cut and any(s in text for s in self.whole for text in texts):
            held = np.array([any(s in text for s in self.whole) for text in texts])
            text_of = np.searchsorted(at, begin, "right") - 1
            begin = begin[~held[text_of] | (begin == at[text_of])]
        end = np.append(begin[1:], len(raw))
        key = self._hashes(raw, begin, end)
        rows = self._find(key)
        new = rows < 0
        self.again[rows[~new]] = True
        if new.any():
            rows[new] = self._learn(key[new], raw, begin[new], end[new])
        return rows, np.diff(np.searchsorted(begin, at))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and how many each text has."""
        rows, counts = self.rows_of(texts)
        lens = self.len[rows]
        at = offsets(counts)
        return ragged(self.flat, self.at[rows], lens), np.diff(offsets(lens)[at])

    def count(self, texts: list[bytes]) -> np.ndarray:
        """Tokens of each text."""
        rows, counts = self.rows_of(texts)
        return np.diff(offsets(self.len[rows])[offsets(counts)])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBPE:
    """The encoder of a rank file; one for each worker process."""
    return ByteBPE(read_ranks(path), pattern)


@lru_cache(maxsize=2)
def table(path: str, pattern: str) -> ChunkTable:
    return ChunkTable(load(path, pattern).encode_chunks, cut=pattern == CUT_PATTERN)


def encode(docs: DataFrame, path: str, pattern: str, ids: str = "token_ids") -> DataFrame:
    """All columns of docs and the ids of the whole text (null: none) as array<int>. A column called as `ids` is replaced."""
    tune(docs.sparkSession)
    names = [c for c in docs.columns if c != ids]

    def run(batches):
        chunks = table(path, pattern)
        for part, texts in pieces(batches):
            flat, counts = chunks.encode(texts)
            out = pa.ListArray.from_arrays(pa.array(offsets(counts).astype(np.int32)), pa.array(flat, pa.int32()))
            yield column_out(part, names, {ids: out})

    return docs.mapInArrow(run, T.StructType([*(docs.schema[c] for c in names), T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(tokens: DataFrame, path: str, pattern: str, ids: str = "token_ids", to: str = "decoded") -> DataFrame:
    """All columns and the bytes that the ids stand for, as binary (null or no ids: empty)."""
    tune(tokens.sparkSession)
    names = [c for c in tokens.columns if c != to]

    def run(batches):
        bpe = load(path, pattern)
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(ids))
            out = [bpe.decode(np.asarray(x or [], np.int64)).tobytes() for x in col.to_pylist()]
            yield column_out(batch, names, {to: pa.array(out, pa.binary())})

    return tokens.mapInArrow(run, T.StructType([*(tokens.schema[c] for c in names), T.StructField(to, T.BinaryType())]))


def round_trip(docs: DataFrame, path: str, pattern: str, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Encode every whole text, decode the ids, and give a digest of both: the columns `keep` (default doc_id), then
    n_tokens, ids_sha256 (of the decimal ids joined by a space), decoded_sha256 (of the decoded bytes).

    Null and empty texts have no ids. Repeated rows give a row each; columns named as the new ones are replaced."""
    tune(docs.sparkSession)
    new = T.StructType().add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    keep = [c for c in keep or ["doc_id"] if c not in new.names]

    def run(batches):
        bpe, chunks = load(path, pattern), table(path, pattern)
        sha = hashlib.sha256
        for part, texts in pieces(batches, text):
            flat, counts = chunks.encode(texts)
            at = offsets(counts)
            said, bytes_of = memoryview(bpe.decimal(flat)), memoryview(bpe.decode(flat))
            said_at, bytes_at = offsets(bpe.said_len[flat])[at], offsets(bpe.token_len[flat])[at]
            ids_sha = [sha(said[min(s + 1, e) : e]).hexdigest() for s, e in zip(said_at[:-1].tolist(), said_at[1:].tolist(), strict=True)]
            out_sha = [sha(bytes_of[s:e]).hexdigest() for s, e in zip(bytes_at[:-1].tolist(), bytes_at[1:].tolist(), strict=True)]
            yield column_out(part, keep, {"n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(ids_sha), "decoded_sha256": pa.array(out_sha)})

    columns = [*dict.fromkeys([*keep, text])]
    return docs.select(*columns).mapInArrow(run, T.StructType([*(docs.schema[c] for c in keep), *new]))
