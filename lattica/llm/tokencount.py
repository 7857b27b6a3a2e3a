"""Edit-aware token counts: a segment tree over runs of pre-tokens for each document. An edit re-encodes the runs that it touches
and what borders on them, and updates the sums on their paths to the root."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import LETTER, MARK, SPACES, ChunkTable, table
from .common import column_out, offsets, pieces, tune

#: Chunks of text (runs that no pre-token crosses) in a leaf.
LEAF = 64


def parts(left: bytes, right: bytes) -> bool:
    """Whether no pre-token can cross the border: it has a single space or newline on its right or a single newline on its left, between
    two visible characters, or is one between an ASCII letter and a mark."""
    if left and right and (LETTER[left[-1]] and MARK[right[0]] or MARK[left[-1]] and LETTER[right[0]]):
        return True
    if left[-1:] == b"\n":
        return len(left) > 1 and bool(right) and not left.endswith(SPACES, 0, len(left) - 1) and not right.startswith(SPACES)
    return right[:1] in (b" ", b"\n") and len(right) > 1 and not right.startswith(SPACES, 1) and bool(left) and not left.endswith(SPACES)


class TokenTree:
    """Leaves of text, and sums of code points and tokens for each node; node 1 is the root, node k has 2 k and 2 k + 1."""

    def __init__(self, leaves: list[bytes], points: list[int], tokens: list[int]):
        self.cap = 1 << max(0, len(leaves) - 1).bit_length()
        self.leaves = leaves + [b""] * (self.cap - len(leaves))
        self.points, self.tokens = self._sums(points), self._sums(tokens)
        self.encoded = 0  # bytes that edits have encoded again

    def _sums(self, leaf: list[int]) -> list[int]:
        out = [0] * self.cap + leaf + [0] * (self.cap - len(leaf))
        for k in range(self.cap - 1, 0, -1):
            out[k] = out[2 * k] + out[2 * k + 1]
        return out

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> bytes:
        return b"".join(self.leaves)

    def _find(self, point: int) -> tuple[int, int]:
        """Leaf, and byte in it, before which `point` code points stand; an end belongs to the leaf that it ends."""
        k = 1
        while k < self.cap:
            k *= 2
            if point > self.points[k]:
                point -= self.points[k]
                k += 1
        leaf = self.leaves[k - self.cap]
        if leaf.isascii():
            return k - self.cap, point
        return k - self.cap, len(leaf.decode()[:point].encode())

    def _put(self, leaf: int, text: bytes, tokens: int) -> None:
        self.leaves[leaf] = text
        k = leaf + self.cap
        dp, dt = (len(text) if text.isascii() else len(text.decode())) - self.points[k], tokens - self.tokens[k]
        while k:
            self.points[k] += dp
            self.tokens[k] += dt
            k >>= 1

    def _beside(self, leaf: int, step: int) -> int | None:
        leaf += step
        while 0 <= leaf < self.cap:
            if self.leaves[leaf]:
                return leaf
            leaf += step
        return None

    def change(self, at: int, deleted: int, inserted: bytes) -> tuple[int, bytes]:
        """Delete `deleted` code points at `at` (both cut to the text) and insert `inserted` there: the leaf to encode again and its
        text, with the leaves that it has to be joined with. Until settle() that leaf is out of date."""
        total = self.points[1]
        at = min(max(0, at), total)
        (i, b), (j, e) = self._find(at), self._find(min(at + max(0, deleted), total))
        text = self.leaves[i][:b] + inserted + self.leaves[j][e:]
        for k in range(i + 1, j + 1):
            if self.leaves[k]:
                self._put(k, b"", 0)
        while (k := self._beside(i, -1)) is not None and not parts(self.leaves[k], text):
            text = self.leaves[k] + text
            self._put(i, b"", 0)
            i = k
        while (k := self._beside(i, 1)) is not None and not parts(text, self.leaves[k]):
            text += self.leaves[k]
            self._put(k, b"", 0)
        return i, text

    def settle(self, leaf: int, text: bytes, tokens: int) -> None:
        self.encoded += len(text)
        self._put(leaf, text, tokens)

    def edit(self, at: int, deleted: int, inserted: bytes, count) -> None:
        """change() and settle() in one; count(text) gives tokens."""
        leaf, text = self.change(at, deleted, inserted)
        self.settle(leaf, text, count(text))


def trees(texts: list[bytes], chunks: ChunkTable) -> list[TokenTree]:
    """A tree for each text; the sums of all leaves of all texts are taken at once."""
    rows, n = chunks.rows_of(texts)
    at, per = offsets(n), -(-n // LEAF)
    first = np.repeat(at[:-1], per) + LEAF * (np.arange(per.sum()) - np.repeat(offsets(per)[:-1], per))
    tokens = np.add.reduceat(chunks.len[rows], first).tolist() if len(first) else []
    begin = offsets(chunks.bytes_of(rows))[first]
    own = np.repeat(offsets([len(t) for t in texts])[:-1], per)
    begin, out, k = (begin - own).tolist(), [], 0
    for t, m in zip(texts, per.tolist(), strict=True):
        cut = [*begin[k : k + m], len(t)]
        leaves = [t[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)] if m else []
        points = [len(x) for x in leaves] if t.isascii() else [len(x.decode()) for x in leaves]
        out.append(TokenTree(leaves, points, tokens[k : k + m]))
        k += m
    return out


EDITS = T.ArrayType(T.StructType().add("at", "long").add("deleted", "long").add("inserted", "string"))
RESULT = T.StructType().add("n_tokens", "long").add("n_tokens_edited", "long").add("n_bytes_edited", "long").add("n_bytes_encoded", "long").add("tree", T.ArrayType(T.LongType()))


def count_edited(docs: DataFrame, path: str, pattern: str, keep: list[str] | None = None, edits: str = "edits") -> DataFrame:
    """The columns `keep` (default doc_id) and RESULT: tokens before and after the edits of a row, bytes after them, bytes that
    they made to be encoded again, and the sums of the tree after them (node 1 first).

    `edits` (EDITS; null: none) apply in order, each to the text that the former left, in code points; they're cut to the text.
    Null and empty texts have no tokens. Repeated rows get a row each; columns named as the new ones are replaced."""
    tune(docs.sparkSession)
    keep = [c for c in keep or ["doc_id"] if c not in RESULT.names]

    def run(batches):
        chunks = table(path, pattern)
        for part, texts in pieces(batches):
            given = part.column(part.schema.get_field_index(edits)).to_pylist()
            built = trees(texts, chunks)
            before = [t.n_tokens for t in built]
            for k in range(max((len(own or ()) for own in given), default=0)):  # the k-th edits of all texts are encoded together
                now = [(t, own[k]) for t, own in zip(built, given, strict=True) if own and len(own) > k]
                changed = [t.change(e["at"] or 0, e["deleted"] or 0, (e["inserted"] or "").encode()) for t, e in now]
                for (t, _), (leaf, text), c in zip(now, changed, chunks.count([text for _, text in changed]).tolist(), strict=True):
                    t.settle(leaf, text, c)
            new = [before, [t.n_tokens for t in built], [sum(map(len, t.leaves)) for t in built], [t.encoded for t in built]]
            sums = pa.ListArray.from_arrays(pa.array(offsets([2 * t.cap - 1 for t in built]).astype(np.int32)), pa.array([x for t in built for x in t.tokens[1:]], pa.int64()))
            yield column_out(part, keep, dict(zip(RESULT.names, [*(pa.array(x, pa.int64()) for x in new), sums], strict=True)))

    return docs.select(*dict.fromkeys([*keep, "text", edits])).mapInArrow(run, T.StructType([*(docs.schema[c] for c in keep), *RESULT]))


TREE = T.StructType().add("leaves", T.ArrayType(T.BinaryType())).add("leaf_tokens", T.ArrayType(T.LongType()))


def _stored(part: pa.RecordBatch, keep: list[str], built: list[TokenTree], more: dict[str, pa.Array]) -> pa.RecordBatch:
    some = [[(x, n) for x, n in zip(t.leaves, t.tokens[t.cap :], strict=True) if x] for t in built]
    new = {"leaves": pa.array([[x for x, _ in own] for own in some], pa.list_(pa.binary())), "leaf_tokens": pa.array([[n for _, n in own] for own in some], pa.list_(pa.int64()))}
    return column_out(part, keep, new | more)


def build(docs: DataFrame, path: str, pattern: str, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default doc_id) and TREE of each row: a text's leaves and their tokens, to be written as a table. Null and empty
    texts have no leaves."""
    tune(docs.sparkSession)
    keep = [c for c in keep or ["doc_id"] if c not in TREE.names]

    def run(batches):
        chunks = table(path, pattern)
        for part, texts in pieces(batches):
            yield _stored(part, keep, trees(texts, chunks), {})

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, T.StructType([*(docs.schema[c] for c in keep), *TREE]))


def apply_edits(stored: DataFrame, edits: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """key, TREE, n_tokens and n_bytes_encoded of each row of a stored table after a later table of edits (key, edits of the type EDITS; one
    row for each key). Only what edits touch is encoded; rows without edits stay as they are. Leaves that edits made longer than
    four times LEAF chunks of 16 bytes are cut anew, so trees stay balanced."""
    tune(stored.sparkSession)
    schema = T.StructType([stored.schema[key], *TREE]).add("n_tokens", "long").add("n_bytes_encoded", "long")

    def run(batches):
        chunks = table(path, pattern)
        for part in batches:
            rows = [part.column(part.schema.get_field_index(c)).to_pylist() for c in ("leaves", "leaf_tokens", "edits")]
            built, encoded = [], []
            for leaves, tokens, own in zip(*rows, strict=True):
                leaves, tokens = leaves or [], tokens or []
                t = TokenTree(leaves, [len(x) if x.isascii() else len(x.decode()) for x in leaves], tokens)
                for e in own or ():
                    t.edit(e["at"] or 0, e["deleted"] or 0, (e["inserted"] or "").encode(), lambda x: int(chunks.count([x])[0]))
                n = t.encoded
                if own and max(map(len, t.leaves)) > 64 * LEAF:
                    parts_ = [trees([x], chunks)[0] if len(x) > 64 * LEAF else TokenTree([x], [len(x.decode())], [k]) for x, k in zip(t.leaves, t.tokens[t.cap :], strict=True) if x]
                    n += sum(len(x) for x in t.leaves if len(x) > 64 * LEAF)
                    flat = [(x, p, k) for q in parts_ for x, p, k in zip(q.leaves, q.points[q.cap :], q.tokens[q.cap :], strict=True) if x]
                    t = TokenTree(*map(list, zip(*flat, strict=True)))
                built.append(t), encoded.append(n)
            yield _stored(part, [key], built, {"n_tokens": pa.array([t.n_tokens for t in built], pa.int64()), "n_bytes_encoded": pa.array(encoded, pa.int64())})

    return stored.select(key, *TREE.names).join(edits.select(key, "edits"), key, "left").mapInArrow(run, schema)
