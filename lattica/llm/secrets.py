"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers."""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_out, offsets, pieces, tune
from .toxicity import segments

#: Fixed values of the base patterns. They run over UTF-8, where case-folding stays within ASCII.
ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_HINTS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "markov")

#: Runs of so many characters of the alphabet are scored, whole and in their best parts, up to the next SEPARATORS.
MARKOV_LEAST = 20
SEPARATORS = b"/-_+"
#: A run is a secret with at least this log-likelihood ratio (nats) for each character.
MARKOV_RATIO = 0.7
#: Labelled samples that the two models are trained on, for each class, and their seed.
SAMPLES, SEED = 20_000, 7
ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
#: Ordinary identifiers are labelled samples made from these words: joined in snake, kebab, camel or path style, some with a number.
WORDS = (
    "account action active address admin after agent alert alias amount angle animal answer append apply archive area array article asset async "
    "attribute audio author backup balance banner base batch before begin binary block body border bottom branch bridge browser bucket buffer build "
    "button cache calendar call camera cancel candidate capacity card category center chain change channel chapter character check child choice class "
    "clean client clock close cloud cluster code collection color column command comment commit common company compare complete component compress "
    "condition config connect constant contact container content context control convert cookie copy core count country create current custom cycle "
    "daily data database date debug decode default delete deliver demand depth describe design detail device dialog digital direction directory disable "
    "discount display distance document domain double download driver duration dynamic edge editor element email empty enable encode engine entity error "
    "event example execute expand export express extend external factor failure feature field file filter final finish first flag float folder footer "
    "format forward frame function gallery garden gateway general global graph group guide handle hash header health height hidden history holiday host "
    "image import include index info initial input insert inside instance internal interval invoice item journal keyboard label language large last layer "
    "layout leader legend length level library light limit line link list load local location lock logger login machine magnet manager map market master "
    "match maximum measure media member memory menu merge message method minimum mobile model module monitor month mount mouse multiple music name native "
    "network next node normal notice number object offset online open operator option order origin output owner package page panel parameter parent parse "
    "partition password path pattern payment people percent period person phone picture pixel place plan player plugin point policy pool position power "
    "prefix previous price primary print private process product profile program project property protocol provider public purchase quality query question "
    "queue random range rate reader ready reason receive record reference region register release remote remove render repeat replace report request "
    "reserve reset resource response result return review right root route row rule sample scale schedule schema scope screen script search second section "
    "select sender sequence serial server service session setting shadow shape share sheet shift short signal simple single size slice smart social socket "
    "sort source space special speed stack stage standard start state static station status step stock storage store stream street string structure style "
    "subject submit success suffix summary support switch symbol system table target task template temperature test text theme thread threshold ticket time "
    "title toggle toolbar total track traffic train transfer transform tree trigger type under union unique unit update upload user utility valid value "
    "variable vector vendor version vertical video view virtual visible volume wallet warning watch water weather week weight widget width window winter "
    "worker world write year zone und nicht eine werden schaft keit heit lich ung ment tion pour dans cette aire elle para como esta mente cion dad"
).split()
CHARSETS = ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789", ALPHABET[:62].decode(), ALPHABET[:64].decode(), ALPHABET[:62].decode() + "_-")

_CODE = np.full(256, -1, np.int16)
_CODE[list(ALPHABET)] = np.arange(len(ALPHABET))
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[list(SEPARATORS)] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True


def labelled_samples(n: int = SAMPLES, seed: int = SEED) -> tuple[list[str], list[str]]:
    """Random strings and ordinary identifiers."""
    rng = random.Random(seed)
    secrets = ["".join(rng.choices(rng.choice(CHARSETS), k=rng.randint(MARKOV_LEAST, 64))) for _ in range(n)]
    plain = []
    for k in range(n):
        if k % 10 == 0:  # rulers and fillings are ordinary, too
            plain.append(rng.choice(ALPHABET.decode()) * rng.randint(MARKOV_LEAST, 64))
            continue
        words = rng.choices(WORDS, k=rng.randint(2, 6))
        style = rng.randrange(6)
        name = ("_".join(words), "-".join(words), words[0] + "".join(w.title() for w in words[1:]), "/".join(words), "".join(words), "_".join(words).upper())[style]
        plain.append(name + (f"_{rng.randint(0, 2100)}" if rng.random() < 0.2 else ""))
    return secrets, plain


@lru_cache(maxsize=4)
def log_ratios(n: int = SAMPLES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """For a first character, and for a character after another: log-likelihood under the model of random strings less that
    under the model of identifiers. Both models are first-order Markov chains with one added to each count."""
    size, models = len(ALPHABET), []
    for strings in labelled_samples(n, seed):
        first, pairs = np.ones(size), np.ones((size, size))
        for s in strings:
            c = _CODE[np.frombuffer(s.encode(), np.uint8)]
            first[c[0]] += 1
            np.add.at(pairs, (c[:-1], c[1:]), 1)
        models.append((np.log(first / first.sum()), np.log(pairs / pairs.sum(axis=1, keepdims=True))))
    return models[0][0] - models[1][0], models[0][1] - models[1][1]


def runs(mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the runs of at least `least` true values."""
    edge = np.flatnonzero(np.diff(mask.view(np.int8), prepend=0, append=0))
    begin, end = edge[0::2], edge[1::2]
    long = end - begin >= least
    return begin[long], end[long]


def _gain(run: np.ndarray, ratio: float) -> np.ndarray:
    """What each character of a run tells for a random string, less the threshold."""
    first, pairs = log_ratios()
    c = _CODE[run]
    return np.concatenate([first[c[:1]], pairs[c[:-1], c[1:]]]) - ratio


def _best_parts(run: np.ndarray, ratio: float) -> list[tuple[int, int]]:
    """The whole run if it reaches the ratio; else its maximal-sum parts, each up to the next separators, if the part alone or
    with what was added is long enough and reaches it."""
    if len(run) < MARKOV_LEAST:
        return []
    gain = _gain(run, ratio)
    total = np.concatenate([[0.0], np.cumsum(gain)])
    if total[-1] >= 0:
        return [(0, len(run))]
    if not (total[MARKOV_LEAST:] >= np.minimum.accumulate(total)[: len(total) - MARKOV_LEAST]).any():
        return []
    cut, found = np.concatenate([[-1], np.flatnonzero(_SEPARATOR[run]), [len(run)]]), []
    for s, e, _ in segments(gain):
        x = s if _SEPARATOR[run[s]] else int(cut[np.searchsorted(cut, s) - 1]) + 1
        y = e if _SEPARATOR[run[e - 1]] else int(cut[np.searchsorted(cut, e)])
        if e - s >= MARKOV_LEAST or y - x >= MARKOV_LEAST and total[y] >= total[x]:
            if found and x <= found[-1][1]:
                found[-1] = (found[-1][0], max(y, found[-1][1]))
            else:
                found.append((x, y))
    return found


def _random_parts(raw: np.ndarray, b: int, e: int, base: list[tuple[int, int]], ratio: float) -> list[tuple[int, int]]:
    """Random parts of the run raw[b:e] outside of its base spans, of which each side is scored alone. What stands beside a base
    span without a separator is a part of any length if both together reach the ratio."""
    rest, last = [], b
    for s, t in base:
        if s > last:
            rest.append((last, s))
        last = max(last, t)
    if last < e:
        rest.append((last, e))
    found = {}
    for s, t in rest:
        parts = [(s + x, s + y) for x, y in _best_parts(raw[s:t], ratio)]
        if base and parts != [(s, t)]:
            for at, beside in ((s, s > b), (t - 1, t < e)):
                if beside and not _SEPARATOR[raw[at]]:
                    x, y = at, at + 1
                    while x > b and not _SEPARATOR[raw[x - 1]]:
                        x -= 1
                    while y < e and not _SEPARATOR[raw[y]]:
                        y += 1
                    if y - x >= MARKOV_LEAST and _gain(raw[x:y], ratio).sum() >= 0:
                        parts.append((max(x, s), min(y, t)))
        for x, y in sorted(parts):
            if found and x <= (z := next(reversed(found))) + found[z]:
                found[z] = max(found[z], y - z)
            else:
                found[x] = y - x
    return [(x, x + n) for x, n in found.items()]


def spans(texts: list[bytes], ratio: float = MARKOV_RATIO) -> list[list[tuple[int, int, int]]]:
    """(begin, kind, end) in bytes for each text, sorted; base spans, and Markov spans outside of them."""
    out: list[list[tuple[int, int, int]]] = []
    joined = b"\n".join(texts)  # no run goes over a line end
    raw = np.frombuffer(joined, np.uint8)
    at = offsets([len(t) + 1 for t in texts])
    for t in texts:
        own = []
        low = t.lower()
        if any(h in low for h in ASSIGN_HINTS):
            own += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= ASSIGN_LEAST]
        if b"AKIA" in t:
            own += [(m.start(), 1, m.end()) for m in ACCESS.finditer(t) if m.end() - m.start() >= ACCESS_LEAST]
        out.append(own)
    begin, end = runs(_HEX[raw], HEX_LEAST)
    for k, b, e in zip(np.searchsorted(at, begin, "right") - 1, begin.tolist(), end.tolist(), strict=True):
        out[k].append((b - int(at[k]), 2, e - int(at[k])))
    begin, end = runs(_CODE[raw] >= 0, MARKOV_LEAST)
    if len(begin):
        for k, b, e in zip(np.searchsorted(at, begin, "right") - 1, begin.tolist(), end.tolist(), strict=True):
            o = int(at[k])
            base = sorted((max(x[0] + o, b), min(x[2] + o, e)) for x in out[k] if x[1] < 3 and x[0] + o < e and b < x[2] + o)
            out[k] += [(x - o, 3, y - o) for x, y in _random_parts(raw, b, e, base, ratio)]
    for own in out:
        own.sort()
    return out


def in_code_points(text: bytes, own: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not own or text.isascii():
        return own
    before = offsets((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    return [(int(before[b]), k, int(before[e])) for b, k, e in own]


SPAN = T.ArrayType(T.StructType().add("kind", "string").add("start", "integer").add("end", "integer"))


def scan(docs: DataFrame, keep: list[str] | None = None, text: str = "text", to: str = "secret_spans", ratio: float = MARKOV_RATIO) -> DataFrame:
    """The columns `keep` (default: all but the text) and the spans of secrets in the whole text, in code points, end
    exclusive, by start and then kind. Null and empty texts have none; repeated rows get a row each; a column named as `to` is replaced."""
    tune(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (to, text) or keep is not None and c == text]

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for part, texts in pieces(batches, text):
            found = [[{"kind": KINDS[k], "start": b, "end": e} for b, k, e in in_code_points(t, own)] for t, own in zip(texts, spans(texts, ratio), strict=True)]
            yield column_out(part, keep, {to: pa.array(found, kind)})

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, T.StructType([*(docs.schema[c] for c in keep), T.StructField(to, SPAN)]))


def digests(scanned: DataFrame, of: str = "secret_spans") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans from the spans that scan() gives."""
    said = lambda xs: F.concat_ws(",", F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    number = lambda k: F.size(F.filter(of, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter(of, lambda s: s["kind"] != KINDS[3])
    return scanned.select("doc_id", *[number(k) for k in KINDS[:3]], F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col(of)).alias("spans"))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", length: str | None = "n_chars") -> DataFrame:
    """docs with each span (overlapping ones joined) replaced by a mark; `length`, where docs has it, becomes the new number of
    code points of the texts that changed. Null stays null; nothing else changes."""
    tune(docs.sparkSession)
    names, mark_bytes = docs.columns, mark.encode()
    counted = length if length in names else None

    def run(batches):
        for part, texts in pieces(batches, text):
            found = spans(texts)
            col, arrays = part.schema.get_field_index(text), list(part.columns)
            if any(found):
                given, sizes = part.column(col).to_pylist(), part.column(part.schema.get_field_index(counted)).to_pylist() if counted else None
                for k, own in enumerate(found):
                    if own:
                        out, last = [], 0
                        for b, _, e in own:
                            if b >= last:
                                out += [texts[k][last:b], mark_bytes]
                            last = max(last, e)
                        given[k] = b"".join([*out, texts[k][last:]]).decode()
                        if sizes:
                            sizes[k] = len(given[k])
                arrays[col] = pa.array(given, part.schema.field(col).type)
                if sizes:
                    at = part.schema.get_field_index(counted)
                    arrays[at] = pa.array(sizes, part.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.mapInArrow(run, docs.schema)


def sha_of(found: list[tuple[int, int, int]]) -> str:
    """base_sha256 by brute force, for tests."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{b}:{e}" for b, k, e in found if k < 3).encode()).hexdigest()
