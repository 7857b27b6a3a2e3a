"""Toxicity by maximum-scoring segments over token log-odds with Dirichlet priors, calibrated by extreme values."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_out, pieces, tune, written

#: Labelled documents that the model is fitted on, at most: those of the smallest hash of doc_id.
TRAIN_DOCS = 20_000
#: A word or a prefix becomes a feature from so many documents on, if its log-odds have a z-score that chance hardly gives to any
#: of the words counted: the square root of twice the logarithm of their number.
LEAST_DOCS = 4
#: Weight of the Dirichlet prior, as a share of the tokens of the smaller class; it has the proportions of both classes together.
PRIOR = 0.1
#: Words that aren't features stand for their longest prefix that is one.
PREFIXES = (7, 6, 5, 4)
#: A segment is significant if chance would give so many as high in a document of its length.
SEGMENT_E = 0.05
#: Distinct words remembered in a worker.
WORDS = 400_000
#: Distinct features that a task counts before it passes the counts on.
COUNTED = 150_000
_STRIP = b".,;:!?\"'()[]{}|*#$%&<>-_"


@dataclass
class Model:
    scores: dict[bytes, float]  # of words, and of prefixes after a zero byte
    other: float  # of any other word
    ln_k: float  # of the extreme-value law of the largest segment score: P(S > x) = 1 - exp(-K n e^-x)
    slope: float = 1.0
    bias: float = 0.0


class _Scores(dict):
    """Score of a word as it stands in a text."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, raw: bytes) -> float:
        word, known = raw.lower().strip(_STRIP), self.model.scores
        score = known.get(word)
        if score is None:
            score = next((s for k in PREFIXES if len(word) > k and (s := known.get(b"\0" + word[:k])) is not None), self.model.other)
        if len(self) < WORDS:
            self[raw] = score
        return score


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end exclusive, score) in linear time (Ruzzo and Tompa): each is a run whose score
    can't be raised by lengthening or shortening, found through a stack of candidates."""
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[list] = []  # begin, end, sum before, sum at end, last candidate with a smaller sum before
    for i in up.tolist():
        begin, end, left, right = i, i + 1, float(total[i]), float(total[i + 1])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                stack.append([begin, end, left, right, j])
                break
            begin, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(b, e, r - s) for b, e, s, r, _ in stack]


def _features(raw: bytes) -> list[bytes]:
    word = raw.lower().strip(_STRIP)
    return [word, *(b"\0" + word[:k] for k in PREFIXES if len(word) > k)] if word else []


def _sample(labels: DataFrame, most: int) -> DataFrame:
    """doc_id and toxic of the training rows: labelled, not held out, one for each document, at most `most`."""
    one = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return one.filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def held_out(doc_id):
    """Whether a document is held out; one without an id isn't."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _counts(tokens: tuple[Counter, Counter], rows: tuple[Counter, Counter]):
    """The counts so far, as batches; then they're empty."""
    for side in (0, 1):
        items = list(tokens[side].items())
        for i in range(0, len(items), 50_000):
            part = items[i : i + 50_000]
            yield pa.RecordBatch.from_pydict({"feature": pa.array([f for f, _ in part], pa.binary()), "toxic": pa.array([side] * len(part), pa.int32()), "tokens": pa.array([c for _, c in part], pa.int64()), "docs": pa.array([rows[side][f] for f, _ in part], pa.int64())})
        tokens[side].clear()
        rows[side].clear()


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Model:
    """Fit on at most `most` labelled documents. Without labels of both classes nothing is toxic (score 0)."""
    spark = docs.sparkSession
    tune(spark)
    sample = docs.select("doc_id", "text").join(F.broadcast(written(_sample(labels, most))), "doc_id").select("doc_id", "text", "toxic")
    sample = written(sample.mapInArrow(_marked, T.StructType([*sample.schema, T.StructField("mark", T.LongType())])))
    # near copies, which mostly share their least shingle, would make rare words look telling: of each mark the least id's text stays, toxic if
    # any copy is
    sample = written(sample.groupBy("mark").agg(F.min_by("text", F.struct("doc_id", F.xxhash64("text"))).alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic"))
    schema = T.StructType().add("feature", "binary").add("toxic", "integer").add("tokens", "long").add("docs", "long")

    def count(batches):
        tokens: tuple[Counter, Counter] = (Counter(), Counter())
        rows: tuple[Counter, Counter] = (Counter(), Counter())
        known: dict[bytes, list[bytes]] = {}
        for part, texts in pieces(batches):
            for toxic, t in zip(part.column(part.schema.get_field_index("toxic")).to_pylist(), texts, strict=True):
                side, own = int(toxic > 0), Counter()
                for raw, k in Counter(t.split()).items():
                    if (f := known.get(raw)) is None:
                        f = known[raw] = _features(raw)
                    own[b""] += k * bool(f)
                    for x in f:
                        own[x] += k
                tokens[side].update(own)
                rows[side].update(own.keys())
            if len(known) > COUNTED or max(map(len, tokens)) > COUNTED:
                yield from _counts(tokens, rows)
                known.clear()
        yield from _counts(tokens, rows)

    on = lambda side, c: F.sum(F.when(F.col("toxic") == side, F.col(c)).otherwise(0))
    counted = sample.mapInArrow(count, schema).groupBy("feature").agg(on(1, "tokens").alias("yt"), on(0, "tokens").alias("yc"), F.sum("docs").alias("docs"))
    counted = written(counted.filter((F.col("docs") >= LEAST_DOCS) | (F.col("feature") == F.lit(b""))))
    n = counted.filter(F.col("feature") == F.lit(b"")).first()
    nt, nc = (n.yt, n.yc) if n else (0, 0)
    if not nt or not nc:
        return Model({}, -1.0, 0.0, 0.0, -30.0)
    prior = PRIOR * min(nt, nc)
    a = (F.col("yt") + F.col("yc")) * (prior / (nt + nc))
    odds = lambda y, n: F.log((y + a) / (n + prior - y - a))
    z = (odds(F.col("yt"), nt) - odds(F.col("yc"), nc)) / F.sqrt(1 / (F.col("yt") + a) + 1 / (F.col("yc") + a))
    least = math.sqrt(2 * math.log(max(2, counted.count())))
    kept = counted.filter(F.col("feature") != F.lit(b"")).withColumn("z", z).filter(F.abs("z") >= least).collect()  # the sample bounds their number
    share = lambda y, n, both: (y + both * prior / (nt + nc)) / (n + prior)
    scores = {bytes(r.feature): math.log(share(r.yt, nt, r.yt + r.yc) / share(r.yc, nc, r.yt + r.yc)) for r in kept}
    words = [r for r in kept if bytes(r.feature)[:1] != b"\0"]
    rest = [max(1e-6, 1 - sum(share(y, n, r.yt + r.yc) for r in words for y in [(r.yt if toxic else r.yc)])) for toxic, n in ((1, nt), (0, nc))]
    model = Model(scores, min(-1e-3, math.log(rest[0] / rest[1])), 0.0)
    # the law of the largest score on clean documents: E[S - ln n] = ln K + Euler's constant
    toxic = T.StructField("toxic", T.IntegerType())
    largest = sample.mapInArrow(_scorer(model, ["toxic"], _LARGEST), T.StructType([toxic, *_LARGEST])).filter("toxic <= 0 and n_words > 0")
    mean = largest.agg(F.avg(F.col("largest") - F.ln("n_words"))).first()[0]
    model.ln_k = mean - 0.5772156649 if mean is not None else 0.0
    # then a number for each document of the sample
    found = sample.mapInArrow(_scorer(model, ["toxic"], _EVIDENCE), T.StructType([toxic, *_EVIDENCE])).collect()
    x = np.array([r.evidence for r in found])
    model.slope, model.bias = _logistic(x, np.array([r.toxic > 0 for r in found], float))
    return model


def evidence(best: list[float], size: float) -> float:
    """Minus the log of how likely chance gives segments as high as the r best together, for the r by which that is least likely. size: ln(K n).

    By the joint law of the r largest segments, T = sum(S - ln(K n)) over them has P(T) = exp(-T) T^(r-1) / (r! (r-1)!) for large T, and
    each more segment halves the chance that r is looked at. The law's rate is 1, as scores are log-likelihood ratios. best: descending."""
    top = (best[0] if best else 0.0) - size
    out, total = top, top
    for r, s in enumerate(best[1:], 2):
        if s <= size:
            break
        total += s - size
        if total > r:
            out = max(out, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r) - (r - 1) * math.log(2))
    return out


def _marked(batches):
    """A mark that near copies mostly share: the least hash of five words in a row."""
    for part, texts in pieces(batches):
        marks = []
        for t in texts:
            w = t.lower().split()
            marks.append(min(xxhash.xxh3_64_intdigest(b" ".join(w[k : k + 5])) for k in range(max(1, len(w) - 4))) >> 1)
        yield column_out(part, part.schema.names, {"mark": pa.array(marks, pa.int64())})


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and bias of a logistic curve by Newton's method; targets are Platt's, which keep it finite."""
    pos = y.sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (len(y) - pos + 2))
    mean, sd = x.mean(), x.std() or 1.0
    u, w = (x - mean) / sd, np.zeros(2)
    d = np.stack([u, np.ones(len(u))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + 1e-6 * np.eye(2), d.T @ (target - p) - 1e-6 * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / sd), float(w[1] - w[0] * mean / sd)


_LARGEST = T.StructType().add("n_words", "long").add("largest", "double")
_EVIDENCE = T.StructType().add("evidence", "double")
PASSAGES = T.ArrayType(T.StructType().add("begin_word", "integer").add("end_word", "integer").add("segment_score", "double").add("p_value", "double"))
RESULT = T.StructType().add("n_words", "long").add("largest", "double").add("score", "double").add("passages", PASSAGES)


def _scorer(model: Model, keep: list[str], result: T.StructType):
    """Rows with what `result` names: _LARGEST, _EVIDENCE or RESULT."""

    def run(batches):
        get = _Scores(model).__getitem__
        kind = pa.list_(pa.struct([("begin_word", pa.int32()), ("end_word", pa.int32()), ("segment_score", pa.float64()), ("p_value", pa.float64())]))
        for part, texts in pieces(batches):
            n, largest, passages, score, sure = [], [], [], [], []
            for t in texts:
                words = t.split()
                s = np.fromiter(map(get, words), np.float64, len(words))
                found = segments(s)
                best = sorted((x[2] for x in found), reverse=True)
                n.append(len(s)), largest.append(best[0] if best else 0.0)
                size = math.log(max(1, len(s))) + model.ln_k
                sure.append(evidence(best, size))
                if "passages" in result.names:
                    expect = [(b, e, x, math.exp(min(50.0, size - x))) for b, e, x in found]
                    passages.append([{"begin_word": b, "end_word": e, "segment_score": x, "p_value": -math.expm1(-v)} for b, e, x, v in expect if v <= SEGMENT_E])
                    score.append(1 / (1 + math.exp(-max(-500.0, min(500.0, model.slope * sure[-1] + model.bias)))))
            new = {"n_words": pa.array(n, pa.int64()), "largest": pa.array(largest, pa.float64()), "evidence": pa.array(sure, pa.float64()), "score": pa.array(score, pa.float64()), "passages": pa.array(passages, kind)}
            yield column_out(part, keep, {c: new[c] for c in result.names})

    return run


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default doc_id) and RESULT: every significant toxic passage in words, and a score from how unlikely
    chance gives its best segments together in a text of its length.

    Only the text is an input. Null and empty texts score as one word without evidence. Repeated rows get a row each;
    columns named as the new ones are replaced."""
    tune(docs.sparkSession)
    keep = [c for c in keep or ["doc_id"] if c not in RESULT.names]
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(_scorer(model, keep, RESULT), T.StructType([*(docs.schema[c] for c in keep), *RESULT]))
