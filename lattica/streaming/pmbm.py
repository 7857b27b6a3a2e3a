"""A multi-target tracker with clusters of hypotheses, in any state dimension: a Poisson intensity of targets not yet seen, Bernoulli tracks, and
for each cluster a mixture of joint hypotheses over them.

A scan is a step of the state of one scenario. Scenarios are independent; scans of one are a recursion, so a task goes through its scenarios
scan by scan and holds one state, or a stream keeps a state for each scenario until its time is over."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.lineage import dealt
from ..operators.cutting import small_cuts
from ..operators.mixtures import reduced
from ..operators.search import best_joint, listed_joint

OUTPUT = "scenario long, scan long, track long, x array<double>, exi double, n_hypotheses int, n_components int"
STREAMED = OUTPUT + ", kind string"


@dataclass
class Model:
    """Motion and measurement matrices, and what is kept. birth: components (weight, mean, covariance) that come with each scan."""

    motion: np.ndarray
    process: np.ndarray
    measure: np.ndarray
    noise: np.ndarray
    birth: list[tuple[float, np.ndarray, np.ndarray]]
    survival: float = 0.99
    detection: float = 0.9
    clutter: float = 1e-4
    gate: float = 13.8
    hypotheses: int = 100
    tail: float = 0.0006
    least: float = 0.0006
    scans: int = 3
    recycle: float = 0.1
    components: int = 20
    weight: float = 1e-5
    apart: float = 0.999
    report: float = 0.5


def constant_velocity(dims: int = 2, period: float = 1.0, acceleration: float = 0.5, noise: float = 9.0, birth: list | None = None, **settings) -> Model:
    """Positions and velocities in `dims` dimensions; a state has the positions first."""
    one, zero = np.eye(dims), np.zeros((dims, dims))
    motion = np.block([[one, period * one], [zero, one]])
    process = acceleration * np.block([[period**3 / 3 * one, period**2 / 2 * one], [period**2 / 2 * one, period * one]])
    return Model(motion, process, np.hstack([one, zero]), noise * one, birth or [], **settings)


@dataclass
class Track:
    label: int
    x: np.ndarray
    p: np.ndarray
    exi: float
    history: tuple[int, ...]


@dataclass
class World:
    """last scan, next number of a label, intensity, tracks by number, and clusters as lists of (tracks, log-probability)."""

    last: int | None = None
    labels: int = 1
    intensity: list[tuple[float, np.ndarray, np.ndarray]] = field(default_factory=list)
    tracks: dict[int, Track] = field(default_factory=dict)
    clusters: list[list[tuple[tuple[int, ...], float]]] = field(default_factory=list)

    def dumped(self) -> str:
        gauss = lambda x, p: [x.tolist(), p.tolist()]
        return json.dumps([self.last, self.labels, [[w, *gauss(x, p)] for w, x, p in self.intensity], [[k, t.label, *gauss(t.x, t.p), t.exi, t.history] for k, t in self.tracks.items()], self.clusters])

    @staticmethod
    def loaded(text: str) -> World:
        last, labels, intensity, tracks, clusters = json.loads(text)
        return World(last, labels, [(w, np.array(x), np.array(p)) for w, x, p in intensity], {k: Track(n, np.array(x), np.array(p), e, tuple(h)) for k, n, x, p, e, h in tracks}, [[(tuple(ts), lp) for ts, lp in c] for c in clusters])


def _predicted(x: np.ndarray, p: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    return x @ m.motion.T, m.motion @ p @ m.motion.T + m.process


def _updated(x: np.ndarray, p: np.ndarray, z: np.ndarray, m: Model) -> tuple[np.ndarray, ...]:
    """Of Gaussians and measurements: squared distances and log-densities of innovations, the means after each (by Gaussian and measurement),
    and the covariances after any (by Gaussian)."""
    s, nu = m.measure @ p @ m.measure.T + m.noise, z - (x @ m.measure.T)[:, None]
    low = np.linalg.cholesky(s)
    d = (np.linalg.solve(low, nu.transpose(0, 2, 1)) ** 2).sum(1)
    log = -0.5 * d - np.log(np.diagonal(low, axis1=1, axis2=2)).sum(1)[:, None] - 0.5 * len(m.measure) * math.log(2 * math.pi)
    turned = np.linalg.solve(s, m.measure @ p)
    return d, log, x[:, None] + nu @ turned, (np.eye(x.shape[1]) - turned.transpose(0, 2, 1) @ m.measure) @ p


def _stacked(parts: list[tuple[np.ndarray, np.ndarray]], m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Means and covariances of a list, as arrays."""
    n = len(m.motion)
    return np.array([x for x, _ in parts]).reshape(-1, n), np.array([p for _, p in parts]).reshape(-1, n, n)


def _moments(parts: list[tuple[float, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    w, x, p = (np.array(a) for a in zip(*parts, strict=True))
    w = w / w.sum()
    mean = w @ x
    return mean, np.tensordot(w, p, 1) + (w[:, None] * (x - mean)).T @ (x - mean)


def _normal(hypos: list[tuple[tuple[int, ...], float]]) -> list[tuple[tuple[int, ...], float]]:
    """Equal hypotheses as one, probabilities that sum to 1, the likeliest first."""
    own: dict[tuple[int, ...], list[float]] = {}
    for ts, lp in hypos:
        own.setdefault(tuple(sorted(set(ts))), []).append(lp)
    sums = {ts: _log_sum(lps) for ts, lps in own.items()}
    total = _log_sum(list(sums.values()))
    return sorted(((ts, lp - total) for ts, lp in sums.items()), key=lambda h: (-h[1], h[0]))


def _log_sum(xs: list[float]) -> float:
    top = max(xs, default=-math.inf)
    return top if len(xs) < 2 or top == -math.inf else top + math.log(sum([math.exp(x - top) for x in xs]))


def _mass(clusters: list) -> dict[int, float]:
    out: dict[int, float] = {}
    for c in clusters:
        for ts, lp in c:
            for t in ts:
                out[t] = out.get(t, 0.0) + math.exp(lp)
    return out


def _superclusters(clusters: list, weights: dict[int, dict[int, float]], m: Model) -> list[list[int]]:
    """Clusters that share measurements, after edges are cut where they'd be too many; weights of cut edges go."""
    edges: dict[tuple[int, int], float] = {}
    for c, hypos in enumerate(clusters):
        for t in {t for ts, _ in hypos for t in ts}:
            for j, ll in weights[t].items():
                if j > 0:
                    edges[c, j] = max(edges.get((c, j), -math.inf), ll)
    cuts = small_cuts([(c, j, ll, False) for (c, j), ll in edges.items()], {c: max(len(ts) for ts, _ in hs) for c, hs in enumerate(clusters)}, {c: len(hs) for c, hs in enumerate(clusters)})
    for c, j in cuts:
        del edges[c, j]
        for t in {t for ts, _ in clusters[c] for t in ts}:
            weights[t].pop(j, None)
    top = list(range(len(clusters)))

    def root(c):
        while top[c] != c:
            c = top[c]
        return c

    first: dict[int, int] = {}
    for c, j in sorted(edges):
        a, b = root(c), root(first.setdefault(j, c))
        top[max(a, b)] = min(a, b)
    groups: dict[int, list[int]] = {}
    for c in range(len(clusters)):
        groups.setdefault(root(c), []).append(c)
    return list(groups.values())


def _merged(w: World, n: int) -> None:
    """Tracks of one label with equal histories over the last n scans become one."""
    mass, groups = _mass(w.clusters), {}
    for k, t in w.tracks.items():
        groups.setdefault((t.label, t.history[-n:]), []).append(k)
    new = {k: ks[0] for ks in groups.values() for k in ks}
    for ks in groups.values():
        if len(ks) > 1:
            own = [(max(mass.get(k, 0.0), 1e-300), w.tracks[k]) for k in ks]
            x, p = _moments([(v, t.x, t.p) for v, t in own])
            exi = sum(v * t.exi for v, t in own) / sum(v for v, _ in own)
            strongest = max(own, key=lambda o: o[0])[1]
            w.tracks[ks[0]] = Track(strongest.label, x, p, exi, strongest.history)
    gone = {k for k, kept in new.items() if k != kept}
    w.clusters = [_normal([(tuple(new[t] for t in ts), lp) for ts, lp in c]) if _has(c, gone) else c for c in w.clusters]


def _has(cluster: list, tracks: set[int]) -> bool:
    return bool(tracks) and not all(tracks.isdisjoint(ts) for ts, _ in cluster)


def _pruned(clusters: list, m: Model) -> list:
    """One cap for all clusters: what isn't doubtful stays, then clusters bid in turn."""
    kept, bids = [], []
    for c, hypos in enumerate(clusters):
        if len(hypos) == 1 or len(hypos) <= m.hypotheses and math.exp(hypos[-1][1]) >= m.least:  # the last is the least likely
            kept.append(hypos)
            continue
        p = np.exp([lp for _, lp in hypos])
        after = p[::-1].cumsum()[::-1] - p
        doubtful = ((after < m.tail) & (p < m.least)) | (np.arange(len(p)) >= m.hypotheses)
        doubtful[0] = False
        kept.append([h for h, d in zip(hypos, doubtful, strict=True) if not d])
        bids += [(turn, -hypos[k][1], c, k) for turn, k in enumerate(np.flatnonzero(doubtful).tolist())]
    room = m.hypotheses - sum(map(len, kept))
    for _, _, c, k in sorted(bids)[: max(0, room)]:
        kept[c].append(clusters[c][k])
    return [_normal(c) if len(c) < len(hypos) else c for c, hypos in zip(kept, clusters, strict=True)]


def _split(w: World, m: Model) -> None:
    """Tracks that nearly all of a cluster's mass has become clusters of their own."""
    out = []
    for c in w.clusters:
        mass = _mass([c])
        own = {t for t, p in mass.items() if p > m.apart} if any(len(ts) > 1 for ts, _ in c) else set()
        if not own:
            out.append(c)
            continue
        rest = _normal([(tuple(t for t in ts if t not in own), lp) for ts, lp in c])
        out += [[((t,), math.log(min(1.0, mass[t]))), *([((), math.log(1 - mass[t]))] if mass[t] < 1 - 1e-12 else [])] for t in sorted(own)]
        out.append(rest)
    w.clusters = [c for c in out if any(ts for ts, _ in c)]


def step(w: World, z: np.ndarray, m: Model, scan: int) -> World:
    """The state after a scan with measurements z (rows); the state before isn't changed. Scans that were left out are predicted through."""
    z = z if (n := len(z)) else np.zeros((0, len(m.measure)))
    v, (x, p) = np.array([v for v, *_ in w.intensity]), _stacked([(x, p) for _, x, p in w.intensity], m)
    born_v, (born_x, born_p) = np.array([v for v, *_ in m.birth]), _stacked([(x, p) for _, x, p in m.birth], m)
    place, (tx, tp), exi = {k: i for i, k in enumerate(w.tracks)}, _stacked([(t.x, t.p) for t in w.tracks.values()], m), np.array([t.exi for t in w.tracks.values()])
    for _ in range(1 if w.last is None else max(1, scan - w.last)):
        x, p = _predicted(x, p, m)
        v, x, p = np.concatenate([v * m.survival, born_v]), np.concatenate([x, born_x]), np.concatenate([p, born_p])
        (tx, tp), exi = _predicted(tx, tp, m), exi * m.survival
    # what new targets explain of each measurement, and the track that would start there
    d, log, after, spread = _updated(x, p, z, m)
    share = np.where(d < m.gate, v[:, None] * m.detection * np.exp(log), 0.0)
    unseen = share.sum(0)
    share = share / np.where(unseen > 0, unseen, 1.0)
    mean = np.einsum("ij,ijk->jk", share, after)
    off = after - mean
    cov = np.tensordot(share.T, spread, 1) + (share[:, :, None] * off).transpose(1, 2, 0) @ off.transpose(1, 0, 2)
    born = {j: (mean[j], cov[j]) for j in np.flatnonzero(unseen > 0).tolist()}
    intensity = list(zip((v * (1 - m.detection)).tolist(), x, p, strict=True))
    missed = 1 - exi * m.detection
    d, log, after, spread = _updated(tx, tp, z, m)
    own, gate = np.log(exi * m.detection)[:, None] + log - np.log(m.clutter + unseen), d < m.gate
    weights = {k: {0: ll} for k, ll in zip(place, np.log(missed).tolist(), strict=True)}
    numbers = list(place)
    for i, j, ll in zip(*(a.tolist() for a in np.nonzero(gate)), own[gate].tolist(), strict=True):
        weights[numbers[i]][j + 1] = ll
    unseen, exi, missed = unseen.tolist(), exi.tolist(), missed.tolist()
    out = World(scan, w.labels, intensity)
    children: dict[tuple[int, int], int] = {}

    def child(k: int, j: int) -> int:
        """The number of a track's successor by measurement j (0: missed), or of the track that starts at j (k < 0)."""
        if (k, j) not in children:
            children[k, j] = len(children)
            if k < 0:
                out.tracks[children[k, j]] = Track(out.labels, *born[j - 1], unseen[j - 1] / (m.clutter + unseen[j - 1]), (j,))
                out.labels += 1
            else:
                t, i = w.tracks[k], place[k]
                now = (tx[i], tp[i], exi[i] * (1 - m.detection) / missed[i]) if j == 0 else (after[i, j - 1], spread[i], 1.0)
                out.tracks[children[k, j]] = Track(t.label, *now, (*t.history[1 - m.scans :], j) if m.scans > 1 else (j,))
        return children[k, j]

    claimed: set[int] = set()
    for group in _superclusters(w.clusters, weights, m):
        hypos = [[(c, k, list(ts), lp) for k, (ts, lp) in enumerate(w.clusters[c])] for c in group]
        gated = {j for hs in hypos for h in hs for t in h[2] for j in weights[t] if j > 0}
        claimed |= gated
        found = listed_joint(hypos, weights, m.hypotheses)
        if found is None:
            found, _, _ = best_joint(hypos, weights, m.hypotheses)
        rows = []
        for _, picks, ll in found:
            taken = {j for _, j in picks}
            starts = [child(-1, j) for j in sorted(gated - taken) if j - 1 in born]
            rows.append((tuple([child(t, j) for t, j in picks] + starts), ll))
        out.clusters.append(_normal(rows))
    for j in range(1, n + 1):
        if j not in claimed and j - 1 in born:
            out.clusters.append([((child(-1, j),), 0.0)])
    _merged(out, m.scans)
    out.clusters = _pruned(out.clusters, m)
    # what hardly exists goes back to the intensity
    mass = _mass(out.clusters)
    weak = {k for k, t in out.tracks.items() if k in mass and t.exi < m.recycle}
    out.intensity += [(mass[k] * out.tracks[k].exi, out.tracks[k].x, out.tracks[k].p) for k in sorted(weak)]
    out.clusters = [_normal([(tuple(t for t in ts if t not in weak), lp) for ts, lp in c]) if _has(c, weak) else c for c in out.clusters]
    _split(out, m)
    if out.intensity:
        v, x, p = (np.array(a) for a in zip(*out.intensity, strict=True))
        out.intensity = [(a, b, c) for a, b, c, _ in reduced(v, x, p, m.components, m.weight)]
    used = {t for c in out.clusters for ts, _ in c for t in ts}
    out.tracks = {k: t for k, t in out.tracks.items() if k in used}
    return out


def estimates(w: World, m: Model) -> list[tuple[int, np.ndarray, float]]:
    """(label, state, existence) of the tracks that exist by more than `report` in the likeliest hypothesis of each cluster."""
    out = []
    for c in w.clusters:
        best = max(c, key=lambda h: h[1] + sum(math.log(max(w.tracks[t].exi, 1 - w.tracks[t].exi, 1e-300)) for t in h[0]))
        out += [(w.tracks[t].label, w.tracks[t].x, w.tracks[t].exi) for t in best[0] if w.tracks[t].exi > m.report]
    return sorted(out, key=lambda e: e[0])


def _measurements(rows: list) -> np.ndarray:
    """A scan's measurements in an order of their own; null ones and those with other than finite entries aren't any."""
    good = [tuple(float(v) for v in r) for r in rows if r is not None and all(v is not None and math.isfinite(v) for v in r)]
    return np.array(sorted(good), float) if good else np.zeros((0, 0))


def _told(scenario: int, w: World, m: Model) -> list[tuple]:
    return [(scenario, w.last, label, x.tolist(), exi, sum(map(len, w.clusters)), len(w.intensity)) for label, x, exi in estimates(w, m)]


def track(measurements: DataFrame, model: Model) -> DataFrame:
    """OUTPUT for measurements (scenario, scan, z): estimates after each scan that has rows (a null z makes a scan without measurements). Rows come
    sorted, and a task holds the state of one scenario and one scan's rows. Rows with a null scenario or scan are left out; repeated
    rows are measurements of their own. Other columns aren't read."""
    rows = measurements.select(F.col("scenario").cast("long").alias("scenario"), F.col("scan").cast("long").alias("scan"), F.col("z").cast("array<double>").alias("z")).dropna(subset=["scenario", "scan"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = (r for b in batches for r in zip(b["scenario"].tolist(), b["scan"].tolist(), b["z"].tolist(), strict=True))
        out: list[tuple] = []
        names = [c.split()[0] for c in OUTPUT.split(", ")]
        for scenario, scans in groupby(every, key=lambda r: r[0]):
            w = World()
            for scan, own in groupby(scans, key=lambda r: r[1]):
                w = step(w, _measurements([r[2] for r in own]), model, int(scan))
                out += _told(int(scenario), w, model)
                if len(out) > 2000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    return dealt(rows, "scenario").sortWithinPartitions("scenario", "scan").mapInPandas(run, OUTPUT)


class Tracker(StatefulProcessor):
    """The tracker over a stream. A scan's rows wait until the watermark has passed its time, so scans are worked on in their order however
    late rows come; what comes for a scan that's over is told as `late`, and is no part of a state. `idle` after a scenario's last scan its state
    goes, told as `over`."""

    def __init__(self, model: Model, idle_ms: int):
        self.model, self.idle_ms = model, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.world = handle.getValueState("world", "text string")
        self.waiting = handle.getMapState("waiting", "ms long", "scan long, rows string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark, late = timerValues.getCurrentWatermarkInMs(), []
        last = World.loaded(self.world.get()[0]).last if self.world.exists() else None
        for batch in rows:
            for ms, scan, z in zip(batch["ms"].tolist(), batch["scan"].tolist(), batch["z"].tolist(), strict=True):
                if ms <= mark or last is not None and scan <= last:
                    late.append((int(key[0]), int(scan), None, None, None, None, None, "late"))
                    continue
                before = json.loads(self.waiting.getValue((ms,))[1]) if self.waiting.containsKey((ms,)) else []
                if not before:
                    self.handle.registerTimer(ms)
                self.waiting.updateValue((ms,), (int(scan), json.dumps([*before, None if z is None else [float(v) for v in z]])))
        yield self._frame(late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ms, out = expiredTimerInfo.getExpiryTimeInMs(), []
        w = World.loaded(self.world.get()[0]) if self.world.exists() else World()
        # several may be over at once, and timers may come in any order: all up to this one, in theirs
        due = sorted(k[0] for k in self.waiting.keys() if k[0] <= ms)
        for k in due:
            scan, rows = self.waiting.getValue((k,))
            w = step(w, _measurements(json.loads(rows)), self.model, int(scan))
            out += [(*r, "track") for r in _told(int(key[0]), w, self.model)]
            self.waiting.removeKey((k,))
        if due:
            self.world.update((w.dumped(),))
            self.handle.registerTimer(due[-1] + self.idle_ms)
        elif self.world.exists() and not any(True for _ in self.waiting.keys()):
            out.append((int(key[0]), w.last, None, None, None, None, None, "over"))
            self.world.clear()
        yield self._frame(out)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in STREAMED.split(", ")])
        return out.astype({"scenario": "int64", "scan": "Int64", "track": "Int64", "exi": "Float64", "n_hypotheses": "Int32", "n_components": "Int32"})

    def close(self) -> None:
        pass


def track_stream(measurements: DataFrame, model: Model, delay: str, idle_ms: int) -> DataFrame:
    """STREAMED (OUTPUT and `kind`: track, late, over) of a stream of measurements (scenario, scan, ts, z), one ts for all rows of a scan. `delay` is how
    late rows may come. Needs the RocksDB state store."""
    rows = measurements.withWatermark("ts", delay).select(F.col("scenario").cast("long").alias("scenario"), F.col("scan").cast("long").alias("scan"), "ts", F.unix_millis("ts").alias("ms"), F.col("z").cast("array<double>").alias("z"))
    return rows.groupBy("scenario").transformWithStateInPandas(Tracker(model, idle_ms), STREAMED, "append", "eventTime")
