"""Gaussian mixtures: greedy reduction by Runnalls' bound."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import dealt

#: Pairs whose bounds are taken at once.
PAIRS = 20_000


def _bounds(w: np.ndarray, mean: np.ndarray, cov: np.ndarray, log_det: np.ndarray, i: int | np.ndarray, others: np.ndarray) -> np.ndarray:
    """What merging components i with others costs at most: ((w1 + w2) ln|P| - w1 ln|P1| - w2 ln|P2|) / 2."""
    own = w[others]
    total = w[i] + own
    b = own / total
    a, d = 1 - b, mean[others] - mean[i]
    off = np.sqrt(a * b)[:, None] * d
    p = a[:, None, None] * cov[i] + b[:, None, None] * cov[others] + off[:, :, None] * off[:, None, :]
    return 0.5 * (total * np.linalg.slogdet(p)[1] - w[i] * log_det[i] - own * log_det[others])


def reduced(w: np.ndarray, mean: np.ndarray, cov: np.ndarray, most: int, least: float = 1e-5, dearest: float = np.inf, always: float = 0.0) -> list[tuple[float, np.ndarray, np.ndarray, list[int]]]:
    """Components (weight, mean, covariance, the numbers of those merged). Those under `least` go; then the pair that costs least is merged, ties by
    the least numbers, while over `most` are left and it costs under `dearest`, or it costs under `always`. Each component knows
    which of those before it is cheapest; after a merge those look anew that have lost theirs, and costs of the new component alone are added."""
    alive = [int(k) for k in np.flatnonzero(w >= least)]
    n = len(w)
    size = n + max(0, len(alive) - 1)
    weight, at, spread, log_det = np.zeros(size), np.zeros((size, mean.shape[1])), np.zeros((size, *cov.shape[1:])), np.zeros(size)
    weight[:n], at[:n], spread[:n] = w, mean, cov
    if n:
        log_det[:n] = np.linalg.slogdet(cov)[1]
    members, left, new = {k: [k] for k in alive}, dict.fromkeys(alive), n
    # by component and one before it; the cheapest of them, and its cost
    cost, partner, low = np.full((size, size), np.inf), np.zeros(size, int), np.full(size, np.inf)
    later, sooner = np.tril_indices(len(alive), -1)
    for k in range(0, len(later), PAIRS):
        j, i = (np.array(alive)[x[k : k + PAIRS]] for x in (later, sooner))
        cost[j, i] = _bounds(weight, at, spread, log_det, j, i)
    if size:
        partner, low = cost.argmin(1), cost.min(1)
    while len(left) > 1:
        j = int(low.argmin())
        least = low[j]
        if not (len(left) > most and least < dearest or least < always):
            break
        if len(same := np.flatnonzero(low == least)) > 1:
            j = int(same[partner[same].argmin()])
        i = int(partner[j])
        total = weight[i] + weight[j]
        d = at[i] - at[j]
        weight[new], at[new] = total, (weight[i] * at[i] + weight[j] * at[j]) / total
        spread[new] = (weight[i] * spread[i] + weight[j] * spread[j]) / total + weight[i] * weight[j] / total**2 * (d[:, None] * d)
        log_det[new], members[new] = (2 * least + weight[i] * log_det[i] + weight[j] * log_det[j]) / total, sorted(members[i] + members[j])
        del left[i], left[j]
        cost[:, i] = cost[:, j] = low[i] = low[j] = np.inf
        lost = np.flatnonzero(((partner == i) | (partner == j)) & (low < np.inf))
        if len(lost):
            own = cost[lost, :new]
            partner[lost] = own.argmin(1)
            low[lost] = own.min(1)
        if left:
            others = np.array(list(left))
            own = _bounds(weight, at, spread, log_det, new, others)
            cost[new, others] = own
            k = own.argmin()
            partner[new], low[new] = others[k], own[k]
        left[new] = None
        new += 1
    return [(float(weight[k]), at[k], spread[k], members[k]) for k in left]


def reduce_mixture(w: np.ndarray, mean: np.ndarray, cov: np.ndarray, most: int, least: float = 1e-5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and covariances of `reduced`."""
    out = reduced(w, mean, cov, most, least)
    d = mean.shape[1]
    return np.array([x[0] for x in out]), np.array([x[1] for x in out]).reshape(-1, d), np.array([x[2] for x in out]).reshape(-1, d, d)


REDUCED = "frame long, component int, weight double, x array<double>, p array<double>, members array<int>"
#: Numbers that the covariances of all pairs of mixtures of one size have at most; mixtures of over MANY components are reduced one by one.
CELLS, MANY = 1_000_000, 64


def reduced_all(w: np.ndarray, mean: np.ndarray, cov: np.ndarray, most: int, dearest: float = np.inf, always: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """`reduced` of many mixtures (the first axis) of as many components, none too light: weights, means and covariances, which are left, and for each
    original component the one it's in. A merged component stands last, so that ties go as there."""
    f, n = w.shape
    size = max(1, 2 * n - 1)
    weight, at, spread, log_det = np.zeros((f, size)), np.zeros((f, size, mean.shape[2])), np.zeros((f, size, *cov.shape[2:])), np.zeros((f, size))
    weight[:, :n], at[:, :n], spread[:, :n], log_det[:, :n] = w, mean, cov, np.linalg.slogdet(cov)[1]
    left, inside = np.zeros((f, size), bool), np.tile(np.arange(n), (f, 1))
    left[:, :n] = True
    # by component and one before it
    cost = np.full((f, size, size), np.inf)

    def bounds(rows: np.ndarray, j: np.ndarray, i: np.ndarray) -> np.ndarray:
        u, v = weight[rows, j], weight[rows, i]
        total = u + v
        b = v / total
        a, d = 1 - b, at[rows, i] - at[rows, j]
        off = np.sqrt(a * b)[..., None] * d
        p = a[..., None, None] * spread[rows, j] + b[..., None, None] * spread[rows, i] + off[..., :, None] * off[..., None, :]
        return 0.5 * (total * np.linalg.slogdet(p)[1] - u * log_det[rows, j] - v * log_det[rows, i])

    later, sooner = np.tril_indices(n, -1)
    on = np.arange(f)
    cost[:, later, sooner] = bounds(on[:, None], later[None], sooner[None])
    for new in range(n, size):
        low = cost[on].reshape(len(on), -1).min(1)
        go = (left[on].sum(1) > 1) & (((left[on].sum(1) > most) & (low < dearest)) | (low < always))
        on, low = on[go], low[go]
        if not len(on):
            break
        # of equal costs the least earlier component, then the least later one
        i, j = np.divmod((cost[on] == low[:, None, None]).transpose(0, 2, 1).reshape(len(on), -1).argmax(1), size)
        u, v = weight[on, i], weight[on, j]
        total = u + v
        d = at[on, i] - at[on, j]
        weight[on, new] = total
        at[on, new] = (u[:, None] * at[on, i] + v[:, None] * at[on, j]) / total[:, None]
        both = u[:, None, None] * spread[on, i] + v[:, None, None] * spread[on, j]
        spread[on, new] = both / total[:, None, None] + (u * v / total**2)[:, None, None] * (d[:, :, None] * d[:, None, :])
        log_det[on, new] = (2 * low + u * log_det[on, i] + v * log_det[on, j]) / total
        inside[on] = np.where((inside[on] == i[:, None]) | (inside[on] == j[:, None]), new, inside[on])
        left[on, i] = left[on, j] = False
        for k in (i, j):
            cost[on, k], cost[on, :, k] = np.inf, np.inf
        some = np.arange(new)
        cost[on, new, :new] = np.where(left[on, :new], bounds(on[:, None], np.full((1, 1), new), some[None]), np.inf)
        left[on, new] = True
    return weight, at, spread, left, inside


def reduced_components(components: DataFrame, most: int, least: float = 1e-5, dearest: float = float("inf"), always: float = 0.0) -> DataFrame:
    """REDUCED: the mixture of each frame, (frame, component, weight, x, p), with `most` components at best; p has its rows end to end. A merged
    component is named by its least member; a frame's components stand in one row, and mixtures of as many components are reduced at once."""
    names = [c.split()[0] for c in REDUCED.split(", ")]

    def rows_of(frame: np.ndarray, name: np.ndarray, w: np.ndarray, x: np.ndarray, p: np.ndarray) -> list[tuple]:
        weight, at, spread, left, inside = reduced_all(w, x, p, most, dearest, always)
        f, k = np.nonzero(left)
        own = inside[f] == k[:, None]
        flat = spread[f, k].reshape(len(f), -1)
        members = [name[r][m].tolist() for r, m in zip(f.tolist(), own, strict=True)]
        return list(zip(frame[f].tolist(), [min(m) for m in members], weight[f, k].tolist(), at[f, k].tolist(), flat.tolist(), members, strict=True))

    def run(batches):
        for batch in batches:
            out, sizes = [], {}
            for row in zip(batch["frame"], *(batch[c] for c in ("component", "weight", "x", "p")), strict=True):
                frame, name, w = row[0], np.asarray(row[1]), np.asarray(row[2], float)
                x, p = (np.concatenate(v).reshape(len(name), -1) for v in row[3:])
                keep = w >= least
                n, d = int(keep.sum()), x.shape[1]
                if n <= MANY:
                    sizes.setdefault((n, d), []).append((frame, name[keep], w[keep], x[keep], p[keep]))
                    continue
                found = reduced(w, x, p.reshape(-1, d, d), most, least, dearest, always)
                out += [(frame, min(name[own].tolist()), v, m.tolist(), c.ravel().tolist(), name[own].tolist()) for v, m, c, own in found]
            for (n, d), rows in sizes.items():
                if not n:
                    continue
                step = max(1, CELLS // (4 * n * n * d * d))
                for k in range(0, len(rows), step):
                    frame, name, w, x, p = (np.array(v) for v in zip(*rows[k : k + step], strict=True))
                    out += rows_of(frame, name, w, x, p.reshape(len(w), n, d, d))
            yield pd.DataFrame(out, columns=names)

    good = components.select("frame", F.col("component").cast("int").alias("component"), F.col("weight").cast("double").alias("weight"), F.col("x").cast("array<double>").alias("x"), F.col("p").cast("array<double>").alias("p"))
    one = good.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("component", "weight", "x", "p"))).alias("c"))
    return dealt(one.select("frame", "c.component", "c.weight", "c.x", "c.p"), "frame").mapInPandas(run, REDUCED)
