"""Loopy belief propagation over tracks, measurements and the hypotheses of several clusters, and Bethe and PHD evidence.

Frames are small and many: each task takes a share of them, pads them to arrays (frame, track, measurement), and passes
messages for all at once. A relational form of the same steps is the oracle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shapes import WORD, flat
from .single import single_hypothesis  # noqa: F401 (its former place)

#: Stop when the Bethe log-evidence changes by no more than the first and the messages by no more than the second; once met, a
#: criterion stays met.
BETHE_TOL, MESSAGE_TOL, MAX_ITERATIONS = 1e-7, 1e-5, 10_000
#: Frames that a task works on together.
SHARE = 2000

RESULT = "frame long, kind string, track int, meas int, cluster int, hypo int, p double, log_z double, iterations int, bethe_iterations int, message_iterations int"


class Frames:
    """Arrays of some frames: w (detection weights), w0, one hypothesis table for all clusters, and masks."""

    def __init__(self, reward: pd.DataFrame, hypo: pd.DataFrame):
        self.frames = np.unique(reward["frame"])
        at = np.searchsorted(self.frames, reward["frame"])
        # tracks and measurements are numbered anew in each frame, so that arrays are as wide as the largest frame, not the largest number
        t_place, self.track_of = _numbered(at, reward["track"].to_numpy(int), len(self.frames))
        hit = reward["meas"].to_numpy(int) > 0
        j_place, self.meas_of = _numbered(at[hit], reward["meas"].to_numpy(int)[hit], len(self.frames))
        n, m = self.track_of.shape[1], self.meas_of.shape[1]
        self.w, self.w0, self.track = np.zeros((len(self.frames), n, max(m, 1))), np.ones((len(self.frames), n)), np.zeros((len(self.frames), n), bool)
        t, e = t_place, np.exp(reward["ll"].to_numpy(float))
        self.w0[at[~hit], t[~hit]] = e[~hit]
        self.w[at[hit], t[hit], j_place] = e[hit]
        self.track[at, t] = True
        self.meas = (self.w > 0).any(axis=1)
        h = hypo[np.isin(hypo["frame"], self.frames)]
        self.h_frame = np.searchsorted(self.frames, h["frame"])
        self.h_cluster, self.h_hypo = h["cluster"].to_numpy(int), h["hypo"].to_numpy(int)
        self.clusters, of = np.unique(np.stack([self.h_frame, self.h_cluster], 1), axis=0, return_inverse=True)
        self.h_group, self.c_frame = of.ravel(), self.clusters[:, 0]
        prob = h["prob"].to_numpy(float)
        self.phi = prob / np.bincount(self.h_group, prob)[self.h_group]
        self.has = np.zeros((len(h), n), bool)
        tracks, row = flat(h["tracks"], int)
        known, first = np.unique(at * WORD + reward["track"].to_numpy(int), return_index=True)
        where = np.minimum(np.searchsorted(known, key := self.h_frame[row] * WORD + tracks), len(known) - 1)
        own = known[where] == key
        self.has[row[own], t_place[first[where[own]]]] = True
        self.of = np.zeros((len(self.clusters), n), bool)
        np.logical_or.at(self.of, self.h_group, self.has)
        self.track &= self._by_frame(self.of)

    def _by_frame(self, of: np.ndarray) -> np.ndarray:
        out = np.zeros(self.track.shape, bool)
        np.logical_or.at(out, self.c_frame, of)
        return out

    def hypothesis_mass(self, rho: np.ndarray) -> np.ndarray:
        return self.phi * np.where(self.has, rho[self.h_frame], 1.0).prod(axis=1)

    def sigma(self, rho: np.ndarray) -> np.ndarray:
        mass, inside = self.hypothesis_mass(rho), np.zeros((len(self.clusters), rho.shape[1]))
        np.add.at(inside, self.h_group, self.has * mass[:, None])
        total = np.bincount(self.h_group, mass, len(self.clusters))
        out = np.zeros(rho.shape)
        with np.errstate(divide="ignore", invalid="ignore"):
            part = np.where(self.of, rho[self.c_frame] * (total[:, None] - inside) / inside, 0.0)
        np.add.at(out, self.c_frame, part)
        return out

    def bethe(self, mu: np.ndarray, nu: np.ndarray, rho: np.ndarray, sigma: np.ndarray) -> np.ndarray:
        """Log-evidence of the pseudo-dual; pairs of tracks and measurements that the gate parts count as well."""
        n, m, f = self.track.sum(1), self.meas.sum(1), len(self.frames)
        wn = self.w * nu
        row = self.w0 + wn.sum(2)
        log = lambda x, mask: np.where(mask, np.log(np.where(mask, x, 1.0)), 0.0)
        mass = self.hypothesis_mass(rho)
        z_theta = np.bincount(self.h_group, mass, len(self.clusters))
        inside = np.zeros((len(self.clusters), rho.shape[1]))
        np.add.at(inside, self.h_group, self.has * mass[:, None])
        z_tth = row[self.c_frame] / np.where(self.of, rho[self.c_frame], 1.0) * inside + (z_theta[:, None] - inside)
        pair = self.track[:, :, None] & self.meas[:, None, :]
        z_tj = (1 + mu.sum(1, keepdims=True) - mu) * ((row + sigma)[:, :, None] - wn) + self.w
        f_theta = np.bincount(self.c_frame, (self.of.sum(1) - 1) * np.log(z_theta), f)
        f_t = m * log(row + sigma, self.track).sum(1)
        f_j = (n - 1) * log(1 + mu.sum(1), self.meas).sum(1)
        f_tth = np.bincount(self.c_frame, log(z_tth, self.of).sum(1), f)
        return -(f_theta + f_t + f_j - log(z_tj, pair).sum((1, 2)) - f_tth)


def _numbered(frame: np.ndarray, number: np.ndarray, frames: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of each number among those of its frame, and the numbers by frame and place (-1: none)."""
    pairs, of = np.unique(frame * WORD + number, return_inverse=True)
    own = pairs // WORD
    place = np.arange(len(pairs)) - np.searchsorted(own, own)
    out = np.full((frames, max(1, int(place.max(initial=0)) + 1)), -1)
    out[own, place] = pairs % WORD
    return place[of], out


def propagate(x: Frames, iterations: int | None = None, most: int = MAX_ITERATIONS, tol: tuple[float, float] = (BETHE_TOL, MESSAGE_TOL)):
    """Messages after a fixed number of iterations, or until both criteria have been met."""
    live = x.track[:, :, None] & (x.w > 0)
    w = np.where(live, x.w, 0.0)
    x.w = w
    out_of = lambda total, own: np.where(live, total - own, 1.0)
    mu = w / out_of(w.sum(2, keepdims=True) + x.w0[:, :, None] + 1.0, w)
    step_nu = lambda mu: 1.0 / (1.0 + mu.sum(1, keepdims=True) - mu)
    nu = step_nu(mu)
    rho = x.w0 + (w * nu).sum(2)
    sigma = x.sigma(rho)
    f = len(x.frames)
    last, last_nu = x.bethe(mu, nu, rho, sigma), nu
    met = np.zeros((2, f), int)
    done, k = np.zeros(f, int), 0
    while k < (most if iterations is None else iterations):
        k += 1
        wn = w * nu
        new_mu = w / out_of(wn.sum(2, keepdims=True) + (x.w0 + sigma)[:, :, None], wn)
        new_nu = step_nu(new_mu)
        new_rho = x.w0 + (w * new_nu).sum(2)
        new_sigma = x.sigma(new_rho)
        on = done == 0
        mu, nu = np.where(on[:, None, None], new_mu, mu), np.where(on[:, None, None], new_nu, nu)
        rho, sigma = np.where(on[:, None], new_rho, rho), np.where(on[:, None], new_sigma, sigma)
        b = x.bethe(mu, nu, rho, sigma)
        ratio = np.where(live, nu / last_nu, 1.0)
        err = np.log(np.maximum(ratio.max((1, 2)), 1 / ratio.min((1, 2))))
        met[0][(met[0] == 0) & on & (np.abs(b - last) <= tol[0])] = k
        met[1][(met[1] == 0) & on & (err <= tol[1])] = k
        last, last_nu = b, nu
        if iterations is None:
            done[on & (met > 0).all(axis=0)] = k
            if (done > 0).all():
                break
    done[done == 0] = k
    return mu, nu, rho, sigma, last, done, met


def _rows(x: Frames, iterations: int | None, most: int, tol: tuple[float, float]) -> pd.DataFrame:
    mu, nu, rho, sigma, log_z, done, met = propagate(x, iterations, most, tol)
    parts = []

    def add(kind, frame, p, **cols):
        part = {"frame": x.frames[frame], "kind": kind, "track": None, "meas": None, "cluster": None, "hypo": None, "p": p, "log_z": log_z[frame], "iterations": done[frame], "bethe_iterations": met[0][frame], "message_iterations": met[1][frame]} | cols
        parts.append(pd.DataFrame(part))

    total = x.w0 + (x.w * nu).sum(2) + sigma
    f, t = np.nonzero(x.track)
    add("missed", f, (x.w0 / total)[f, t], track=x.track_of[f, t], meas=0)
    add("nonexistence", f, (sigma / total)[f, t], track=x.track_of[f, t])
    f, t, j = np.nonzero(x.w > 0)
    add("detection", f, (x.w * nu / total[:, :, None])[f, t, j], track=x.track_of[f, t], meas=x.meas_of[f, j])
    add("measurement", f, (mu / (1 + mu.sum(1, keepdims=True)))[f, t, j], track=x.track_of[f, t], meas=x.meas_of[f, j])
    mass = x.hypothesis_mass(rho)
    add("theta", x.h_frame, mass / np.bincount(x.h_group, mass)[x.h_group], cluster=x.h_cluster, hypo=x.h_hypo)
    return pd.concat(parts, ignore_index=True)


def lbp(reward: DataFrame, h: DataFrame, frames: int, iterations: int | None = None, most: int = MAX_ITERATIONS, tol: tuple[float, float] = (BETHE_TOL, MESSAGE_TOL)) -> DataFrame:
    """RESULT: marginals of tracks (missed, detection, nonexistence) and of measurements, and posteriors of hypotheses (theta), with
    the Bethe log-evidence and iterations of their frame. `frames` is about how many there are; they're dealt by a hash."""
    shares = F.pmod(F.xxhash64("frame"), F.lit(max(1, -(-frames // SHARE)))).alias("share")

    def run(r: pd.DataFrame, hy: pd.DataFrame) -> pd.DataFrame:
        if not len(r):
            return pd.DataFrame(columns=[c.split()[0] for c in RESULT.split(", ")])
        out = _rows(Frames(r, hy), iterations, most, tol)
        for c in ("track", "meas", "cluster", "hypo"):
            out[c] = out[c].astype("Int32")
        return out

    # new names for the columns: both tables may come from one, and cogroup resolves its keys in either
    own = lambda df, *cols: df.select(*[F.col(c).alias(c) for c in cols], shares).groupBy("share")
    return own(reward, "frame", "track", "meas", "ll").cogroup(own(h, "frame", "cluster", "hypo", "tracks", "prob")).applyInPandas(run, RESULT)


def phd_evidence(reward: DataFrame) -> DataFrame:
    """frame, z: exp(-sum(1 - w0)) times the product over gated measurements of 1 plus their tracks' weights."""
    missed = reward.filter("meas = 0").groupBy("frame").agg(F.exp(-F.sum(1 - F.exp("ll"))).alias("base"))
    gated = reward.filter("meas > 0").groupBy("frame", "meas").agg((1 + F.sum(F.exp("ll"))).alias("x")).groupBy("frame").agg(F.product("x").alias("x"))
    return missed.join(gated, "frame", "left").select("frame", (F.col("base") * F.coalesce("x", F.lit(1.0))).alias("z"))


def rounds(x: Frames):
    """(round, mu, nu, rho, sigma) from round 0 on, without end and without a stop rule."""
    live = x.track[:, :, None] & (x.w > 0)
    w = x.w = np.where(live, x.w, 0.0)
    sigma, nu, k = np.ones(x.w0.shape), np.ones(w.shape), 0
    while True:
        wn = w * nu
        mu = w / np.where(live, wn.sum(2, keepdims=True) - wn + (x.w0 + sigma)[:, :, None], 1.0)
        nu = 1.0 / (1.0 + mu.sum(1, keepdims=True) - mu)
        rho = x.w0 + (w * nu).sum(2)
        sigma = x.sigma(rho)
        yield k, mu, nu, rho, sigma
        k += 1


#: The stop rule by marginals: messages change by no more than the first (as a logarithm), or marginals, looked at every few
#: rounds, by no more than the second.
STILL_MESSAGES, STILL_MARGINALS, EVERY = 1e-7, 1e-6, 5


def _by_marginals(x: Frames, messages: float, marginals: float, every: int, most: int) -> pd.DataFrame:
    f = len(x.frames)
    done, by = np.zeros(f, int), np.array([""] * f, object)
    kept = last_nu = last_p = None
    for k, mu, nu, rho, sigma in rounds(x):
        total = rho + sigma
        p = np.concatenate([(x.w0 / total)[:, :, None], x.w * nu / total[:, :, None], (sigma / total)[:, :, None]], 2)
        on = done == 0
        kept = p.copy() if kept is None else np.where(on[:, None, None], p, kept)
        if k:
            err = np.abs(np.log(np.where(x.w > 0, nu / last_nu, 1.0))).max((1, 2))
            met = on & (err <= messages)
            done[met], by[met] = k, "messages"
        if k and k % every == 0:
            if last_p is not None:
                met = (done == 0) & (np.abs(p - last_p).max((1, 2)) <= marginals)
                done[met], by[met] = k, "marginals"
            last_p = p
        last_nu = nu
        if k >= most or (done > 0).all():
            break
    done[done == 0] = k
    parts = []
    for kind, value in (("missed", kept[:, :, 0]), ("nonexistence", kept[:, :, -1])):
        a, t = np.nonzero(x.track)
        parts.append(pd.DataFrame({"frame": x.frames[a], "track": x.track_of[a, t], "kind": kind, "meas": 0 if kind == "missed" else None, "p": value[a, t], "iterations": done[a], "stopped_by": by[a]}))
    a, t, j = np.nonzero(x.w > 0)
    parts.append(pd.DataFrame({"frame": x.frames[a], "track": x.track_of[a, t], "kind": "detection", "meas": x.meas_of[a, j], "p": kept[:, :, 1:-1][a, t, j], "iterations": done[a], "stopped_by": by[a]}))
    out = pd.concat(parts, ignore_index=True)
    out["meas"] = out["meas"].astype("Int32")
    return out


def _traced(x: Frames, most: int) -> pd.DataFrame:
    parts = []
    for k, mu, nu, rho, sigma in rounds(x):
        if k > most:
            break
        for message, value, mask in (("mu", mu, x.w > 0), ("nu", nu, x.w > 0), ("inverse_rho", 1 / np.where(rho > 0, rho, 1.0), x.track & (rho > 0)), ("sigma", sigma, x.track)):
            axes = tuple(range(1, value.ndim))
            some = np.flatnonzero(mask.any(axis=axes))
            least, largest = (g(np.where(mask, value, fill), axis=axes) for g, fill in ((np.min, np.inf), (np.max, -np.inf)))
            parts.append(pd.DataFrame({"frame": x.frames[some], "round": k, "message": message, "least": least[some], "largest": largest[some]}))
    return pd.concat(parts, ignore_index=True)


def _in_shares(reward: DataFrame, h: DataFrame, frames: int, work, result: str) -> DataFrame:
    """work(Frames) -> rows for each share of frames, as lbp deals them."""
    shares = F.pmod(F.xxhash64("frame"), F.lit(max(1, -(-frames // SHARE)))).alias("share")

    def run(r: pd.DataFrame, hy: pd.DataFrame) -> pd.DataFrame:
        return work(Frames(r, hy)) if len(r) else pd.DataFrame(columns=[c.split()[0] for c in result.split(", ")])

    own = lambda df, *cols: df.select(*[F.col(c).alias(c) for c in cols], shares).groupBy("share")
    return own(reward, "frame", "track", "meas", "ll").cogroup(own(h, "frame", "cluster", "hypo", "tracks", "prob")).applyInPandas(run, result)


def by_marginals(reward: DataFrame, h: DataFrame, frames: int, messages: float = STILL_MESSAGES, marginals: float = STILL_MARGINALS, every: int = EVERY, most: int = MAX_ITERATIONS) -> DataFrame:
    """MARGINAL with iterations and stopped_by (messages, marginals, or nothing after `most` rounds): the same messages as lbp, which stop
    for each frame when they, or its marginals, stand still."""
    return _in_shares(reward, h, frames, lambda x: _by_marginals(x, messages, marginals, every, most), "frame long, track int, kind string, meas int, p double, iterations int, stopped_by string")


def trace(reward: DataFrame, h: DataFrame, frames: int, most: int) -> DataFrame:
    """frame, round (0 to `most`), message (mu and nu between tracks and measurements, sigma and the inverse of rho between tracks and
    hypotheses), least, largest: the extremes of each round's messages. Frames without gates have no mu and nu."""
    return _in_shares(reward, h, frames, lambda x: _traced(x, most), "frame long, round int, message string, least double, largest double")
