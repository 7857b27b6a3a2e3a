"""Masters of as many hypotheses, tracks and shared measurements, solved at once: what they gate differs, so tracks and measurements that don't meet
weigh nothing there. Frames of one size are far more than those of one shape (shapes.py), and sets of taken measurements are an axis here."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd

from .shapes import WORD, _ranges, flat

NONE = float("-inf")
#: Measurements that tracks of a master share, up to which their sets are an axis.
FEW = 10
#: Numbers that an array has at most, or those of one master.
CELLS = 2_000_000
#: A sum relative to the largest weights, under which a master is left to sums of logarithms.
FAINT = 1e-200


@dataclass
class Group:
    """Some masters of one size. master: their places among the batch's; hyps: of each cluster, the places of its hypotheses; lp: their log-priors; has: which
    of the master's tracks each has; mem: the places of tracks, those that share measurements first (`sharing` of them); free: the log-weight of what
    a track has alone, a missed detection included; ll: log-weights of shared measurements, and at: their places among the options (-1: not gated)."""

    master: np.ndarray
    hyps: list[np.ndarray]
    lp: list[np.ndarray]
    has: list[np.ndarray]
    mem: np.ndarray
    sharing: int
    free: np.ndarray
    ll: np.ndarray
    at: np.ndarray


class Masters:
    """The masters of a batch of exact.by_frame with a cluster map, and the options of their tracks: o_mem (the track's place), j, ll and `share`, the
    log-share of what the track has alone (0 of what is shared)."""

    def __init__(self, batch: pd.DataFrame):
        self.row_frame = batch["frame"].to_numpy()
        self.cluster, h_row = flat(batch["cluster"], int)
        self.hypo, prob, size = (flat(batch[c], k)[0] for c, k in (("hypo", int), ("prob", float), ("size", int)))
        tracks, _ = flat(batch["tracks"], int)
        masters, (t, o_row) = flat(batch["master"], int)[0], flat(batch["t"], int)
        j, ll = flat(batch["j"], int)[0], flat(batch["ll"], float)[0]
        of_cluster = np.unique(h_row * WORD + self.cluster, return_inverse=True)[1]
        with np.errstate(divide="ignore", invalid="ignore"):
            self.lp = np.where(prob > 0, np.log(prob / np.bincount(of_cluster, prob)[of_cluster]), NONE)
        key, self.of = np.unique(h_row * WORD + masters, return_inverse=True)
        self.row, self.name = key // WORD, key % WORD
        # entries of hypotheses, and tracks by their master
        self.e_size, self.e_first = size, np.cumsum(size) - size
        e_hyp = np.repeat(np.arange(len(size)), size)
        member, self.e_mem = np.unique(self.of[e_hyp] * WORD + tracks, return_inverse=True)
        self.m_of, self.track = member // WORD, member % WORD
        # rows where a track is in several clusters
        n = len(of_cluster) + 1
        twice = np.unique(self.e_mem * n + of_cluster[e_hyp]) // n
        self.odd = np.unique(self.row[self.m_of[np.flatnonzero(np.bincount(twice, minlength=len(member)) > 1)]])
        # options by track
        order = np.argsort(o_row * WORD + t, kind="stable")
        o_key, own = (o_row * WORD + t)[order], self.row[self.m_of] * WORD + self.track
        first = np.searchsorted(o_key, own)
        n = np.searchsorted(o_key, own, "right") - first
        pick = order[_ranges(first, n)]
        self.o_mem, self.j, self.ll, self.o_first = np.repeat(np.arange(len(member)), n), j[pick], ll[pick], np.cumsum(n) - n
        self.o_size = n
        hit = np.flatnonzero(self.j > 0)
        column, of, times = np.unique(self.m_of[self.o_mem[hit]] * WORD + self.j[hit], return_inverse=True, return_counts=True)
        both = times > 1
        place = np.cumsum(both) - 1
        wide = np.bincount(column[both] // WORD, minlength=len(key))
        place -= (np.cumsum(wide) - wide)[column // WORD]
        self.col = np.full(len(self.j), -1)
        self.col[hit] = np.where(both[of], place[of], -1)
        alone = np.flatnonzero(self.col < 0)
        self.free, a_n = np.full(len(member), NONE), np.bincount(self.o_mem[alone], minlength=len(member))
        if len(alone):
            self.free[a_n > 0] = np.logaddexp.reduceat(self.ll[alone], (np.cumsum(a_n) - a_n)[a_n > 0])
        self.share = np.zeros(len(self.j))
        free = self.free[self.o_mem[alone]]
        self.share[alone] = np.where(free > NONE, self.ll[alone] - np.where(free > NONE, free, 0.0), NONE)
        # tracks of a master, those that share first
        self.shares = np.bincount(self.o_mem[self.col >= 0], minlength=len(member)) > 0
        self.order = np.lexsort((np.arange(len(member)), ~self.shares, self.m_of))
        self.tall = np.bincount(self.m_of, minlength=len(key))
        self.t_first = np.cumsum(self.tall) - self.tall
        self.place = np.zeros(len(member), int)
        self.place[self.order] = np.arange(len(member)) - self.t_first[self.m_of[self.order]]
        self.sharing, self.wide = np.bincount(self.m_of[self.shares], minlength=len(key)), wide
        # clusters of a master: their hypotheses in order
        self.h_order = np.lexsort((self.hypo, self.cluster, self.of))
        where = self.of[self.h_order] * WORD + self.cluster[self.h_order]
        self.c_first = np.flatnonzero(np.diff(where, prepend=-1))
        self.c_size = np.diff(np.append(self.c_first, len(where)))
        c_of = where[self.c_first] // WORD
        self.n_clusters = np.bincount(c_of, minlength=len(key))
        self.m_first = np.cumsum(self.n_clusters) - self.n_clusters

    def groups(self, keep: np.ndarray, cells) -> Iterator[Group]:
        """The masters to keep, by size, in parts: cells(numbers of hypotheses, tracks, sharing tracks, shared measurements) numbers stand for each."""
        sizes: dict[tuple, list[int]] = {}
        c_size, first, n = self.c_size.tolist(), self.m_first.tolist(), self.n_clusters.tolist()
        for m in np.flatnonzero(keep).tolist():
            key = (tuple(c_size[first[m] : first[m] + n[m]]), int(self.tall[m]), int(self.sharing[m]), int(self.wide[m]))
            sizes.setdefault(key, []).append(m)
        for (hs, tall, sharing, wide), every in sizes.items():
            step = max(1, CELLS // max(1, cells(hs, tall, sharing, wide)))
            for k in range(0, len(every), step):
                yield self._group(np.array(every[k : k + step]), hs, tall, sharing, wide)

    def _group(self, ms: np.ndarray, hs: tuple[int, ...], tall: int, sharing: int, wide: int) -> Group:
        hyps, has = [], []
        for k, n in enumerate(hs):
            own = self.h_order[self.c_first[self.m_first[ms] + k][:, None] + np.arange(n)]
            some, size = np.zeros((own.size, tall), bool), self.e_size[own.ravel()]
            some[np.repeat(np.arange(own.size), size), self.place[self.e_mem[_ranges(self.e_first[own.ravel()], size)]]] = True
            hyps.append(own)
            has.append(some.reshape(*own.shape, tall))
        mem = self.order[self.t_first[ms][:, None] + np.arange(tall)]
        ll, at = np.full((len(ms), sharing, wide), NONE), np.full((len(ms), sharing, wide), -1)
        near = mem[:, :sharing].ravel()
        o = _ranges(self.o_first[near], self.o_size[near])
        who = np.repeat(np.arange(len(near)), self.o_size[near])
        own = self.col[o] >= 0
        f, s = np.divmod(who[own], max(1, sharing))
        ll[f, s, self.col[o[own]]], at[f, s, self.col[o[own]]] = self.ll[o[own]], o[own]
        return Group(ms, hyps, [self.lp[x] for x in hyps], has, mem, sharing, self.free[mem], ll, at)


def subsets(has: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of an array of bits (..., tracks), and which of them each is."""
    flat_ = has.reshape(int(np.prod(has.shape[:-1])), has.shape[-1])
    if has.shape[-1] <= 62:
        _, first, of = np.unique(flat_ @ (1 << np.arange(has.shape[-1])), return_index=True, return_inverse=True)
        return flat_[first], of.reshape(has.shape[:-1])
    some, of = np.unique(flat_, axis=0, return_inverse=True)
    return some, of.reshape(has.shape[:-1])


def gathered(p: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Sums of p (masters, hypotheses) by subset."""
    rows = len(p)
    return np.bincount((np.arange(rows)[:, None] * n + of).ravel(), p.ravel(), rows * n).reshape(rows, n)


def halves(x: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
    """The entries of sets (the last axis) without measurement j, and those with it, in the same order."""
    both = x.reshape(*x.shape[:-1], x.shape[-1] >> (j + 1), 2, 1 << j)
    return both[..., 0, :], both[..., 1, :]


class Cluster:
    """A cluster of a group's masters: weights of its hypotheses, relative to the largest, summed by the sharing tracks they have; `top` is what that took out."""

    def __init__(self, g: Group, k: int, high: np.ndarray):
        with np.errstate(invalid="ignore"):
            lw = g.lp[k] + np.where(g.has[k], high[:, None], 0.0).sum(-1)
        self.top = lw.max(1)
        self.q = np.exp(lw - np.where(self.top > NONE, self.top, 0.0)[:, None])
        self.sets, self.of = subsets(g.has[k][:, :, : g.sharing])
        self.by_set = gathered(self.q, self.of, len(self.sets))
        self.tracks = np.flatnonzero(self.sets.any(0)).tolist()

    def forth(self, entry: np.ndarray, w0: np.ndarray, w: np.ndarray) -> np.ndarray:
        """From the weights of sets before the cluster to those after it, passing the tracks of each subset one by one."""
        now = entry[:, None] * self.by_set[:, :, None]
        self.before = []
        for t in self.tracks:
            with_t = self.sets[:, t]
            old = np.ascontiguousarray(now[:, with_t])
            self.before.append(old)
            new = old * w0[:, t, None, None]
            for j in range(w.shape[2]):
                into = halves(new, j)[1]
                into += halves(old, j)[0] * w[:, t, j, None, None, None]
            now = now.copy()
            now[:, with_t] = new
        return now.sum(1)

    def back(self, entry: np.ndarray, after: np.ndarray, w0: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, np.ndarray]]:
        """From what follows each set after the cluster: what follows before it, the whole sum, the probabilities of hypotheses, and of each sharing track's places (alone
        first)."""
        now = np.broadcast_to(after[:, None], (len(after), *self.by_set.shape[1:], after.shape[1])).copy()
        picks = {}
        for t, old in zip(reversed(self.tracks), reversed(self.before), strict=True):
            with_t = self.sets[:, t]
            later = np.ascontiguousarray(now[:, with_t])
            new = later * w0[:, t, None, None]
            own = np.zeros((len(after), 1 + w.shape[2]))
            own[:, 0] = np.einsum("fus,fus->f", old, later) * w0[:, t]
            for j in range(w.shape[2]):
                out, follows = halves(new, j)[0], halves(later, j)[1]
                out += follows * w[:, t, j, None, None, None]
                own[:, j + 1] = np.einsum("fuab,fuab->f", halves(old, j)[0], follows) * w[:, t, j]
            picks[t] = own
            now[:, with_t] = new
        each = np.einsum("fs,fus->fu", entry, now)
        by_set = each * self.by_set
        z = by_set.sum(1)
        safe = np.where(z > 0, z, 1.0)[:, None]
        hypos = self.q * np.take_along_axis(each, self.of, 1) / safe
        return np.einsum("fu,fus->fs", self.by_set, now), z, hypos, {t: p / safe for t, p in picks.items()}


def passed(g: Group, conditioned: bool) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Of a group: log-evidence, probabilities of each cluster's hypotheses, of what tracks have alone, of shared measurements, and the whole sum relative to
    the largest weights. Clusters are passed one after the other with the sets that those before have taken, or (`conditioned`, two at most) each by itself,
    against what the other does with the measurements left."""
    high = g.free.copy()
    if g.sharing and g.ll.shape[2]:
        high[:, : g.sharing] = np.maximum(high[:, : g.sharing], g.ll.max(2))
    sure = np.where(high > NONE, high, 0.0)
    w0, w = np.exp(g.free - sure), np.exp(g.ll - sure[:, : g.sharing, None])
    n = 1 << g.ll.shape[2]
    clusters = [Cluster(g, k, high) for k in range(len(g.hyps))]
    start = np.zeros((len(g.master), n))
    start[:, 0] = 1.0
    entries, log_z, least = [], np.zeros(len(g.master)), np.ones(len(g.master))
    own = []
    entry = start
    for c in clusters:
        entries.append(start if conditioned else entry)
        out = c.forth(entries[-1], w0, w)
        top = out.max(1)
        least = np.minimum(least, top)
        out = out / np.where(top > 0, top, 1.0)[:, None]
        own.append(out)
        with np.errstate(divide="ignore"):
            log_z += c.top + np.log(top)
        entry = out
    there, alone, hit, hypos = np.zeros(g.free.shape), np.zeros(g.free.shape), np.zeros(g.ll.shape), [None] * len(clusters)
    after = np.ones((len(g.master), n))
    for k in range(len(clusters) - 1, -1, -1):
        c = clusters[k]
        if conditioned:
            after = np.ones((len(g.master), n))
            if len(clusters) == 2:  # the sum over the other's sets within what is left
                within = own[1 - k].copy()
                for j in range(g.ll.shape[2]):
                    without, into = halves(within, j)
                    into += without
                after = within[:, ::-1]
        rest = after
        before, z, hypos[k], picks = c.back(entries[k], after, w0, w)
        least = np.minimum(least, z)
        there += np.einsum("fh,fht->ft", hypos[k], g.has[k])
        for t, p in picks.items():
            alone[:, t] += p[:, 0]
            hit[:, t] += p[:, 1:]
        top = before.max(1)
        after = before / np.where(top > 0, top, 1.0)[:, None]
    with np.errstate(divide="ignore"):
        log_z += np.log((own[0] * rest).sum(1) if conditioned else own[-1].sum(1))
    alone[:, g.sharing :] = there[:, g.sharing :]
    return log_z, hypos, alone, hit, least


def _cells(hs: tuple[int, ...], tall: int, sharing: int, wide: int) -> int:
    return (1 << wide) * min(1 << min(sharing, 30), max(hs)) * max(1, sharing) + sum(hs) * (tall + 1)


@dataclass
class Solved:
    """What `solved` finds: the masters, and where `good`: log-evidence of each, probabilities of hypotheses and of options."""

    of: Masters
    good: np.ndarray
    log_z: np.ndarray
    hypo: np.ndarray
    option: np.ndarray

    def bad_rows(self) -> np.ndarray:
        """Rows of the batch of which a master isn't solved."""
        return np.unique(self.of.row[~self.good])

    def drop(self, rows: np.ndarray) -> None:
        self.good &= ~np.isin(self.of.row, rows)


def solved(batch: pd.DataFrame, conditioned: bool) -> Solved:
    """Exact sums of the masters of a batch (exact.by_frame with masters). Not good are those of over FEW shared measurements, of a row with a
    track in several clusters, and of sums under FAINT; with `conditioned`, of over two clusters."""
    m = Masters(batch)
    keep = (m.wide <= FEW) & ~np.isin(m.row, m.odd)
    if conditioned:
        keep &= m.n_clusters <= 2
    out = Solved(m, np.zeros(len(m.row), bool), np.zeros(len(m.row)), np.zeros(len(m.hypo)), np.zeros(len(m.j)))
    alone = np.zeros(len(m.track))
    for g in m.groups(keep, _cells):
        with np.errstate(invalid="ignore"):
            out.log_z[g.master], hypos, alone[g.mem], hit, least = passed(g, conditioned)
        out.good[g.master] = least > FAINT
        for own, p in zip(g.hyps, hypos, strict=True):
            out.hypo[own] = p
        out.option[g.at[g.at >= 0]] = hit[g.at >= 0]
    own = m.col < 0
    out.option[own] = (alone[m.o_mem] * np.exp(m.share))[own]
    return out
