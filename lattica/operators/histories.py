"""Measurement histories of tracks (arrays, oldest first; 0 missed, null not yet born), searches in them, and the splitting of clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hypotheses as hy


def _runs(history: Column) -> Column:
    """struct(now, longest): length of the run of zeros at the end, and of the longest one."""

    def step(acc: Column, x: Column) -> Column:
        now = F.when(x == 0, acc["now"] + 1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["longest"], now).alias("longest"))

    return F.aggregate(history, F.struct(F.lit(0).alias("now"), F.lit(0).alias("longest")), step)


def last_misses(history: Column) -> Column:
    """Missed detections in a row at the end of a history."""
    return _runs(history)["now"]


def longest_silence(history: Column) -> Column:
    """The most missed detections in a row."""
    return _runs(history)["longest"]


def encoded(history: Column, most: int) -> Column:
    """A history as one number in base most + 2, its first entry the lowest digit; null counts as most + 1. Exact up to 38 digits."""
    number = lambda x: x.cast("decimal(38,0)")
    digit = lambda x: number(F.coalesce(x, F.lit(most + 1)))
    return F.aggregate(F.reverse(history), number(F.lit(0)), lambda acc, x: number(acc * (most + 2) + digit(x)))


def _tail(history: Column, n: Column) -> Column:
    """The last n entries; all, if there are fewer."""
    k = F.least(n, F.size(history))
    return F.when(k > 0, F.slice(history, F.size(history) - k + 1, k)).otherwise(F.array().cast("array<int>"))


def _known(history: Column) -> Column:
    return F.transform(history, lambda x: F.coalesce(x, F.lit(-1)))


def fits(history: Column, sequence: Column) -> Column:
    """Whether a sequence that ends at the same scan agrees with a history, over the scans that both have; nulls agree with nulls."""
    n = F.least(F.size(history), F.size(sequence))
    return _known(_tail(history, n)) == _known(_tail(sequence, n))


def found(tracks: DataFrame, sequence: list[int | None]) -> DataFrame:
    """The tracks (column history) that agree with a sequence."""
    return tracks.filter(fits(F.col("history"), _array(sequence)))


def others(tracks: DataFrame, sequences: list[list[int | None]]) -> DataFrame:
    """The tracks that agree with none of the sequences."""
    out = tracks
    for s in sequences:
        out = out.filter(~fits(F.col("history"), _array(s)))
    return out


def _array(values: list[int | None]) -> Column:
    return F.array(*[F.lit(v).cast("int") for v in values]).cast("array<int>")


def segment_probability(tracks: DataFrame, h: DataFrame, segment: list[int | None], first: int, last: int, now: int) -> DataFrame:
    """frame, p, tracks: total probability of the tracks that conform to a segment of scans first..last, `now` being the scan of the last
    entry; over 1 where several clusters have it. Scans before a history begins aren't compared. tracks: frame, track, history, exi."""
    if len(segment) != last + 1 - first:
        raise ValueError("the segment's length isn't that of its scans")
    size = F.size("history")
    begin = F.greatest(F.lit(first), now - size + 1)  # the first scan that's compared
    n = F.greatest(F.lit(0), F.lit(min(last, now) + 1) - begin)
    place = begin - (now - size)
    mine = F.when(n > 0, F.slice("history", place, n)).otherwise(F.array().cast("array<int>"))
    theirs = F.when(n > 0, F.slice(_array(segment), begin - first + 1, n)).otherwise(F.array().cast("array<int>"))
    hit = tracks.filter((n > 0) & (_known(mine) == _known(theirs)))
    p = hy.track_probability(h).select("frame", "track", "p")
    return hit.join(p, ["frame", "track"]).groupBy("frame").agg(F.sum(F.col("p") * F.col("exi")).alias("p"), F.array_sort(F.collect_set("track")).alias("tracks"))


def repeated_measurements(h: DataFrame, tracks: DataFrame) -> DataFrame:
    """frame, cluster, hypo, meas: measurements that several tracks of a hypothesis have at the last scan; an invariant says there are none."""
    last = tracks.select("frame", "track", F.element_at("history", -1).alias("meas")).filter("meas > 0")
    one = h.select("frame", "cluster", "hypo", F.explode("tracks").alias("track")).join(last, ["frame", "track"])
    return one.groupBy("frame", "cluster", "hypo", "meas").agg(F.count("*").alias("n")).filter("n > 1").drop("n")


def splitting_tracks(h: DataFrame, tracks: DataFrame, threshold: float) -> DataFrame:
    """(frame, track) that were missed at the last two scans or more and are under a probability. tracks: frame, track, history, exi."""
    weak = tracks.join(hy.track_probability(h).select("frame", "track", "p"), ["frame", "track"], "left")
    return weak.filter((last_misses(F.col("history")) > 1) & (F.coalesce("p", F.lit(0.0)) * F.col("exi") < threshold)).select("frame", "track")


def without_tracks(h: DataFrame, drop: DataFrame) -> DataFrame:
    """Hypotheses without the listed (frame, track); those that become equal are one (the least number), with their summed probability."""
    gone = drop.groupBy("frame").agg(F.collect_set("track").alias("gone"))
    rest = hy.normalize(h).join(gone, "frame", "left").withColumn("tracks", F.array_sort(F.array_except("tracks", F.coalesce("gone", F.array().cast("array<int>")))))
    return rest.groupBy("frame", "cluster", "tracks").agg(F.min("hypo").alias("hypo"), F.sum("prob").alias("prob")).select("frame", "cluster", "hypo", "tracks", "prob")


def split_clusters(h: DataFrame, least: float = 0.9) -> DataFrame:
    """Tracks with more than `least` of their cluster's mass become clusters of their own: frame, cluster, part, tracks, prob. Part 0 has
    what remains of the cluster, unless that's nothing; other parts, named by the track, have a hypothesis with it and, unless it's sure,
    one without."""
    major = hy.majority_tracks(h, least).select("frame", "cluster", "track", "p")
    with_it = major.select("frame", "cluster", F.col("track").alias("part"), F.array("track").alias("tracks"), F.col("p").alias("prob"))
    without = major.filter(F.col("p") < 1 - 1e-12).select("frame", "cluster", F.col("track").alias("part"), F.array().cast("array<int>").alias("tracks"), (1 - F.col("p")).alias("prob"))
    rest = without_tracks(h, major)
    some = rest.filter(F.size("tracks") > 0).select("frame", "cluster").distinct()
    kept = rest.join(some, ["frame", "cluster"], "left_semi").select("frame", "cluster", F.lit(0).alias("part"), "tracks", "prob")
    return kept.unionByName(with_it).unionByName(without)
