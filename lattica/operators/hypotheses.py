"""Hypothesis algebra: normalise, combine, merge with lineage, look up, prune."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.logspace import normalized

CLUSTER = ("frame", "cluster")


def normalize(h: DataFrame) -> DataFrame:
    return h.withColumn("prob", normalized(F.col("prob"), *CLUSTER))


def append(h: DataFrame, more: DataFrame) -> DataFrame:
    return normalize(h.unionByName(more))


def containing(h: DataFrame, tracks: DataFrame) -> DataFrame:
    """The hypotheses that hold a listed (frame, track), once for each track they hold, normalised again."""
    hit = h.withColumn("track", F.explode("tracks")).join(tracks.select("frame", "track"), ["frame", "track"])
    return hit.withColumn("prob", normalized(F.col("prob"), *CLUSTER, "track"))


def tracks_of(h: DataFrame) -> DataFrame:
    """The sorted distinct tracks of each cluster."""
    return h.groupBy(*CLUSTER).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tracks")))).alias("tracks"))


def reindexed(h: DataFrame) -> DataFrame:
    """Tracks of each cluster numbered from 1 by their old number; empty hypotheses stay."""
    return h.join(tracks_of(h).withColumnRenamed("tracks", "old"), list(CLUSTER)).withColumn("tracks", F.transform("tracks", lambda t: F.array_position("old", t).cast("int"))).drop("old")


def track_probability(h: DataFrame) -> DataFrame:
    """Probability mass of the hypotheses with a track, and their number."""
    return normalize(h).select("frame", "cluster", "prob", F.explode("tracks").alias("track")).groupBy("frame", "cluster", "track").agg(F.sum("prob").alias("p"), F.count("*").alias("n_hypos"))


def majority_tracks(h: DataFrame, least: float = 0.5) -> DataFrame:
    return track_probability(h).filter(F.col("p") > least)


def gated(reward: DataFrame, h: DataFrame) -> DataFrame:
    """(frame, cluster, meas) of the measurements that a cluster's tracks gate."""
    member = h.select("frame", "cluster", F.explode("tracks").alias("track")).distinct()
    return reward.filter("meas > 0").join(member, ["frame", "track"]).select("frame", "cluster", "meas").distinct()


def merge_map(reward: DataFrame, h: DataFrame) -> DataFrame:
    """CLUSTER_MAP: clusters that gate a common measurement, also by way of others, have the least of them as master.

    Clusters of a frame are few, so the graph of a frame is closed inside one row by array functions: one shuffle by frame."""
    own = gated(reward, h).groupBy("frame", "meas").agg(F.collect_set("cluster").alias("cs"))
    links = own.groupBy("frame").agg(F.collect_list("cs").alias("links"))
    all_c = h.select("frame", "cluster").distinct().groupBy("frame").agg(F.array_sort(F.collect_list("cluster")).alias("clusters"))
    grow = """transform(clusters, c -> struct(c AS cluster, aggregate(clusters, array(c),
      (acc, step) -> aggregate(coalesce(links, array()), acc, (a, l) -> CASE WHEN arrays_overlap(a, l) THEN array_union(a, l) ELSE a END), acc -> array_min(acc)) AS master))"""
    return all_c.join(links, "frame", "left").select("frame", F.explode(F.expr(grow)).alias("x")).select("frame", "x.cluster", "x.master", (F.col("x.cluster") == F.col("x.master")).alias("is_master"))


def merged(h: DataFrame, cluster_map: DataFrame) -> DataFrame:
    """Joint hypotheses of each master: frame, master, hypo (outer before inner), labels (lineage), tracks (sorted), log_prob.

    The product over a master's clusters is built inside one row from its hypotheses."""
    one = normalize(h).join(cluster_map, list(CLUSTER)).groupBy("frame", "master", "cluster").agg(F.array_sort(F.collect_list(F.struct("hypo", "tracks", F.ln("prob").alias("lp")))).alias("hs"))
    per = one.groupBy("frame", "master").agg(F.array_sort(F.collect_list(F.struct("cluster", "hs"))).alias("cs"))
    start = "array(struct(CAST(array() AS array<struct<cluster:int,hypo:int>>) AS labels, CAST(array() AS array<int>) AS tracks, CAST(0 AS double) AS lp))"
    product = f"""aggregate(cs, {start}, (acc, c) -> flatten(transform(acc, s -> transform(c.hs, x ->
      struct(array_append(s.labels, struct(c.cluster AS cluster, x.hypo AS hypo)) AS labels, concat(s.tracks, x.tracks) AS tracks, s.lp + x.lp AS lp)))))"""
    rows = per.select("frame", "master", F.posexplode(F.expr(product)).alias("hypo", "x"))
    return rows.select("frame", "master", "hypo", "x.labels", F.array_sort("x.tracks").alias("tracks"), F.col("x.lp").alias("log_prob"))


def lineage(m: DataFrame) -> DataFrame:
    """frame, master, merged_hypo, cluster, hypo: which prior hypothesis of each cluster a joint hypothesis is made of."""
    return m.select("frame", "master", F.col("hypo").alias("merged_hypo"), F.explode("labels").alias("x")).select("frame", "master", "merged_hypo", "x.cluster", "x.hypo")


def descending_from(m: DataFrame, priors: DataFrame) -> DataFrame:
    """The joint hypotheses that have any of the listed prior hypotheses (frame, cluster, hypo), once each."""
    hit = lineage(m).join(priors.select("frame", "cluster", "hypo"), ["frame", "cluster", "hypo"]).select("frame", "master", F.col("merged_hypo").alias("hypo")).distinct()
    return m.join(hit, ["frame", "master", "hypo"], "left_semi")


def selected(h: DataFrame, some: DataFrame) -> DataFrame:
    """The listed hypotheses (frame, cluster, hypo) with their probabilities among all of their cluster (prob) and among those selected
    (share). Hypotheses that aren't listed count in prob alone."""
    return normalize(h).join(some.select("frame", "cluster", "hypo").distinct(), ["frame", "cluster", "hypo"], "left_semi").withColumn("share", normalized(F.col("prob"), *CLUSTER))


def numbered(h: DataFrame) -> DataFrame:
    """Tracks of each cluster numbered from 1 by where they first stand in its hypotheses, in the order of hypo; the other form of `reindexed`."""
    first = h.select(*CLUSTER, "hypo", F.posexplode("tracks").alias("place", "track")).groupBy(*CLUSTER, "track").agg(F.min(F.struct("hypo", "place")).alias("at"))
    old = first.groupBy(*CLUSTER).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "track"))), lambda x: x["track"]).alias("old"))
    return h.join(old, list(CLUSTER), "left").withColumn("tracks", F.transform("tracks", lambda t: F.array_position("old", t).cast("int"))).drop("old")


def linking_measurements(reward: DataFrame, h: DataFrame, cluster_map: DataFrame) -> DataFrame:
    """(frame, master, meas, clusters): measurements that several clusters of one master gate."""
    return gated(reward, h).join(cluster_map, list(CLUSTER)).groupBy("frame", "master", "meas").agg(F.array_sort(F.collect_list("cluster")).alias("clusters")).filter(F.size("clusters") > 1)


def unmerging_clusters(cluster_map: DataFrame) -> DataFrame:
    """Clusters alone in their master."""
    return cluster_map.groupBy("frame", "master").agg(F.count("*").alias("n")).filter("n = 1").select("frame", F.col("master").alias("cluster"))


def pruned(h: DataFrame, tail: float = 0.0006, least: float = 0.0006, limit: int = 150, by: tuple[str, ...] = CLUSTER) -> DataFrame:
    """Drop hypotheses in the tail of mass `tail` that are themselves under `least`, and those over the rank limit; normalised again."""
    order = Window.partitionBy(*by).orderBy(F.col("prob").desc(), "hypo")
    rows = h.withColumn("prob", normalized(F.col("prob"), *by)).withColumn("rank", F.row_number().over(order))
    rows = rows.withColumn("rest", F.sum("prob").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    rows = rows.filter(~((F.col("rest") < tail) & (F.col("prob") < least)) & (F.col("rank") <= limit)).drop("rest")
    return rows.withColumn("prob", normalized(F.col("prob"), *by))


def bid_pruned(h: DataFrame, cap: int = 150, tail: float = 0.0006, least: float = 0.0006, tracks: DataFrame | None = None, exists: float = 1e-6) -> DataFrame:
    """Prune under one cap for all clusters of a frame. A hypothesis is doubtful if it's in its cluster's tail of mass `tail` and itself under
    `least`, or beyond rank `cap`, or if all its tracks (frame, track, exi; where given) have an existence under `exists`. What isn't
    doubtful stays, even beyond the cap. Then clusters bid, round by round, their best doubtful hypothesis, the likeliest bid first, until
    the frame has `cap`: the sorted lists of clusters merge by (round, probability). Ties go by cluster and hypo. Normalised again."""
    order = Window.partitionBy(*CLUSTER).orderBy(F.col("prob").desc(), "hypo")
    rows = h.withColumn("prob", normalized(F.col("prob"), *CLUSTER)).withColumn("place", F.row_number().over(order))
    after = F.coalesce(F.sum("prob").over(order.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0))
    doubtful = ((after < tail) & (F.col("prob") < least)) | (F.col("place") > cap)
    if tracks is not None:
        lives = h.select(*CLUSTER, "hypo", F.explode("tracks").alias("track")).join(tracks.select("frame", "track", "exi"), ["frame", "track"]).groupBy(*CLUSTER, "hypo").agg(F.max("exi").alias("lives"))
        rows = rows.join(lives, [*CLUSTER, "hypo"], "left")
        doubtful = doubtful | F.coalesce(F.col("lives") < exists, F.lit(False))
    rows = rows.withColumn("doubtful", doubtful)
    rows = rows.withColumn("round", F.when(F.col("doubtful"), F.row_number().over(Window.partitionBy(*CLUSTER, "doubtful").orderBy(F.col("prob").desc(), "hypo"))).otherwise(0))
    rows = rows.withColumn("bid", F.row_number().over(Window.partitionBy("frame").orderBy("round", F.col("prob").desc(), "cluster", "hypo")))
    kept = rows.filter(~F.col("doubtful") | (F.col("bid") <= cap)).drop("place", "doubtful", "round", "bid", "lives")
    return kept.withColumn("prob", normalized(F.col("prob"), *CLUSTER))


def proportional_children(h: DataFrame, children: int = 150) -> DataFrame:
    """How many children each hypothesis gets of a total, in proportion to its probability, at least one."""
    return normalize(h).withColumn("children", F.greatest(F.lit(1), F.round(F.col("prob") * children)).cast("int"))


def merged_by_history(tracks: DataFrame, by: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Tracks with equal histories become one: weight summed, mean and variance by moment matching, existence as weighted mean.
    Columns history, weight, x, p, exi and track; the least track number names the result."""
    w = F.sum("weight")
    mean = F.sum(F.col("weight") * F.col("x")) / w
    return tracks.groupBy(*by, "history").agg(F.min("track").alias("track"), w.alias("weight"), mean.alias("x"), (F.sum(F.col("weight") * (F.col("p") + F.col("x") * F.col("x"))) / w - mean * mean).alias("p"), (F.sum(F.col("weight") * F.col("exi")) / w).alias("exi"), F.count("*").alias("n_merged"))


def histories_merged(tracks: DataFrame, h: DataFrame, dims: int) -> tuple[DataFrame, DataFrame]:
    """Tracks of a frame with equal histories become one, numbered anew from 1 in the order of their least old number, and hypotheses follow.

    tracks: frame, track, history (array), x (array), p (covariance, rows end to end), exi. A merged track has mean and covariance by moment
    matching, weighed by its tracks' total probability in h (tracks that no hypothesis has weigh nothing; of tracks that together weigh nothing each
    weighs the same), existence as weighted mean, and n_merged. Hypotheses with the same merged tracks in a cluster become one, their
    probabilities summed, named by the least hypo. A merged track in several clusters stays where hypotheses with it have most
    probability (ties: the least cluster); elsewhere hypotheses with it go, also if a cluster loses all. Tracks that no hypothesis
    has any more go as well. Null histories are equal to each other."""
    total = track_probability(h).groupBy("frame", "track").agg(F.sum("p").alias("total"))
    group = Window.partitionBy("frame", "history")
    rows = tracks.join(total, ["frame", "track"], "left").withColumn("total", F.coalesce("total", F.lit(0.0)))
    rows = rows.withColumns({"first": F.min("track").over(group), "whole": F.sum("total").over(group), "of": F.count("*").over(group)})
    rows = rows.withColumn("w", F.when(F.col("whole") > 0, F.col("total") / F.col("whole")).otherwise(1 / F.col("of")))
    rows = rows.withColumn("new", F.dense_rank().over(Window.partitionBy("frame").orderBy("first")))
    # the sums of x, and of p + x x', entry by entry
    second = F.expr(f"transform(p, (v, k) -> v + x[k div {dims}] * x[k % {dims}])")
    entries = rows.select("frame", "new", "w", F.posexplode(F.concat(F.col("x").cast("array<double>"), second.cast("array<double>"))).alias("k", "v"))
    sums = entries.groupBy("frame", "new", "k").agg(F.sum(F.col("w") * F.col("v")).alias("v")).groupBy("frame", "new").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("v"))
    sums = sums.select("frame", "new", F.slice("v", 1, dims).alias("x"), F.slice("v", dims + 1, dims * dims).alias("q"))
    moments = sums.select("frame", "new", "x", F.expr(f"transform(q, (v, k) -> v - x[k div {dims}] * x[k % {dims}])").alias("p"))
    one = rows.groupBy("frame", "new").agg(F.first("history").alias("history"), F.sum(F.col("w") * F.col("exi")).alias("exi"), F.count("*").alias("n_merged"))
    renamed = rows.select("frame", "track", "new")
    picked = normalize(h).select(*CLUSTER, "hypo", "prob", F.explode_outer("tracks").alias("track")).join(renamed, ["frame", "track"], "left")
    named = picked.groupBy(*CLUSTER, "hypo").agg(F.first("prob").alias("prob"), F.array_sort(F.collect_set("new")).alias("tracks"))
    same = named.groupBy(*CLUSTER, "tracks").agg(F.min("hypo").alias("hypo"), F.sum("prob").alias("prob"))
    mass = same.select(*CLUSTER, "hypo", "prob", F.explode("tracks").alias("new"))
    best = mass.groupBy("frame", "new", "cluster").agg(F.sum("prob").alias("mass")).withColumn("k", F.row_number().over(Window.partitionBy("frame", "new").orderBy(F.round("mass", 12).desc(), "cluster")))
    gone = mass.join(best.filter("k > 1").select("frame", "new", "cluster"), ["frame", "new", "cluster"]).select(*CLUSTER, "hypo").distinct()
    left = normalize(same.join(gone, [*CLUSTER, "hypo"], "left_anti")).select(*CLUSTER, "hypo", "tracks", "prob")
    lives = left.select("frame", F.explode("tracks").alias("new")).distinct()
    merged_tracks = moments.join(one, ["frame", "new"]).join(lives, ["frame", "new"], "left_semi").withColumnRenamed("new", "track")
    return merged_tracks, left


def shared_tracks(h: DataFrame) -> DataFrame:
    """Tracks in several clusters: an invariant says there are none."""
    return h.select("frame", "cluster", F.explode("tracks").alias("track")).groupBy("frame", "track").agg(F.countDistinct("cluster").alias("n")).filter("n > 1")


def duplicate_hypotheses(h: DataFrame) -> DataFrame:
    return h.groupBy(*CLUSTER, F.array_sort("tracks").alias("tracks")).agg(F.count("*").alias("n")).filter("n > 1")


def mixed_cardinalities(h: DataFrame) -> DataFrame:
    return h.groupBy(*CLUSTER).agg(F.countDistinct(F.size("tracks")).alias("n")).filter("n > 1")
