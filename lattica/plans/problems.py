"""Association problems derived from the events table, for the queries and (as DuckDB SQL) for their oracles.

A cell is an hour and a sector (user_id mod SECTORS); its events in time order are measurements, and the users that were in
the sector an hour before, with their last value, are tracks. Both are dealt to frames of SIZE in order, so every event takes
part. Clusters are pairs of tracks, each with two prior hypotheses: all its tracks, and all but the last.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SECTORS, SIZE, PAIR = 8, 4, 2
SCALE, GATE, DETECTION, CONSTANT = 20.0, 60.0, 0.9, 1.0
PRIOR = (0.6, 0.4)
HOUR_US = 3_600_000_000
#: Frames of a cell are numbered within CELL; what a cell has beyond that is numbered from FAR, within FAR_CELL a cell.
CELL, FAR, FAR_CELL = 1000, 1 << 62, 1 << 32


def frame_of(cell: Column, block: Column) -> Column:
    """The number of a cell's frame, no two alike. Below CELL frames a cell it is that of SQL, whose numbers run into the next
    cell's beyond that."""
    return F.when(block < CELL, cell * CELL + block).otherwise(F.lit(FAR) + cell * FAR_CELL + block)


def cell_of(frame: Column) -> Column:
    """The cell of a frame."""
    near = lambda x, by: ((x - F.pmod(x, F.lit(by))) / by).cast("long")
    return F.when(frame < FAR >> 1, near(frame, CELL)).otherwise(near(frame - FAR, FAR_CELL))


def frames(spark: SparkSession, sf_dir: str, sectors: int = SECTORS, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """track(frame, track, value) and meas(frame, meas, value). The columns that aren't needed aren't read."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    cell = F.floor(F.col("us") / HOUR_US).cast("long") * sectors + F.col("user_id") % sectors
    ev = ev.withColumn("cell", cell)
    dealt = lambda df, name, *order: df.withColumn("rn", F.row_number().over(Window.partitionBy("cell").orderBy(*order)) - 1).select(
        frame_of(F.col("cell"), F.floor(F.col("rn") / size).cast("long")).alias("frame"), (F.col("rn") % size + 1).cast("int").alias(name), "value"
    )
    before = ev.groupBy((F.col("cell") + sectors).alias("cell"), "user_id").agg(F.max_by("value", F.struct("us", "event_id")).alias("value"))
    return dealt(before, "track", "user_id"), dealt(ev, "meas", "us", "event_id")


def reward(tracks: DataFrame, meas: DataFrame, gate: float = GATE) -> DataFrame:
    """Gated log-weights: an equi-join on the frame with the gate as its condition. No side is broadcast for what its file takes."""
    m = meas.select("frame", "meas", F.col("value").alias("mv")).hint("merge")
    z = (F.col("mv") - F.col("value")) / SCALE
    near = tracks.join(m, (tracks.frame == m.frame) & (F.abs(F.col("mv") - F.col("value")) < gate)).select(tracks.frame, "track", "meas", (F.lit(math.log(DETECTION) + CONSTANT) - 0.5 * z * z).alias("ll"))
    missed = tracks.select("frame", "track", F.lit(0).alias("meas"), F.lit(math.log(1 - DETECTION)).alias("ll"))
    return missed.unionByName(near)


def hypotheses(tracks: DataFrame) -> DataFrame:
    per = tracks.groupBy("frame", F.floor((F.col("track") - 1) / PAIR).cast("int").alias("cluster")).agg(F.array_sort(F.collect_list("track")).alias("all"))
    both = [per.select("frame", "cluster", F.lit(h).alias("hypo"), (F.col("all") if h == 0 else F.slice("all", 1, F.size("all") - 1)).alias("tracks"), F.lit(PRIOR[h]).alias("prob")) for h in (0, 1)]
    return reduce(DataFrame.unionByName, both)


def problem(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """reward and hypothesis tables of all frames that have tracks."""
    tracks, meas = frames(spark, sf_dir)
    return reward(tracks, meas), hypotheses(tracks)


#: The larger problems: whole hours as cells, LARGE tracks and measurements at most, clusters of four tracks with ten hypotheses each.
LARGE, LARGE_PAIR, LARGE_GATE = 8, 4, 8.0
#: Which of a cluster's tracks each hypothesis has, by bit; of equal ones the first stays.
SUBSETS = (15, 14, 13, 11, 7, 12, 10, 9, 6, 5)


def large_problem(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """reward and hypothesis tables of frames of up to LARGE tracks and measurements, with up to ten hypotheses a cluster."""
    tracks, meas = frames(spark, sf_dir, 1, LARGE)
    per = tracks.groupBy("frame", F.floor((F.col("track") - 1) / LARGE_PAIR).cast("int").alias("cluster")).agg(F.array_sort(F.collect_list("track")).alias("all"))
    hs = per.select("frame", "cluster", "all", F.posexplode(F.array(*[F.lit(x) for x in SUBSETS])).alias("hypo", "bits"))
    hs = hs.withColumn("bits", F.col("bits").bitwiseAND(F.expr("shiftleft(1, size(all)) - 1")))
    hs = hs.groupBy("frame", "cluster", "all", "bits").agg(F.min("hypo").alias("hypo"))
    own = F.expr("filter(all, (t, i) -> shiftright(bits, i) & 1 = 1)")
    return reward(tracks, meas, LARGE_GATE), hs.select("frame", "cluster", "hypo", own.alias("tracks"), (1 / (F.col("hypo") + 2.0)).alias("prob"))


_HYPOTHESES = f"""hypothesis AS (SELECT frame, cluster, 0 AS hypo, tracks, {PRIOR[0]}::DOUBLE AS prob FROM per UNION ALL SELECT frame, cluster, 1, tracks[:-2], {PRIOR[1]}::DOUBLE FROM per)"""
_MANY = f"""hypothesis AS (SELECT frame, cluster, hypo, [t FOR t, i IN tracks IF (bits >> (i - 1)) & 1 = 1] AS tracks, (1 / (hypo + 2.0::DOUBLE)) / sum(1 / (hypo + 2.0::DOUBLE)) OVER (PARTITION BY frame, cluster) AS prob
  FROM (SELECT frame, cluster, tracks, bits & ((1 << len(tracks)) - 1) AS bits, min(hypo)::INT AS hypo FROM per, (SELECT unnest({list(SUBSETS)}) AS bits, generate_subscripts({list(SUBSETS)}, 1) - 1 AS hypo) GROUP BY ALL))"""


def tables_sql(sectors: int, size: int, pair: int, gate: float, hypotheses: str) -> str:
    """The tables of problems in DuckDB."""
    return f"""
ev AS (SELECT event_id, user_id, value, epoch_us(ts) AS us, (epoch_us(ts) // {HOUR_US}) * {sectors} + user_id % {sectors} AS cell FROM events),
meas AS (SELECT cell * 1000 + (rn - 1) // {size} AS frame, ((rn - 1) % {size} + 1)::INT AS meas, value FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY us, event_id) AS rn FROM ev)),
seen AS (SELECT cell + {sectors} AS cell, user_id, arg_max(value, (us, event_id)) AS value FROM ev GROUP BY ALL),
track AS (SELECT cell * 1000 + (rn - 1) // {size} AS frame, ((rn - 1) % {size} + 1)::INT AS track, value FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY user_id) AS rn FROM seen)),
reward AS (SELECT frame, track, 0 AS meas, ln(1 - {DETECTION}) AS ll FROM track
  UNION ALL SELECT t.frame, track, meas, ln({DETECTION}) + {CONSTANT} - 0.5 * ((m.value - t.value) / {SCALE}) ** 2 FROM track t JOIN meas m ON m.frame = t.frame AND abs(m.value - t.value) < {gate}),
per AS (SELECT frame, ((track - 1) // {pair})::INT AS cluster, list(track ORDER BY track) AS tracks FROM track GROUP BY ALL),
{hypotheses},
member AS (SELECT frame, cluster, unnest(tracks) AS track FROM per),
gated AS (SELECT DISTINCT frame, cluster, meas FROM member JOIN reward USING (frame, track) WHERE meas > 0),
link AS (SELECT DISTINCT a.frame, a.cluster AS c, b.cluster AS d FROM gated a JOIN gated b USING (frame, meas) WHERE a.cluster <> b.cluster),
reach AS (SELECT frame, cluster, cluster AS other FROM per UNION SELECT r.frame, r.cluster, l.d FROM reach r JOIN link l ON l.frame = r.frame AND l.c = r.other),
cluster_map AS (SELECT frame, cluster, min(other) AS master, min(other) = cluster AS is_master FROM reach GROUP BY frame, cluster)
"""


#: The same tables in DuckDB, and the enumeration of all joint associations by recursion over tracks.
SQL = tables_sql(SECTORS, SIZE, PAIR, GATE, _HYPOTHESES)
LARGE_SQL = tables_sql(1, LARGE, LARGE_PAIR, LARGE_GATE, _MANY)

ENUMERATION = """
grown AS (
  SELECT h.frame, m.master, h.cluster AS at, [{'cluster': h.cluster, 'hypo': h.hypo}] AS labels, h.tracks, ln(h.prob) AS lp FROM hypothesis h JOIN cluster_map m USING (frame, cluster) WHERE m.is_master
  UNION ALL
  SELECT g.frame, g.master, h.cluster, list_append(g.labels, {'cluster': h.cluster, 'hypo': h.hypo}), list_concat(g.tracks, h.tracks), g.lp + ln(h.prob)
  FROM grown g JOIN (SELECT frame, master, cluster, lag(cluster) OVER (PARTITION BY frame, master ORDER BY cluster) AS prior FROM cluster_map) n ON n.frame = g.frame AND n.master = g.master AND n.prior = g.at
  JOIN hypothesis h ON h.frame = n.frame AND h.cluster = n.cluster),
sizes AS (SELECT frame, master, count(*) AS n FROM cluster_map GROUP BY ALL),
merged AS (SELECT frame, master, labels, list_sort(tracks) AS tracks, lp FROM grown JOIN sizes USING (frame, master) WHERE len(labels) = n),
walk AS (
  SELECT frame, master, labels, tracks, 0 AS done, []::INT[] AS picks, lp AS ll FROM merged
  UNION ALL
  SELECT w.frame, w.master, w.labels, w.tracks, w.done + 1, list_append(w.picks, r.meas), w.ll + r.ll
  FROM walk w JOIN reward r ON r.frame = w.frame AND r.track = w.tracks[w.done + 1] WHERE w.done < len(w.tracks) AND (r.meas = 0 OR NOT list_contains(w.picks, r.meas))),
joint AS (SELECT frame, master, labels, tracks, picks, exp(ll) AS w FROM walk WHERE done = len(tracks)),
total AS (SELECT frame, master, sum(w) AS z, count(*) AS n FROM joint GROUP BY ALL)
"""
