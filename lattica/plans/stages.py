"""Queries of a tracker's stages in several dimensions: gates, edge cutting, pruning under one cap, merging by history, cardinalities,
resampling and mixture reduction; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lineage import kept
from ..operators import cardinality, cutting, gating, mixtures, resampling
from ..operators import hypotheses as hy
from .catalog import R, query, rounded
from .larger import large_query
from .problems import LARGE, frames, large_problem

#: Gate of vectors (three dimensions), detection probability and clutter.
GATE, DETECTION, CLUTTER = 6.0, 0.9, 0.01


def _vectors(spark, sf_dir):
    """Vectors of even number as predictions of tracks, of odd number as measurements; labels are frames, the first three dimensions count."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("label").cast("long").alias("frame"), F.col("vec_id").cast("int").alias("id"), F.transform(F.slice("embedding", 1, 3), lambda v: v.cast("double")).alias("x"))
    a = 0.002 + 0.001 * (F.col("id") % 3)
    s = F.array(*[a * k for k in (1.0, 0.3, 0.1, 0.3, 1.5, 0.2, 0.1, 0.2, 2.0)])
    tracks = e.filter("id % 2 = 0").select("frame", F.col("id").alias("track"), "x", s.alias("s"), (0.5 + 0.1 * (F.col("id") % 5)).alias("exi"))
    return tracks, e.filter("id % 2 = 1").select("frame", F.col("id").alias("meas"), F.col("x").alias("z"))


# the inverse of the covariance, by its adjugate; a is its scale
VECTORS = f"""v AS (SELECT label::BIGINT AS frame, vec_id::INT AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, 0.002 + 0.001 * (vec_id % 3) AS a FROM embeddings),
pair AS (SELECT t.frame, t.id AS track, m.id AS meas, t.a, m.x - t.x AS x, m.y - t.y AS y, m.z - t.z AS z FROM v t JOIN v m ON m.frame = t.frame AND t.id % 2 = 0 AND m.id % 2 = 1),
near AS (SELECT frame, track, meas, (x * x * (1.5 * 2 - 0.04) + y * y * (2 - 0.01) + z * z * (1.5 - 0.09) + 2 * x * y * (0.02 - 0.6) + 2 * x * z * (0.06 - 0.15) + 2 * y * z * (0.03 - 0.2)) / (a * (1.5 * 2 - 0.04 - 0.3 * (0.6 - 0.02) + 0.1 * (0.06 - 0.15))) AS distance,
  3 * ln(a) + ln(1.5 * 2 - 0.04 - 0.3 * (0.6 - 0.02) + 0.1 * (0.06 - 0.15)) AS log_det FROM pair),
gate AS (SELECT frame, track, meas, distance, -0.5 * distance - 0.5 * log_det - 1.5 * ln(2 * pi()) AS ll FROM near WHERE distance < {GATE})"""


@query(f"SELECT frame, track, meas, round(distance, {R}) AS distance, round(ll, {R}) + 0.0 AS ll FROM gate", walk=False, more=VECTORS)
def gated_vectors(spark, sf_dir):
    """Gated pairs in three dimensions by a range join over grids; the oracle compares all pairs."""
    return rounded(gating.gated(*_vectors(spark, sf_dir), GATE, 3), "distance", "ll")


@query(f"""SELECT g.frame, g.track, g.meas, round(g.ll + ln({DETECTION}) + ln(0.5 + 0.1 * (g.track % 5)) - ln({CLUTTER}), {R}) + 0.0 AS ll FROM gate g
UNION ALL SELECT frame, id, 0, round(ln(1 - (0.5 + 0.1 * (id % 5)) * {DETECTION}), {R}) + 0.0 FROM v WHERE id % 2 = 0""", walk=False, more=VECTORS)
def vector_rewards(spark, sf_dir):
    """The reward table of gated vectors."""
    tracks, meas = _vectors(spark, sf_dir)
    return rounded(gating.reward(tracks, gating.gated(tracks, meas, GATE, 3), DETECTION, CLUTTER), "ll")


def _single(spark, sf_dir):
    """The larger problems with each track as a cluster."""
    r, h = large_problem(spark, sf_dir)
    own = r.select("frame", "track").distinct()
    return kept(r), own.select("frame", F.col("track").alias("cluster"), F.lit(0).alias("hypo"), F.array("track").alias("tracks"), F.lit(1.0).alias("prob"))


# all simple paths, of which the shortest between two nodes count; measurements are negative nodes
PATHS = """adj AS (SELECT frame, track AS u, -meas AS v FROM reward WHERE meas > 0 UNION ALL SELECT frame, -meas, track FROM reward WHERE meas > 0),
stroll AS (SELECT DISTINCT frame, u AS s, u AS t, [u] AS way FROM adj UNION ALL SELECT w.frame, w.s, a.v, list_append(w.way, a.v) FROM stroll w JOIN adj a ON a.frame = w.frame AND a.u = w.t WHERE NOT list_contains(w.way, a.v)),
short AS (SELECT * FROM (SELECT *, min(len(way)) OVER (PARTITION BY frame, s, t) AS l FROM stroll WHERE s < t) WHERE len(way) = l),
shares AS (SELECT frame, unnest(way[2:-2]) AS node, 1.0 / count(*) OVER (PARTITION BY frame, s, t) AS share FROM short),
central AS (SELECT a.frame, a.u AS node, coalesce(any_value(x.c), 0) AS c FROM adj a LEFT JOIN (SELECT frame, node, sum(share) AS c FROM shares GROUP BY ALL) x ON x.frame = a.frame AND x.node = a.u GROUP BY a.frame, a.u)"""


@large_query(f"SELECT frame, CASE WHEN node > 0 THEN 'cluster' ELSE 'meas' END AS kind, abs(node)::INT AS key, round(c, {R}) AS centrality FROM central", walk=False, more=PATHS)
def node_betweenness(spark, sf_dir):
    """Betweenness in each frame's cluster-measurement graph; the oracle walks all paths."""
    return rounded(cutting.node_betweenness(*_single(spark, sf_dir)), "centrality")


#: How much less likely than a missed detection edges may be before they go, here.
HERE = -3.17


@large_query(f"""SELECT frame, track AS cluster, meas FROM (SELECT r.*, row_number() OVER (PARTITION BY r.frame, r.meas ORDER BY weak, r.ll DESC, r.track) AS place, weak
 FROM reward r JOIN (SELECT a.frame, a.track, a.meas, a.ll < o.ll - {HERE} AND c.c > 0 AS weak FROM reward a JOIN reward o ON o.frame = a.frame AND o.track = a.track AND o.meas = 0 JOIN central c ON c.frame = a.frame AND c.node = -a.meas WHERE a.meas > 0) w
 ON w.frame = r.frame AND w.track = r.track AND w.meas = r.meas) WHERE weak AND place > 1""", walk=False, more=PATHS)
def weak_edges(spark, sf_dir):
    """Weak edges between clusters that are cut; a measurement keeps its best."""
    r, h = _single(spark, sf_dir)
    return cutting.cut_edges(r, h, HERE).filter("reason = 'weak'").select("frame", "cluster", "meas")


@query()
def small_superclusters(spark, sf_dir):
    """Clusters of each supercluster after edges are cut until none has over three."""
    r, h = _single(spark, sf_dir)
    cm = hy.merge_map(cutting.without(r, h, cutting.cut_edges(r, h, clusters=3, more_cardinality=100)), h)
    return cm.groupBy("frame", "master").agg(F.count("*").alias("n_clusters"))


CAP, TAIL, LEAST = 8, 0.3, 0.12


@large_query(f"""SELECT frame, cluster, hypo, round(p / sum(p) OVER (PARTITION BY frame, cluster), {R}) + 0.0 AS prob FROM (
 SELECT *, row_number() OVER (PARTITION BY frame ORDER BY turn, p DESC, cluster, hypo) AS bid FROM (
 SELECT *, CASE WHEN doubtful THEN row_number() OVER (PARTITION BY frame, cluster, doubtful ORDER BY p DESC, hypo) ELSE 0 END AS turn FROM (
 SELECT *, (coalesce(sum(p) OVER (PARTITION BY frame, cluster ORDER BY p DESC, hypo ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) < {TAIL} AND p < {LEAST}) OR row_number() OVER (PARTITION BY frame, cluster ORDER BY p DESC, hypo) > {CAP} AS doubtful
 FROM (SELECT *, prob / sum(prob) OVER (PARTITION BY frame, cluster) AS p FROM hypothesis)))) WHERE NOT doubtful OR bid <= {CAP}""", walk=False)
def bid_hypotheses(spark, sf_dir):
    """Hypotheses that stay under one cap for a frame, clusters bidding in turn."""
    out = hy.bid_pruned(large_problem(spark, sf_dir)[1], CAP, TAIL, LEAST)
    return rounded(out.select("frame", "cluster", "hypo", "prob"), "prob")


def _by_history(spark, sf_dir):
    tracks, _ = frames(spark, sf_dir, 1, LARGE)
    t = tracks.select("frame", "track", F.array(F.col("track") % 3, F.col("track") % 2).alias("history"), F.array("value", F.col("track").cast("double")).alias("x"), F.array(F.lit(4.0), F.lit(1.0), F.lit(1.0), F.col("track").cast("double")).alias("p"), (0.2 + 0.7 * (F.col("value") % 1)).alias("exi"))
    return hy.histories_merged(t, large_problem(spark, sf_dir)[1], 2)


# tracks 1 and 7, 2 and 8 have equal histories; they are in the two clusters of a frame
HISTORY = """ttp AS (SELECT frame, track, sum(prob) AS w FROM (SELECT frame, unnest(tracks) AS track, prob FROM hypothesis) GROUP BY ALL),
old AS (SELECT t.frame, t.track, value, 0.2 + 0.7 * (value % 1) AS exi, coalesce(w, 0) AS w, min(t.track) OVER (PARTITION BY t.frame, t.track % 6) AS lead FROM track t LEFT JOIN ttp USING (frame, track)),
now AS (SELECT *, dense_rank() OVER (PARTITION BY frame ORDER BY lead)::INT AS fresh, CASE WHEN sum(w) OVER g > 0 THEN w / sum(w) OVER g ELSE 1 / count(*) OVER g END AS share FROM old WINDOW g AS (PARTITION BY frame, lead)),
names AS (SELECT h.frame, h.cluster, h.hypo, h.prob, list_sort(list_distinct(list(n.fresh) FILTER (n.fresh IS NOT NULL))) AS tracks FROM (SELECT *, unnest(CASE WHEN len(tracks) = 0 THEN [NULL] ELSE tracks END) AS track FROM hypothesis) h LEFT JOIN now n ON n.frame = h.frame AND n.track = h.track GROUP BY ALL),
same AS (SELECT frame, cluster, tracks, min(hypo) AS hypo, sum(prob) AS prob FROM names GROUP BY ALL),
claims AS (SELECT frame, cluster, fresh, sum(prob) AS mass FROM (SELECT frame, cluster, unnest(tracks) AS fresh, prob FROM same) GROUP BY ALL),
lost AS (SELECT frame, cluster, fresh FROM (SELECT *, row_number() OVER (PARTITION BY frame, fresh ORDER BY round(mass, 12) DESC, cluster) AS k FROM claims) WHERE k > 1),
stay AS (SELECT *, prob / sum(prob) OVER (PARTITION BY frame, cluster) AS p FROM same s WHERE NOT EXISTS (SELECT 1 FROM lost l WHERE l.frame = s.frame AND l.cluster = s.cluster AND list_contains(s.tracks, l.fresh)))"""


@large_query(f"SELECT frame, cluster, hypo, array_to_string(coalesce(tracks, []), ',') AS tracks, round(p, {R}) + 0.0 AS prob FROM stay", walk=False, more=HISTORY)
def hypotheses_by_history(spark, sf_dir):
    """Hypotheses after tracks with equal histories became one, a track in several clusters staying in one."""
    out = _by_history(spark, sf_dir)[1]
    return rounded(out.withColumn("tracks", F.concat_ws(",", F.transform("tracks", lambda t: t.cast("string")))), "prob")


@large_query(f"""SELECT frame, fresh AS track, round(mx, {R}) + 0.0 AS x, round(mk, {R}) + 0.0 AS k, round(sxx - mx * mx, 4) + 0.0 AS pxx, round(sxk - mx * mk, 4) + 0.0 AS pxk, round(skk - mk * mk, {R}) + 0.0 AS pkk, round(exi, {R}) + 0.0 AS exi, n AS n_merged FROM (
 SELECT frame, fresh, sum(share * value) AS mx, sum(share * track) AS mk, sum(share * (4 + value * value)) AS sxx, sum(share * (1 + value * track)) AS sxk, sum(share * (track + track * track)) AS skk, sum(share * exi) AS exi, count(*) AS n FROM now GROUP BY ALL) m
 WHERE EXISTS (SELECT 1 FROM stay s WHERE s.frame = m.frame AND list_contains(s.tracks, m.fresh))""", walk=False, more=HISTORY)
def tracks_by_history(spark, sf_dir):
    out = _by_history(spark, sf_dir)[0]
    e = out.select("frame", "track", F.col("x")[0].alias("x"), F.col("x")[1].alias("k"), F.col("p")[0].alias("pxx"), F.col("p")[1].alias("pxk"), F.col("p")[3].alias("pkk"), "exi", "n_merged")
    return rounded(e, "x", "k", "pkk", "exi").withColumns({c: F.round(c, 4) + F.lit(0.0) for c in ("pxx", "pxk")})


def _cardinalities(spark, sf_dir):
    tracks, _ = frames(spark, sf_dir, 1, LARGE)
    exi = tracks.select("frame", "track", (0.2 + 0.7 * (F.col("value") % 1)).alias("exi"))
    return cardinality.by_frame(cardinality.by_cluster(large_problem(spark, sf_dir)[1], exi))


# every subset of a hypothesis' tracks, and sums over a frame's clusters in turn
COUNTS = """ex AS (SELECT h.frame, h.cluster, h.hypo, h.prob, [0.2 + 0.7 * (t.value % 1) FOR t IN ts] AS es FROM hypothesis h JOIN (SELECT h.frame, h.cluster, h.hypo, coalesce(list(t) FILTER (t.track IS NOT NULL), []) AS ts FROM hypothesis h LEFT JOIN track t ON t.frame = h.frame AND list_contains(h.tracks, t.track) GROUP BY ALL) USING (frame, cluster, hypo)),
subset AS (SELECT frame, cluster, prob, es, mask FROM ex, (SELECT unnest(range(16)) AS mask) WHERE mask < (1 << len(es))),
one AS (SELECT frame, cluster, bit_count(mask::INT)::INT AS n, sum(prob * coalesce(list_product([CASE WHEN (mask >> (i - 1)) & 1 = 1 THEN e ELSE 1 - e END FOR e, i IN es]), 1)) AS p FROM subset GROUP BY ALL),
both_c AS (SELECT frame, n, p, 0 AS cluster FROM one WHERE cluster = 0 UNION ALL SELECT b.frame, b.n + o.n, b.p * o.p, o.cluster FROM both_c b JOIN one o ON o.frame = b.frame AND o.cluster = b.cluster + 1),
counts AS (SELECT b.frame, n, sum(p) AS p FROM both_c b JOIN (SELECT frame, max(cluster) AS c FROM per GROUP BY frame) l ON l.frame = b.frame AND l.c = b.cluster GROUP BY ALL)"""


@large_query(f"SELECT frame, n::INT AS n, round(p, {R}) + 0.0 AS p FROM counts", walk=False, more=COUNTS)
def target_counts(spark, sf_dir):
    """Distribution of each frame's number of targets; the oracle sums over all subsets."""
    return rounded(_cardinalities(spark, sf_dir), "p")


@large_query(f"SELECT frame, round(sum(n * p), {R}) + 0.0 AS mean, round(sum(n * n * p) - sum(n * p) ** 2, {R}) + 0.0 AS variance FROM counts GROUP BY frame", walk=False, more=COUNTS)
def target_count_moments(spark, sf_dir):
    return rounded(cardinality.moments(_cardinalities(spark, sf_dir), "frame").drop("likeliest"), "mean", "variance")


#: Draws, and where the first of the systematic ones lies.
DRAWS, START, SEED = 5000, 0.25, 11
CUM = "cum AS (SELECT event_id, w, sum(w) OVER (ORDER BY event_id, w ROWS UNBOUNDED PRECEDING)::HUGEINT AS upto, sum(w) OVER ()::HUGEINT AS total FROM (SELECT event_id, round(value * 100)::BIGINT AS w FROM events))"


def _weighed(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", resampling.units(F.col("value"), 100).alias("w"))


@query(f"""SELECT event_id, w, (greatest(0, least({DRAWS}, (upto * {DRAWS} - floor({START} * total)::HUGEINT + total - 1) // total)) - greatest(0, least({DRAWS}, ((upto - w) * {DRAWS} - floor({START} * total)::HUGEINT + total - 1) // total)))::BIGINT AS "count" FROM cum""", walk=False, more=CUM)
def systematic_counts(spark, sf_dir):
    """How often each event is drawn by points at equal distances on the line of all values."""
    return resampling.systematic(_weighed(spark, sf_dir), "event_id", "w", DRAWS, START)


@query(f"""SELECT draw, event_id, w FROM (SELECT d.draw, ('0x' || substr(md5('{SEED}:' || d.draw), 1, 15))::HUGEINT % (SELECT any_value(total) FROM cum) AS at FROM (SELECT unnest(range({DRAWS})) AS draw) d) x
ASOF JOIN (SELECT event_id, w, upto - w AS begin FROM cum WHERE w > 0) c ON x.at >= c.begin""", walk=False, more=CUM)
def roulette_draws(spark, sf_dir):
    """Independent draws of events by their values (the feature is the sample)."""
    return resampling.roulette(_weighed(spark, sf_dir), "event_id", "w", DRAWS, SEED)


@large_query(f"""SELECT frame, least(count(*), 2)::BIGINT AS n, round(sum(w), {R}) AS weight, round(sum(w * value) / sum(w), {R}) AS x, round(sum(w * track) / sum(w), {R}) AS k,
 round(sum(w * (9 + value * value)) / sum(w) - (sum(w * value) / sum(w)) ** 2, 4) AS spread FROM (SELECT *, 0.2 + 0.7 * (value % 1) AS w FROM track) GROUP BY frame""", walk=False)
def reduced_mixtures(spark, sf_dir):
    """Frames' tracks as mixtures, reduced to two components: mass, mean and spread stay, which the oracle has from the whole."""
    tracks, _ = frames(spark, sf_dir, 1, LARGE)
    c = tracks.select("frame", F.col("track").alias("component"), (0.2 + 0.7 * (F.col("value") % 1)).alias("weight"), F.array("value", F.col("track").cast("double")).alias("x"), F.array(F.lit(9.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("p"))
    out = mixtures.reduced_components(c, 2)
    mean = lambda v: F.sum(F.col("weight") * v) / F.sum("weight")
    x = F.col("x")[0]
    e = out.groupBy("frame").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"), mean(x).alias("x"), mean(F.col("x")[1]).alias("k"), (mean(F.col("p")[0] + x * x) - mean(x) * mean(x)).alias("spread"))
    return rounded(e, "weight", "x", "k").withColumn("spread", F.round("spread", 4))


