"""Queries of conditioned results, mixtures over hypotheses, converged propagation, batch analytics and tracker stages, with their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..functions.lineage import kept
from ..operators import analytics, assignment, conditioning, exact, lbp, metrics, single, tracking
from ..operators import hypotheses as hy
from . import lbp_sql
from .catalog import ERR_R, MARGINAL_SQL, ORACLE, STEPS, Z_SQL, R, _errors, _labels, _z, lbp_theta, query, rounded, theta_posteriors
from .problems import ENUMERATION, SIZE, SQL, frames, problem

#: Rounds after which messages of the queries' problems stand still; tolerance and digits of converged results.
ROUNDS, STILL, DIGITS = 40, 1e-12, 5


def _conditioned(spark, sf_dir, forced):
    r, h = map(kept, problem(spark, sf_dir))
    return conditioning.Conditioned(r, h, hy.merge_map(r, h), forced)


@query(f"SELECT frame, track, kind, meas, round(p, {R}) + 0.0 AS p FROM exact_p", more=MARGINAL_SQL)
def conditioned_marginals(spark, sf_dir):
    """Marginals of all tracks by conditioning on the owners of linking measurements; the oracle enumerates merged hypotheses."""
    return rounded(_conditioned(spark, sf_dir, True).marginals(), "p")


@query(f"""SELECT frame, l.cluster, l.hypo, round(w / sum(w) OVER (PARTITION BY frame, l.cluster), {R}) + 0.0 AS p
FROM (SELECT frame, l, sum(w) AS w FROM (SELECT frame, unnest(labels) AS l, w FROM joint) GROUP BY ALL)""")
def conditioned_theta(spark, sf_dir):
    return rounded(_conditioned(spark, sf_dir, True).theta(), "p")


ALLOWED = """lk AS (SELECT frame, master, meas, count(*) + 1 AS k FROM gated JOIN cluster_map USING (frame, cluster) GROUP BY ALL HAVING count(*) > 1),
free_links AS (SELECT frame, master, list({'m': meas, 'k': k}) AS ls FROM lk GROUP BY ALL),
many AS (SELECT j.*, w * coalesce(list_reduce(list_prepend(1::DOUBLE, [CASE WHEN list_contains(picks, x.m) THEN 1 ELSE x.k END::DOUBLE FOR x IN ls]), lambda a, b: a * b), 1) AS v FROM joint j LEFT JOIN free_links USING (frame, master)),
zv AS (SELECT frame, master, sum(v) AS z FROM many GROUP BY ALL),
pv AS (SELECT frame, master, unnest(tracks) AS track, unnest(picks) AS meas, v FROM many)"""


#: Of sums p by frame, track and meas (0 missed): all kinds, with what is left for not existing.
ALL_KINDS = """SELECT frame, track, CASE WHEN meas = 0 THEN 'missed' ELSE 'detection' END AS kind, meas, round(p, {R}) + 0.0 AS p FROM ({p})
UNION ALL SELECT m.frame, m.track, 'nonexistence', NULL, round(1 - coalesce(sum(x.p), 0), {R}) + 0.0 FROM member m LEFT JOIN ({p}) x ON x.frame = m.frame AND x.track = m.track GROUP BY m.frame, m.track"""


def _all_kinds(p: str) -> str:
    return ALL_KINDS.replace("{p}", p).replace("{R}", str(R))


@query(_all_kinds("SELECT frame, track, meas, sum(v) / any_value(z) AS p FROM pv JOIN zv USING (frame, master) GROUP BY frame, track, meas"), more=ALLOWED)
def approximate_conditioned(spark, sf_dir):
    """Marginals where an owner may leave what it owns: an association counts for each ownership that allows it."""
    return rounded(_conditioned(spark, sf_dir, False).marginals(), "p")


@query(f"SELECT frame, master, round(z, {R}) AS z FROM zv", more=ALLOWED)
def approximate_evidence(spark, sf_dir):
    return rounded(_conditioned(spark, sf_dir, False).evidence().select("frame", "master", "z"), "z")


def _ways_sql(forced: bool = True) -> str:
    """Messages of each hypothesis and set of used (or allowed) shared measurements (problems of clusters of two tracks), and sums over
    disjoint sets."""
    tracks_of = "s.tracks" if forced else "(SELECT any_value(p.tracks) FROM per p WHERE p.frame = s.frame AND p.cluster = s.cluster)"
    unused = conditioning.UNUSED if forced else 1
    out = f"""shared AS (SELECT frame, master, meas FROM gated JOIN cluster_map USING (frame, cluster) GROUP BY ALL HAVING count(*) > 1),
alone AS (SELECT h.frame, c.master, h.cluster, h.hypo, h.tracks, h.prob / sum(h.prob) OVER (PARTITION BY h.frame, h.cluster) AS prob FROM hypothesis h JOIN cluster_map c USING (frame, cluster)),
near AS (SELECT s.frame, s.cluster, s.hypo, list_sort(list(DISTINCT r.meas)) AS ms FROM alone s JOIN reward r ON r.frame = s.frame AND list_contains({tracks_of}, r.track) JOIN shared k ON k.frame = s.frame AND k.master = s.master AND k.meas = r.meas GROUP BY ALL),
sets AS MATERIALIZED (SELECT *, list_filter(ms, lambda m, i: (mask >> (i - 1)) & 1 = 1) AS uses, row_number() OVER (ORDER BY frame, cluster, hypo, mask) AS id FROM (SELECT s.*, coalesce(n.ms, []::INT[]) AS ms FROM alone s LEFT JOIN near n USING (frame, cluster, hypo)), (SELECT unnest(range(1 << {SIZE}))::INT AS mask) WHERE mask < (1 << len(ms))),
opts AS MATERIALIZED (SELECT u.id, u.frame, r.track, r.meas, exp(r.ll) AS w, CASE WHEN list_contains(u.uses, r.meas) THEN {unused} ELSE 1 END AS c FROM sets u JOIN reward r ON r.frame = u.frame AND list_contains(u.tracks, r.track) AND (list_contains(u.uses, r.meas) OR NOT list_contains(u.ms, r.meas))),
able AS MATERIALIZED (SELECT * FROM sets u {'WHERE len(uses) <= (SELECT count(DISTINCT track) FROM opts o WHERE o.id = u.id AND o.c < 1)' if forced else ''}),
f0 AS MATERIALIZED (SELECT o.*, z.w AS w0, 1.0::DOUBLE AS nu FROM opts o JOIN opts z ON z.id = o.id AND z.track = o.track AND z.meas = 0 JOIN able ON able.id = o.id WHERE o.meas > 0),"""
    for k in range(1, MIX + 1):
        out += f"""
e{k} AS MATERIALIZED (SELECT a.id, a.frame, a.track, a.meas, a.w, a.w0, a.c, a.w / (a.w0 + coalesce((SELECT sum(b.w * b.nu) FROM f{k - 1} b WHERE b.id = a.id AND b.track = a.track AND b.meas <> a.meas), 0)) AS mu FROM f{k - 1} a),
f{k} AS MATERIALIZED (SELECT a.*, 1 / (a.c + coalesce((SELECT sum(b.mu) FROM e{k} b WHERE b.id = a.id AND b.meas = a.meas AND b.track <> a.track), 0)) AS nu FROM e{k} a),"""
    return out + f"""
whole AS MATERIALIZED (SELECT o.id, o.frame, o.track, o.w AS w0, o.w + coalesce((SELECT sum(f.w * f.nu) FROM f{MIX} f WHERE f.id = o.id AND f.track = o.track), 0) AS s FROM opts o JOIN able USING (id) WHERE o.meas = 0),
way AS MATERIALIZED (SELECT a.id, a.frame, a.master, a.cluster, a.uses, a.prob * exp(coalesce((SELECT sum(ln(s)) FROM whole x WHERE x.id = a.id), 0)
 + coalesce((SELECT sum(ln(t)) FROM (SELECT id, meas, any_value(c) + sum(mu) AS t FROM f{MIX} GROUP BY id, meas) x WHERE x.id = a.id), 0) - coalesce((SELECT sum(ln(1 + mu * nu)) FROM f{MIX} x WHERE x.id = a.id), 0)) AS w FROM able a),
turn AS (SELECT frame, master, cluster, lag(cluster) OVER (PARTITION BY frame, master ORDER BY cluster) AS prior, count(*) OVER (PARTITION BY frame, master) AS n FROM cluster_map),
both_of AS (SELECT y.frame, y.master, y.cluster AS at, 1 AS done, [y.id] AS ids, y.uses AS used, y.w FROM way y WHERE y.cluster = y.master
 UNION ALL SELECT g.frame, g.master, y.cluster, g.done + 1, list_append(g.ids, y.id), list_concat(g.used, y.uses), g.w * y.w FROM both_of g JOIN turn t ON t.frame = g.frame AND t.master = g.master AND t.prior = g.at JOIN way y ON y.frame = g.frame AND y.cluster = t.cluster WHERE NOT list_has_any(g.used, y.uses)),
met_all AS MATERIALIZED (SELECT g.frame, g.master, g.ids, g.w FROM both_of g JOIN turn t ON t.frame = g.frame AND t.cluster = g.at WHERE g.done = t.n),
way_z AS (SELECT frame, master, sum(w) AS z FROM met_all GROUP BY ALL),
way_p AS (SELECT id, sum(w / z) AS post FROM (SELECT frame, master, unnest(ids) AS id, w FROM met_all) JOIN way_z USING (frame, master) GROUP BY id),
loopy AS (SELECT frame, track, 0 AS meas, post * w0 / s AS p FROM whole JOIN way_p USING (id) UNION ALL SELECT f.frame, f.track, f.meas, post * f.w * nu / s FROM f{MIX} f JOIN whole USING (id, track) JOIN way_p USING (id))"""


#: Rounds of the messages of single hypotheses, which the oracles follow.
MIX = 6
WAYS_SQL = _ways_sql()


def _loopy(spark, sf_dir):
    r, h = map(kept, problem(spark, sf_dir))
    return conditioning.Conditioned(r, h, hy.merge_map(r, h), True, partial(conditioning.propagated, tol=0.0, most=MIX))


@query(_all_kinds("SELECT frame, track, meas, sum(p) AS p FROM loopy GROUP BY frame, track, meas"), walk=False, more=WAYS_SQL)
def propagated_conditioned(spark, sf_dir):
    """Marginals by conditioning on the owners of linking measurements, each cluster solved by messages."""
    return rounded(_loopy(spark, sf_dir).marginals(), "p")


@query(f"SELECT frame, master, round(z, {R}) AS z FROM way_z", walk=False, more=WAYS_SQL)
def propagated_evidence(spark, sf_dir):
    return rounded(_loopy(spark, sf_dir).evidence().select("frame", "master", "z"), "z")


@query(f"SELECT s.frame, s.cluster, s.hypo, round(sum(post), {R}) + 0.0 AS p FROM able s JOIN way_p USING (id) GROUP BY ALL", walk=False, more=WAYS_SQL)
def propagated_theta(spark, sf_dir):
    return rounded(_loopy(spark, sf_dir).theta(), "p")


ALLOWED_SQL = _ways_sql(False)


def _allowing(spark, sf_dir):
    r, h = map(kept, problem(spark, sf_dir))
    return conditioning.Conditioned(r, h, hy.merge_map(r, h), True, partial(conditioning.allowed, tol=0.0, most=MIX))


@query(_all_kinds("SELECT frame, track, meas, sum(p) AS p FROM loopy GROUP BY frame, track, meas"), walk=False, more=ALLOWED_SQL)
def allowed_marginals(spark, sf_dir):
    """Marginals by one run of messages for each set of measurements that a cluster may use."""
    return rounded(_allowing(spark, sf_dir).marginals(), "p")


@query(f"SELECT frame, master, round(z, {R}) AS z FROM way_z", walk=False, more=ALLOWED_SQL)
def allowed_evidence(spark, sf_dir):
    return rounded(_allowing(spark, sf_dir).evidence().select("frame", "master", "z"), "z")


@query("SELECT frame, master, meas, dense_rank() OVER (PARTITION BY frame, master ORDER BY meas)::INT AS place FROM gated JOIN cluster_map USING (frame, cluster) GROUP BY frame, master, meas HAVING count(*) > 1", walk=False)
def remapped_links(spark, sf_dir):
    r, h = problem(spark, sf_dir)
    return conditioning.remapped(hy.linking_measurements(r, h, hy.merge_map(r, h))).select("frame", "master", "meas", "place")


#: The same problems where tracks of odd number can't be missed: some masters have no association at all.
SURE = SQL.replace("AS ll FROM track\n", "AS ll FROM track WHERE track % 2 = 0\n")


def _sure(spark, sf_dir):
    r, h = problem(spark, sf_dir)
    return kept(exact.summed(r.filter("meas > 0 OR track % 2 = 0"), h))


def _with_sql(sql: str):
    """Register a query with a whole oracle of its own."""

    def add(f):
        ORACLE[f.__name__] = sql
        return query()(f)

    return add


@_with_sql(f"""WITH RECURSIVE {SURE},{ENUMERATION} SELECT c.frame, round(product(coalesce(z, 0)), {R}) AS z, round(sum(coalesce(ln(z), '-inf'::DOUBLE)), {R}) + 0.0 AS log_z, product(coalesce(n, 0)::DOUBLE) AS n_joint
FROM cluster_map c LEFT JOIN total t ON t.frame = c.frame AND t.master = c.cluster WHERE c.is_master GROUP BY c.frame""")
def infeasible_evidence(spark, sf_dir):
    """Evidence where some masters have no association: their frame's is 0."""
    sums = _sure(spark, sf_dir)
    out = rounded(exact.evidence(sums, exact.map_of(sums)), "z")
    return out.withColumn("log_z", F.when(F.col("log_z") > float("-inf"), F.round("log_z", R) + F.lit(0.0)).otherwise(F.col("log_z")))


@_with_sql(f"""WITH RECURSIVE {SURE},{ENUMERATION}, there AS (SELECT frame, master, unnest(tracks) AS track, unnest(picks) AS meas, w FROM joint), s AS (SELECT frame, track, sum(w) AS w FROM there GROUP BY ALL)
SELECT m.frame, m.track, 'nonexistence' AS kind, NULL::INT AS meas, round(CASE WHEN z IS NULL THEN 0 ELSE 1 - coalesce(s.w, 0) / z END, {R}) + 0.0 AS p FROM member m JOIN cluster_map c USING (frame, cluster) LEFT JOIN total t ON t.frame = m.frame AND t.master = c.master LEFT JOIN s ON s.frame = m.frame AND s.track = m.track
UNION ALL SELECT frame, track, CASE WHEN meas = 0 THEN 'missed' ELSE 'detection' END, meas, round(sum(w) / any_value(z), {R}) + 0.0 FROM there JOIN total USING (frame, master) GROUP BY frame, track, meas""")
def infeasible_marginals(spark, sf_dir):
    sums = _sure(spark, sf_dir)
    return rounded(exact.marginals(sums, exact.tracks_of(sums)), "p")


#: What every log-weight is raised by: sums of such weights vanish unless they're taken relative to the largest.
RAISED = -800


def _raised(spark, sf_dir):
    r, h = map(kept, problem(spark, sf_dir))
    return r.withColumn("ll", F.col("ll") + RAISED), h


@query(f"SELECT frame, track, kind, meas, round(p, {R}) + 0.0 AS p FROM raised_p", walk=False, more="""
-- tracks in the first hypothesis of each cluster alone: each association has all tracks of a frame's cluster, so raising changes no share
first_of AS (SELECT * FROM hypothesis WHERE hypo = 0),
go AS (SELECT m.frame, m.master, list_sort(flatten(list(f.tracks))) AS tracks FROM first_of f JOIN cluster_map m USING (frame, cluster) GROUP BY ALL),
rw AS (SELECT frame, master, tracks, 0 AS done, []::INT[] AS picks, 0.0::DOUBLE AS ll FROM go
  UNION ALL SELECT w.frame, w.master, w.tracks, w.done + 1, list_append(w.picks, r.meas), w.ll + r.ll FROM rw w JOIN reward r ON r.frame = w.frame AND r.track = w.tracks[w.done + 1] WHERE w.done < len(w.tracks) AND (r.meas = 0 OR NOT list_contains(w.picks, r.meas))),
rz AS (SELECT frame, master, sum(exp(ll)) AS z FROM rw WHERE done = len(tracks) GROUP BY ALL),
raised_p AS (SELECT k.frame, track, CASE WHEN meas = 0 THEN 'missed' ELSE 'detection' END AS kind, meas, sum(w) / any_value(z) AS p
  FROM (SELECT frame, master, unnest(tracks) AS track, unnest(picks) AS meas, exp(ll) AS w FROM rw WHERE done = len(tracks)) k JOIN rz USING (frame, master) GROUP BY k.frame, track, meas
  UNION ALL SELECT frame, unnest(tracks), 'nonexistence', NULL, 0 FROM go)""")
def raised_marginals(spark, sf_dir):
    """Marginals where every weight is e^-800 of what it was: the oracle has them as they were."""
    r, h = _raised(spark, sf_dir)
    sums = kept(exact.summed(r, h.filter("hypo = 0")))
    return rounded(exact.marginals(sums, exact.tracks_of(sums)), "p")


RAISED_Z = f"""SELECT frame, master, round(ln(sum(exp(ln(w) - 0.0) * exp({RAISED}::DOUBLE * (len(tracks) - least_n)))) + {RAISED}::DOUBLE * any_value(least_n), {R}) + 0.0 AS log_z
FROM joint JOIN (SELECT frame, master, min(len(tracks)) AS least_n FROM joint GROUP BY ALL) USING (frame, master) GROUP BY frame, master"""


@query(RAISED_Z)
def raised_evidence(spark, sf_dir):
    r, h = _raised(spark, sf_dir)
    return rounded(exact.evidence_by_master(exact.summed(r, h)).select("frame", "master", "log_z"), "log_z")


@query(RAISED_Z)
def raised_conditioned_evidence(spark, sf_dir):
    r, h = _raised(spark, sf_dir)
    return rounded(conditioning.Conditioned(r, h, hy.merge_map(r, h)).evidence().select("frame", "master", "log_z"), "log_z")


@query(f"""SELECT frame, l.cluster, l.hypo, round(w / sum(w) OVER (PARTITION BY frame, l.cluster), {R}) + 0.0 AS p
FROM (SELECT frame, l, sum(w) AS w FROM (SELECT frame, unnest(labels) AS l, w * exp({RAISED}::DOUBLE * (len(tracks) - least_n)) AS w FROM joint JOIN (SELECT frame, master, min(len(tracks)) AS least_n FROM joint GROUP BY ALL) USING (frame, master)) GROUP BY ALL)""")
def raised_theta(spark, sf_dir):
    r, h = _raised(spark, sf_dir)
    return rounded(exact.theta_posteriors(kept(exact.summed(r, h)), h), "p")


# converged propagation

STILL_SQL = f"""{lbp_sql.steps(ROUNDS)}, {lbp_sql.bethe(ROUNDS)}, z AS (SELECT frame, track, rho + sigma AS z, w0, sigma FROM node{ROUNDS}),
still_p AS (SELECT frame, track, 'missed' AS kind, 0 AS meas, w0 / z AS p FROM z UNION ALL SELECT frame, track, 'nonexistence', NULL, sigma / z FROM z
 UNION ALL SELECT frame, track, 'detection', meas, w * nu / z FROM edge{ROUNDS} JOIN z USING (frame, track))"""


def _still(spark, sf_dir):
    r, h = problem(spark, sf_dir)
    return lbp.lbp(r, h, r.select("frame").distinct().count(), None, 300, (STILL, STILL))


@query(f"SELECT frame, track, kind, meas, round(p, {DIGITS}) + 0.0 AS p FROM still_p", walk=False, more=STILL_SQL)
def converged_marginals(spark, sf_dir):
    """Marginals at the fixed point of the messages; the oracle passes 40 rounds."""
    out = _still(spark, sf_dir).filter("kind in ('missed', 'detection', 'nonexistence')").select("frame", "track", "kind", "meas", "p")
    return out.withColumn("p", F.round("p", DIGITS) + F.lit(0.0))


@query(f"SELECT frame, round(log_z, {DIGITS}) + 0.0 AS log_z FROM bethe", walk=False, more=STILL_SQL)
def converged_evidence(spark, sf_dir):
    return _still(spark, sf_dir).groupBy("frame").agg((F.round(F.first("log_z"), DIGITS) + F.lit(0.0)).alias("log_z"))


@query(f"SELECT frame, track, kind, meas, round(p, {DIGITS}) + 0.0 AS p FROM still_p", walk=False, more=STILL_SQL)
def alternative_marginals(spark, sf_dir):
    """The fixed point again, where messages stop by the marginals they make."""
    r, h = problem(spark, sf_dir)
    out = lbp.by_marginals(r, h, r.select("frame").distinct().count(), STILL, STILL)
    return out.select("frame", "track", "kind", "meas", (F.round("p", DIGITS) + F.lit(0.0)).alias("p"))


@query(" UNION ALL ".join(f"SELECT frame, {k} AS round, message, round(min(v), {R}) + 0.0 AS least, round(max(v), {R}) + 0.0 AS largest FROM (SELECT frame, unnest([{{'message': 'mu', 'v': mu}}, {{'message': 'nu', 'v': nu}}], recursive := true) FROM edge{k} UNION ALL SELECT frame, 'inverse_rho', 1 / rho FROM node{k} UNION ALL SELECT frame, 'sigma', sigma FROM node{k}) GROUP BY frame, message" for k in range(STEPS + 2)), walk=False, more=lbp_sql.steps(STEPS + 1))
def message_trace(spark, sf_dir):
    """The extremes of each round's messages."""
    r, h = problem(spark, sf_dir)
    return rounded(lbp.trace(r, h, r.select("frame").distinct().count(), STEPS + 1), "least", "largest")


LOOSE, LOOSE_MOST = 1e-3, 12
NORM = "norm AS (" + " UNION ALL ".join(f"SELECT a.frame, {k} AS k, max(abs(ln(a.nu / b.nu))) AS err FROM edge{k} a JOIN edge{k - 1} b USING (frame, track, meas) GROUP BY a.frame" for k in range(1, LOOSE_MOST + 1)) + f""" UNION ALL SELECT frame, 1, 0 FROM w0 WHERE frame NOT IN (SELECT frame FROM w) GROUP BY frame),
met AS (SELECT frame, coalesce(min(k) FILTER (err <= {LOOSE}), 0)::INT AS message_iterations FROM norm GROUP BY frame)"""
NORM_SQL = lbp_sql.steps(LOOSE_MOST) + ", " + NORM


def _loose(spark, sf_dir):
    r, h = problem(spark, sf_dir)
    out = kept(lbp.lbp(r, h, r.select("frame").distinct().count(), None, LOOSE_MOST, (float("inf"), LOOSE)))
    marked = out.groupBy("frame").agg(*[F.first(c).alias(c) for c in ("iterations", "bethe_iterations", "message_iterations")])
    return analytics.convergence(marked, LOOSE_MOST)


@query("SELECT frame, message_iterations FROM met", walk=False, more=NORM_SQL)
def message_iterations(spark, sf_dir):
    """Rounds until messages change by no more than a factor of 1.001 (0: not within twelve)."""
    return _loose(spark, sf_dir).select("frame", "message_iterations")


@query(f"""SELECT cardinality, round(avg(message_iterations) FILTER (message_iterations > 0), {R}) AS mean_iterations, count(*) AS n, count(*) FILTER (message_iterations = 0) AS n_diverged
FROM met JOIN (SELECT frame, count(*) AS cardinality FROM hypothesis GROUP BY frame) USING (frame) GROUP BY cardinality""", walk=False, more=NORM_SQL)
def iterations_by_cardinality(spark, sf_dir):
    return rounded(analytics.iterations_by_cardinality(_loose(spark, sf_dir), problem(spark, sf_dir)[1]), "mean_iterations")


@query(f"""SELECT message_iterations > 0 AS converged, count(*) AS n, round(avg(CASE WHEN message_iterations > 0 THEN message_iterations ELSE {LOOSE_MOST} END), {R}) AS mean_iterations,
max(CASE WHEN message_iterations > 0 THEN message_iterations ELSE {LOOSE_MOST} END)::INT AS most_iterations FROM met GROUP BY 1""", walk=False, more=NORM_SQL)
def convergence_summary(spark, sf_dir):
    return rounded(analytics.convergence_summary(_loose(spark, sf_dir)), "mean_iterations")


# mixtures over joint hypotheses

def _mix_sql() -> str:
    out = """
jh AS MATERIALIZED (SELECT frame, master, labels, lp, unnest(tracks) AS track FROM merged),
a0 AS MATERIALIZED (SELECT j.frame, j.master, j.labels, j.track, r.meas, exp(r.ll - o.ll) AS a FROM jh j JOIN reward r ON r.frame = j.frame AND r.track = j.track AND r.meas > 0 JOIN reward o ON o.frame = j.frame AND o.track = j.track AND o.meas = 0),
n0 AS MATERIALIZED (SELECT *, 0.0::DOUBLE AS mu, 1.0::DOUBLE AS nu FROM a0),"""
    for k in range(1, MIX + 1):
        out += f"""
m{k} AS MATERIALIZED (SELECT frame, master, labels, track, meas, a, a / (1 + sum(a * nu) OVER (PARTITION BY frame, master, labels, track) - a * nu) AS mu FROM n{k - 1}),
n{k} AS MATERIALIZED (SELECT *, 1 / (1 + sum(mu) OVER (PARTITION BY frame, master, labels, meas) - mu) AS nu FROM m{k}),"""
    return out + f"""
row_of AS (SELECT frame, master, labels, track, sum(a * nu) AS s FROM n{MIX} GROUP BY ALL),
hyp_z AS (SELECT g.frame, g.master, g.labels, g.lp, coalesce((SELECT sum(o.ll) FROM jh j JOIN reward o ON o.frame = j.frame AND o.track = j.track AND o.meas = 0 WHERE j.frame = g.frame AND j.master = g.master AND j.labels = g.labels), 0)
 + coalesce((SELECT sum(ln(1 + s)) FROM row_of r WHERE r.frame = g.frame AND r.master = g.master AND r.labels = g.labels), 0)
 + coalesce((SELECT sum(ln(1 + c)) FROM (SELECT meas, sum(mu) AS c FROM n{MIX} n WHERE n.frame = g.frame AND n.master = g.master AND n.labels = g.labels GROUP BY meas)), 0)
 - coalesce((SELECT sum(ln(1 + mu * nu)) FROM n{MIX} n WHERE n.frame = g.frame AND n.master = g.master AND n.labels = g.labels), 0) AS log_z FROM merged g),
hyp_w AS (SELECT *, exp(lp + log_z) / sum(exp(lp + log_z)) OVER (PARTITION BY frame, master) AS post FROM hyp_z),
mix_p AS (SELECT n.frame, n.track, n.meas, sum(post * a * nu / (1 + s)) AS p FROM n{MIX} n JOIN row_of USING (frame, master, labels, track) JOIN hyp_w USING (frame, master, labels) GROUP BY ALL
 UNION ALL SELECT j.frame, j.track, 0, sum(post / (1 + coalesce(s, 0))) FROM jh j JOIN hyp_w USING (frame, master, labels) LEFT JOIN row_of USING (frame, master, labels, track) GROUP BY j.frame, j.track)"""


MIX_SQL = _mix_sql()


def _mixture(spark, sf_dir, log_z=single.by_bethe):
    r, h = problem(spark, sf_dir)
    m = kept(hy.merged(h, hy.merge_map(r, h)))
    return kept(single.per_hypothesis(r, m, log_z, 0.0, MIX)), m


@query(_all_kinds("SELECT frame, track, meas, p FROM mix_p"), more=MIX_SQL)
def mixture_marginals(spark, sf_dir):
    """Marginals by total probability: messages of each joint hypothesis alone, weighted by its Bethe evidence."""
    return rounded(single.total_probability(*_mixture(spark, sf_dir)).select("frame", "track", "kind", "meas", "p"), "p")


@query(f"SELECT frame, round(sum(z), {R}) + 0.0 AS log_z FROM (SELECT frame, master, ln(sum(exp(lp + log_z))) AS z FROM hyp_z GROUP BY frame, master) GROUP BY frame", more=MIX_SQL)
def mixture_evidence(spark, sf_dir):
    return rounded(single.mixture_evidence(*_mixture(spark, sf_dir)), "log_z")


PHD_SQL = """jt AS (SELECT frame, master, labels, unnest(tracks) AS track FROM merged),
pz AS (SELECT g.frame, g.master, g.labels, g.lp - coalesce((SELECT sum(1 - exp(o.ll)) FROM jt j JOIN reward o ON o.frame = j.frame AND o.track = j.track AND o.meas = 0 WHERE j.frame = g.frame AND j.master = g.master AND j.labels = g.labels), 0)
 + coalesce((SELECT sum(ln(1 + c)) FROM (SELECT r.meas, sum(exp(r.ll)) AS c FROM jt j JOIN reward r ON r.frame = j.frame AND r.track = j.track AND r.meas > 0 WHERE j.frame = g.frame AND j.master = g.master AND j.labels = g.labels GROUP BY r.meas)), 0) AS lw FROM merged g)"""


@query(f"SELECT frame, master, array_to_string([x.cluster || ':' || x.hypo FOR x IN labels], ',') AS labels, round(exp(lw) / sum(exp(lw)) OVER (PARTITION BY frame, master), {R}) + 0.0 AS p FROM pz", more=PHD_SQL)
def phd_posteriors(spark, sf_dir):
    """Posteriors of joint hypotheses where each one's evidence is the constant of an intensity filter."""
    per, m = _mixture(spark, sf_dir, single.by_phd)
    out = single.hypothesis_posteriors(per, m).join(m.select("frame", "master", "hypo", "labels"), ["frame", "master", "hypo"])
    return rounded(out.select("frame", "master", _labels(), "p"), "p")


@query()
def iteration_comparison(spark, sf_dir):
    """Rounds of the joint graph against those of each joint hypothesis alone, both until their own stop rules are met."""
    r, h = problem(spark, sf_dir)
    m = hy.merged(h, hy.merge_map(r, h))
    joint = lbp.lbp(r, h, r.select("frame").distinct().count(), None).groupBy("frame").agg(F.first("iterations").alias("iterations"))
    return analytics.iteration_comparison(joint, single.per_hypothesis(r, m))


# truncated results

FREE_ALL = """go AS (SELECT frame, list(track ORDER BY track) AS tracks FROM track GROUP BY ALL),
free AS (SELECT frame, tracks, 0 AS done, []::INT[] AS picks, 0.0::DOUBLE AS ll FROM go UNION ALL
SELECT f.frame, f.tracks, f.done + 1, list_append(f.picks, r.meas), f.ll + r.ll FROM free f JOIN reward r ON r.frame = f.frame AND r.track = f.tracks[f.done + 1] WHERE f.done < len(f.tracks) AND (r.meas = 0 OR NOT list_contains(f.picks, r.meas))),
ranks AS (SELECT frame, tracks, picks, exp(ll) AS w, row_number() OVER (PARTITION BY frame ORDER BY ll DESC) AS rank FROM free WHERE done = len(tracks))"""
KS = (10, 20, 50, 100, 150)


@query(" UNION ALL ".join(f"SELECT {k} AS k, frame, round(ln(sum(w)), {R}) + 0.0 AS log_z FROM ranks WHERE rank <= {k} GROUP BY frame" for k in KS), walk=False, more=FREE_ALL)
def truncated_evidence(spark, sf_dir):
    """Log-evidence of the k best associations of each frame, for five k."""
    return rounded(assignment.truncated_evidence(problem(spark, sf_dir)[0], KS), "log_z")


@query(f"""SELECT frame, track, meas, round(sum(w) / any_value(z), 4) + 0.0 AS p FROM (SELECT frame, unnest(tracks) AS track, unnest(picks) AS meas, w FROM ranks WHERE rank <= 150) JOIN (SELECT frame, sum(w) AS z FROM ranks WHERE rank <= 150 GROUP BY frame) USING (frame) GROUP BY frame, track, meas""", walk=False, more=FREE_ALL)
def truncated_marginals(spark, sf_dir):
    """Marginals of the 150 best associations of each frame."""
    out = assignment.truncated_marginals(problem(spark, sf_dir)[0], 150).select("frame", "track", "meas", "p")
    return out.withColumn("p", F.round("p", 4) + F.lit(0.0))


# errors

@query("SELECT kind, x, round(sum(n) OVER (PARTITION BY kind ORDER BY x DESC) / sum(n) OVER (PARTITION BY kind), 3) AS share FROM (SELECT kind, round(abs(error), 2) AS x, count(*) AS n FROM er GROUP BY ALL)", more=ERR_R)
def survival_by_kind(spark, sf_dir):
    """Survival of absolute errors, of each kind by itself."""
    return analytics.survival(_errors(spark, sf_dir), 2, "kind").withColumn("share", F.round("share", 3))


def _theta(spark, sf_dir):
    return rounded(analytics.theta_errors(theta_posteriors(spark, sf_dir), lbp_theta(spark, sf_dir)), "error")


THETA_SQL = lbp_sql.steps(STEPS) + f""", te AS (SELECT frame, l.cluster AS cluster, l.hypo AS hypo, round(w / sum(w) OVER (PARTITION BY frame, l.cluster), {R}) + 0.0 AS exact FROM (SELECT frame, l, sum(w) AS w FROM (SELECT frame, unnest(labels) AS l, w FROM joint) GROUP BY ALL)),
ta AS (SELECT frame, cluster, hypo, round(mass / sum(mass) OVER (PARTITION BY frame, cluster), {R}) + 0.0 AS approx FROM mass{STEPS}),
th_e AS (SELECT frame, cluster, hypo, exact, approx, round(exact - approx, {R}) + 0.0 AS error FROM te JOIN ta USING (frame, cluster, hypo))"""


@query("SELECT frame, cluster, hypo, exact, approx, error FROM th_e", more=THETA_SQL)
def theta_errors(spark, sf_dir):
    return _theta(spark, sf_dir)


@query("SELECT count(*) AS n, round(corr(exact, approx), 5) AS correlation, round(regr_slope(approx, exact), 5) AS slope, round(regr_intercept(approx, exact), 5) AS intercept FROM th_e", more=THETA_SQL)
def theta_correlation(spark, sf_dir):
    return analytics.correlation(_theta(spark, sf_dir)).select("n", *[F.round(c, 5).alias(c) for c in ("correlation", "slope", "intercept")])


@query("""SELECT round(q1, 5) AS q1, round(median, 5) AS median, round(q3, 5) AS q3, round(min(error) FILTER (error >= q1 - 1.5 * (q3 - q1)), 5) + 0.0 AS low, round(max(error) FILTER (error <= q3 + 1.5 * (q3 - q1)), 5) + 0.0 AS high,
count(*) FILTER (error < q1 - 1.5 * (q3 - q1) OR error > q3 + 1.5 * (q3 - q1)) AS outside FROM th_e, (SELECT quantile_cont(error, 0.25) AS q1, quantile_cont(error, 0.5) AS median, quantile_cont(error, 0.75) AS q3 FROM th_e) GROUP BY q1, median, q3""", more=THETA_SQL)
def theta_error_box(spark, sf_dir):
    out = metrics.box(_theta(spark, sf_dir), "error")
    return out.withColumns({c: F.round(c, 5) + F.lit(0.0) for c in ("q1", "median", "q3", "low", "high")})


@query(f"SELECT frame, round(ln(exact), {R}) + 0.0 AS log_exact, round(ln(approx), {R}) + 0.0 AS log_approx FROM zz WHERE exact > 0 AND approx > 0", more=Z_SQL)
def evidence_scatter(spark, sf_dir):
    return rounded(analytics.evidence_scatter(_z(spark, sf_dir)), "log_exact", "log_approx")


LARGEST = ERR_R + ", large AS (SELECT frame, max(abs(error)) AS largest FROM er GROUP BY frame)"


@query("""SELECT frame, largest, (SELECT count(*) FROM track t WHERE t.frame = large.frame) AS n_tracks, (SELECT count(*) FROM hypothesis h WHERE h.frame = large.frame) AS n_hypos,
coalesce(g.n_gated, 0) AS n_gated, coalesce(g.most_competing, 0) AS most_competing FROM large LEFT JOIN (SELECT frame, count(*) AS n_gated, max(c) AS most_competing FROM (SELECT frame, meas, count(*) AS c FROM reward WHERE meas > 0 GROUP BY ALL) GROUP BY frame) g USING (frame)""", more=LARGEST)
def scatter_table(spark, sf_dir):
    r, h = problem(spark, sf_dir)
    return analytics.scatter_table(_errors(spark, sf_dir), r, h)


EXPLAINED = ("largest", "n_tracks", "n_hypos", "n_gated", "most_competing")


@query(" UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 5) AS correlation FROM explained" for i, a in enumerate(EXPLAINED) for b in EXPLAINED[i + 1 :]), more=LARGEST + """, explained AS (SELECT frame, largest, (SELECT count(*) FROM track t WHERE t.frame = large.frame) AS n_tracks, (SELECT count(*) FROM hypothesis h WHERE h.frame = large.frame) AS n_hypos,
coalesce(g.n_gated, 0) AS n_gated, coalesce(g.most_competing, 0) AS most_competing FROM large LEFT JOIN (SELECT frame, count(*) AS n_gated, max(c) AS most_competing FROM (SELECT frame, meas, count(*) AS c FROM reward WHERE meas > 0 GROUP BY ALL) GROUP BY frame) g USING (frame))""")
def scatter_correlations(spark, sf_dir):
    """Correlation of frames' largest errors and what may explain them, each two."""
    return analytics.scatter_matrix(scatter_table(spark, sf_dir), *EXPLAINED).withColumn("correlation", F.round("correlation", 5))


@query("SELECT frame, largest >= 0.05 AS large_error, relative < 0 AS larger_bethe, abs(ln(1 - relative)) > 0.01 AS large_evidence_error, relative > 0 AND relative * 100 < 1 AS very_right FROM large JOIN rel USING (frame)", more=LARGEST + "," + Z_SQL.replace(lbp_sql.steps(STEPS) + ",", "", 1))
def notable_frames(spark, sf_dir):
    """Frames by the predicates of a closer look, at limits that these small problems reach, on evidence at a resolution of 1e-6."""
    z = _z(spark, sf_dir).select("frame", F.lit(1.0).alias("exact"), (1 - F.col("relative")).alias("approx"))
    return analytics.notable(_errors(spark, sf_dir), z, 0.05, 0.01)


@query("SELECT message_iterations > 0 AS converged, count(*) AS n, round(avg(largest), 5) AS mean, round(stddev_pop(largest), 5) AS sd, max(largest) AS top FROM large JOIN met USING (frame) GROUP BY 1", more=LARGEST.replace(lbp_sql.steps(STEPS), lbp_sql.steps(LOOSE_MOST), 1) + "," + NORM)
def divergence_comparison(spark, sf_dir):
    """Largest errors of the frames whose messages stood still, and of the others."""
    out = analytics.divergence_comparison(_errors(spark, sf_dir), _loose(spark, sf_dir))
    return out.withColumns({c: F.round(c, 5) for c in ("mean", "sd")})


CONV = LARGEST.replace(lbp_sql.steps(STEPS), lbp_sql.steps(LOOSE_MOST), 1) + "," + NORM


@query("SELECT converged, x, round(sum(n) OVER (PARTITION BY converged ORDER BY x DESC) / sum(n) OVER (PARTITION BY converged), 3) AS share FROM (SELECT message_iterations > 0 AS converged, round(abs(error), 2) AS x, count(*) AS n FROM er JOIN met USING (frame) GROUP BY ALL)", more=CONV)
def survival_by_convergence(spark, sf_dir):
    """Survival of absolute errors, of frames that converged and of others."""
    met, not_met = analytics.split_by_convergence(kept(_errors(spark, sf_dir)), kept(_loose(spark, sf_dir).select("frame", "converged")))
    err = met.withColumn("converged", F.lit(True)).unionByName(not_met.withColumn("converged", F.lit(False)))
    return analytics.survival(err, 2, "converged").withColumn("share", F.round("share", 3))


# tracker stages

def _components(spark, sf_dir):
    """Tracks of the problems as an intensity's components, and their frames' measurements."""
    tracks, meas = frames(spark, sf_dir)
    c = tracks.select("frame", F.col("track").alias("component"), F.lit(0.5).alias("weight"), F.col("value").alias("x"), F.lit(100.0).alias("p"))
    return tracking.predicted(c, 1.0, 25.0, 0.98, 100.0), meas.select("frame", "meas", F.col("value").alias("z"))


VALID = "val AS (SELECT t.frame, t.track AS component, m.meas, ln(0.9) + ln(0.49) - 0.5 * (m.value - t.value) ** 2 / 225 - 0.5 * ln(2 * pi() * 225) AS ll FROM track t JOIN meas m ON m.frame = t.frame AND (m.value - t.value) ** 2 / 225 < 9)"


@query(f"SELECT frame, component, meas, round(ll, {R}) + 0.0 AS ll FROM val", walk=False, more=VALID)
def intensity_validation(spark, sf_dir):
    """Gated pairs of an intensity's predicted components and measurements."""
    return rounded(tracking.validated(*_components(spark, sf_dir), 9.0, 0.9), "ll")


@query("SELECT frame, meas, round(sum(exp(ll)) * 1e6, 4) AS micro FROM val GROUP BY frame, meas", walk=False, more=VALID)
def intensity_by_measurement(spark, sf_dir):
    out = tracking.intensity_by_measurement(tracking.validated(*_components(spark, sf_dir), 9.0, 0.9))
    return out.select("frame", "meas", F.round(F.col("total") * 1e6, 4).alias("micro"))


EXI = "exi AS (SELECT frame, track, value, (0.2 + 0.7 * (value % 1)) AS exi FROM track)"


def _exi(spark, sf_dir):
    return frames(spark, sf_dir)[0].withColumn("exi", 0.2 + 0.7 * (F.col("value") % 1))


@query(f"""SELECT b.frame, b.cluster, b.hypo, e.track, round(e.exi, {R}) AS exi FROM (SELECT frame, cluster, hypo, tracks FROM (SELECT *, row_number() OVER (PARTITION BY frame, cluster ORDER BY round(score, 12) DESC, hypo) AS k FROM (
SELECT h.frame, h.cluster, h.hypo, h.tracks, ln(h.prob / sum(h.prob) OVER (PARTITION BY h.frame, h.cluster)) + coalesce((SELECT sum(ln(greatest(e.exi, 1 - e.exi))) FROM exi e WHERE e.frame = h.frame AND list_contains(h.tracks, e.track)), 0) AS score FROM hypothesis h)) WHERE k = 1) b
JOIN exi e ON e.frame = b.frame AND list_contains(b.tracks, e.track) WHERE e.exi > 0.5""", walk=False, more=EXI)
def estimated_tracks(spark, sf_dir):
    """Tracks of the likeliest hypothesis of each cluster that exist by more than a half."""
    return rounded(tracking.estimates(problem(spark, sf_dir)[1], _exi(spark, sf_dir)), "exi")


@query("SELECT e.frame, e.track FROM exi e WHERE EXISTS (SELECT 1 FROM hypothesis h WHERE h.frame = e.frame AND h.hypo = 1 AND list_contains(h.tracks, e.track))", walk=False, more=EXI)
def supported_tracks(spark, sf_dir):
    """Tracks that the second hypothesis of a cluster still has."""
    return tracking.supported(_exi(spark, sf_dir), problem(spark, sf_dir)[1].filter("hypo = 1")).select("frame", "track")


@query("SELECT frame, track, meas, ll > '-inf'::DOUBLE AS valid, round(exp(ll), 6) AS likelihood FROM reward", walk=False)
def validation_likelihood(spark, sf_dir):
    return rounded(tracking.validation_likelihood(problem(spark, sf_dir)[0]), "likelihood")


# every way to match measurements with tracks nearer than 10; what stays free costs 10^2 / 2 each
STEPS_SQL = """sides AS (SELECT coalesce(a.frame, b.frame) AS frame, coalesce(ms, []) AS ms, coalesce(ts, []) AS ts FROM (SELECT frame, list(value ORDER BY meas) AS ms FROM meas GROUP BY frame) a FULL JOIN (SELECT frame, list(value ORDER BY track) AS ts FROM track GROUP BY frame) b ON a.frame = b.frame),
pairing AS (SELECT frame, ms, ts, 0 AS done, []::BIGINT[] AS used, 0.0::DOUBLE AS local FROM sides
 UNION ALL SELECT frame, ms, ts, done + 1, CASE WHEN k > 0 THEN list_append(used, k) ELSE used END, local + CASE WHEN k > 0 THEN (ms[done + 1] - ts[k]) ** 2 ELSE 0 END FROM (SELECT *, unnest(range(0, len(ts) + 1)) AS k FROM pairing WHERE done < len(ms))
 WHERE k = 0 OR (NOT list_contains(used, k) AND abs(ms[done + 1] - ts[k]) < 10))"""


@query(f"""SELECT frame, round(squared, {R}) AS squared, round(local, {R}) + 0.0 AS localisation, missed::INT AS missed, "false"::INT AS "false" FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY round(squared, 9), missed) AS k FROM (
SELECT frame, local, local + 50 * (len(ms) + len(ts) - 2 * len(used)) AS squared, len(ms) - len(used) AS missed, len(ts) - len(used) AS "false" FROM pairing WHERE done = len(ms))) WHERE k = 1""", walk=False, more=STEPS_SQL)
def gospa_steps(spark, sf_dir):
    """Squared GOSPA of each frame's measurements, as truth, and tracks, as estimates; the oracle tries all matchings."""
    tracks, meas = frames(spark, sf_dir)
    side = lambda df: df.select("frame", F.col("value").alias("x"))
    return rounded(assignment.gospa_per_step(side(meas), side(tracks)), "squared", "localisation")


@query()
def recycled_weights(spark, sf_dir):
    """What the associations beyond the two best weigh, of marginals by messages and truncated ones."""
    r, h = problem(spark, sf_dir)
    m = h.groupBy("frame").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tracks")))).alias("tracks")).withColumns({"master": F.lit(0), "hypo": F.lit(0)})
    per = single.per_hypothesis(r, m)
    k = assignment.truncated_marginals(r, 2)
    z = per.groupBy("frame").agg(F.exp(F.first("log_z")).alias("whole")).join(k.groupBy("frame").agg(F.exp(F.first("log_z")).alias("best")), "frame")
    return rounded(analytics.recycling_weights(per, k, z), "weight")


# pivots, maps, set operations, samples

@query("SELECT sector, coalesce(count(*) FILTER (h = 0), 0) AS c0, count(*) FILTER (h = 1) AS c1, count(*) FILTER (h = 2) AS c2, count(*) FILTER (h = 3) AS c3 FROM (SELECT user_id % 8 AS sector, (epoch_us(ts) // 21600000000) % 4 AS h FROM events) GROUP BY sector", walk=False)
def events_by_quarter(spark, sf_dir):
    """Events of each sector by quarter of the day, as a pivot."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 8).alias("row"), (F.floor(us / 21_600_000_000) % 4).cast("int").alias("col"))
    return analytics.heat_pivot(ev.groupBy("row", "col").agg(F.count("*").alias("n")), 4).withColumnRenamed("row", "sector")


@query("SELECT array_to_string(list(k || '=' || n ORDER BY k), ',') AS counts FROM (SELECT len(tracks) AS k, count(*) AS n FROM hypothesis GROUP BY 1)", walk=False)
def hypothesis_sizes(spark, sf_dir):
    """How many hypotheses have how many tracks, from a map."""
    one = analytics.histogram_map(problem(spark, sf_dir)[1].withColumn("k", F.size("tracks")), "k")
    return one.select(F.concat_ws(",", F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string")))).alias("counts"))


@query("SELECT frame, track FROM track EXCEPT SELECT frame, track FROM reward WHERE meas > 0", walk=False)
def ungated_tracks(spark, sf_dir):
    """Tracks that gate nothing."""
    r = problem(spark, sf_dir)[0]
    return r.select("frame", "track").subtract(r.filter("meas > 0").select("frame", "track"))


@query("SELECT frame, meas FROM reward WHERE meas > 0 AND track = 1 INTERSECT SELECT frame, meas FROM reward WHERE meas > 0 AND track = 2", walk=False)
def shared_measurements(spark, sf_dir):
    """Measurements that the first two tracks of a frame both gate."""
    r = problem(spark, sf_dir)[0].filter("meas > 0")
    return r.filter("track = 1").select("frame", "meas").intersect(r.filter("track = 2").select("frame", "meas"))


@query(f"SELECT frame, round(product(z), {R}) AS z, round(sum(ln(z)), {R}) + 0.0 AS log_z, product(n::DOUBLE) AS n_joint FROM total GROUP BY frame ORDER BY md5('7:' || frame), frame LIMIT 20")
def sampled_frames(spark, sf_dir):
    """A seeded sample of 20 frames (the feature is the sample) with exact evidence."""
    return analytics.sampled(rounded(exact.evidence(exact.summed(*problem(spark, sf_dir))), "z", "log_z"), 20, 7, "frame")
