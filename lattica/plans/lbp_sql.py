"""Belief propagation as DuckDB SQL: a fixed number of iterations as common table expressions. It's the oracle of operators.lbp."""

from __future__ import annotations


def steps(iterations: int) -> str:
    """CTEs edge0 .. edgeK (mu, nu), node0 .. nodeK (rho, sigma) over reward and hypothesis tables."""
    out = """
w AS MATERIALIZED (SELECT frame, track, meas, exp(ll) AS w FROM reward WHERE meas > 0),
w0 AS MATERIALIZED (SELECT frame, track, exp(ll) AS w0 FROM reward WHERE meas = 0),
hyp AS MATERIALIZED (SELECT frame, cluster, hypo, tracks, prob / sum(prob) OVER (PARTITION BY frame, cluster) AS phi FROM hypothesis),
pair AS MATERIALIZED (SELECT h.frame, h.cluster, h.hypo, m.track, list_contains(h.tracks, m.track) AS has FROM hyp h JOIN member m USING (frame, cluster)),
e0 AS MATERIALIZED (SELECT frame, track, meas, w / (w0 + 1 + sum(w) OVER (PARTITION BY frame, track) - w) AS mu, w FROM w JOIN w0 USING (frame, track)),
"""
    for k in range(iterations + 1):
        if k:
            out += f"e{k} AS MATERIALIZED (SELECT frame, track, meas, w / (w0 + sigma + sum(w * nu) OVER (PARTITION BY frame, track) - w * nu) AS mu, w FROM edge{k - 1} JOIN node{k - 1} USING (frame, track)),\n"
        out += f"""
edge{k} AS MATERIALIZED (SELECT *, 1 / (1 + sum(mu) OVER (PARTITION BY frame, meas) - mu) AS nu FROM e{k}),
rho{k} AS MATERIALIZED (SELECT frame, track, any_value(w0) + coalesce(sum(w * nu), 0) AS rho, any_value(w0) AS w0 FROM w0 LEFT JOIN edge{k} USING (frame, track) GROUP BY ALL),
mass{k} AS MATERIALIZED (SELECT frame, cluster, hypo, phi * product(CASE WHEN has THEN rho ELSE 1 END) AS mass FROM pair JOIN rho{k} USING (frame, track) JOIN hyp USING (frame, cluster, hypo) GROUP BY frame, cluster, hypo, phi),
node{k} AS MATERIALIZED (SELECT frame, track, any_value(rho) AS rho, any_value(w0) AS w0, any_value(rho) * sum(CASE WHEN has THEN 0 ELSE mass END) / sum(CASE WHEN has THEN mass ELSE 0 END) AS sigma
  FROM pair JOIN mass{k} USING (frame, cluster, hypo) JOIN rho{k} USING (frame, track) GROUP BY frame, track),"""
    return out.rstrip(",\n")


def bethe(k: int) -> str:
    """CTE bethe(frame, log_z) from the last iteration. Pairs that the gate parts have no weight but still count."""
    return f"""
meas_of AS (SELECT DISTINCT frame, meas FROM w),
n_of AS (SELECT frame, count(*) AS n FROM w0 GROUP BY ALL),
m_of AS (SELECT frame, count(*) AS m FROM meas_of GROUP BY ALL),
row_sum AS (SELECT frame, track, rho AS row, rho + sigma AS z FROM node{k}),
col_sum AS (SELECT frame, meas, 1 + sum(mu) AS z FROM edge{k} GROUP BY ALL),
tj AS (SELECT r.frame, sum(ln((c.z - coalesce(e.mu, 0)) * (r.z - coalesce(e.w * e.nu, 0)) + coalesce(e.w, 0))) AS f FROM row_sum r JOIN col_sum c USING (frame) LEFT JOIN edge{k} e ON e.frame = r.frame AND e.track = r.track AND e.meas = c.meas GROUP BY r.frame),
th AS (SELECT frame, cluster, sum(mass) AS z FROM mass{k} GROUP BY ALL),
f_theta AS (SELECT frame, sum((n - 1) * ln(z)) AS f FROM th JOIN (SELECT frame, cluster, count(*) AS n FROM member GROUP BY ALL) USING (frame, cluster) GROUP BY ALL),
tth AS (SELECT frame, track, ln(sum(mass)) AS f FROM pair JOIN mass{k} USING (frame, cluster, hypo) GROUP BY ALL),
bethe AS (SELECT n_of.frame, -((SELECT f FROM f_theta t WHERE t.frame = n_of.frame) + coalesce((SELECT sum(m * ln(z)) FROM row_sum r JOIN m_of USING (frame) WHERE r.frame = n_of.frame), 0)
  + coalesce((SELECT sum((n - 1) * ln(z)) FROM col_sum c WHERE c.frame = n_of.frame), 0) - coalesce((SELECT f FROM tj WHERE tj.frame = n_of.frame), 0) - (SELECT sum(f) FROM tth WHERE tth.frame = n_of.frame)) AS log_z FROM n_of)"""
