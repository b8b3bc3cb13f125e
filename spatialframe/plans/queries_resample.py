"""Checked queries: matching, permutation, bootstrap and identity nulls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as R, resample as Z
from . import views as V
from .queries_profiles import RATE_SQL, rates
from .queries_spatial import AXIS, NODES_SQL
from .queries_summaries import r
from .registry import query

hx = lambda *parts: "md5(" + "||'|'||".join(parts) + ")"
hint = lambda *parts: f"CAST('0x'||substr({hx(*parts)},1,8) AS BIGINT)"

# --- matching ----------------------------------------------------------------------------------------

MATCH_SQL = f"""cs AS (SELECT sample, entity_id, CAST(floor(log10(greatest(n_tx,1))*20) AS BIGINT) AS bin, row_number() OVER (PARTITION BY sample, CAST(floor(log10(greatest(n_tx,1))*20) AS BIGINT) ORDER BY {hx("'1'", 'entity_id')}, entity_id) AS rk FROM ent WHERE cell_type='TAM' AND lig>0),
 ct AS (SELECT sample, entity_id, CAST(floor(log10(greatest(n_tx,1))*20) AS BIGINT) AS bin, row_number() OVER (PARTITION BY sample, CAST(floor(log10(greatest(n_tx,1))*20) AS BIGINT) ORDER BY {hx("'1'", 'entity_id')}, entity_id) AS pos FROM ent WHERE cell_type<>'TAM'),
 matched AS (SELECT cs.sample, cs.entity_id AS case_id, ct.entity_id AS control_id, CAST(j AS INT) AS slot, 0 AS bin_shift FROM cs, range(1,6) t(j) JOIN ct ON ct.sample=cs.sample AND ct.bin=cs.bin AND ct.pos=(cs.rk-1)*5+j)""".replace("FROM cs, range(1,6) t(j) JOIN", "FROM cs CROSS JOIN range(1,6) t(j) JOIN")


@query("match_depth", f"WITH {MATCH_SQL} SELECT * FROM matched", "ent")
def _(spark, sf):
    e = V.entities(spark, sf)
    return Z.match_depth(e.where("cell_type='TAM' and lig>0"), e.where("cell_type<>'TAM'"), "sample", 5, 20, 0, 1)


@query("match_depth_rounds")
def _(spark, sf):
    e = V.entities(spark, sf)
    case, pool = e.where("cell_type='TAM' and lig>0"), e.where("cell_type='TAM' and lig=0")
    return Z.match_shortfall(case, Z.match_depth(case, pool, "sample", 5, 20, 1, 1), "sample", 5)


# --- permutation -------------------------------------------------------------------------------------

N_DRAWS = 20
QS = ["null_q025", "null_q25", "null_q75", "null_q975"]


def perm_sql(radius, n, ent="ent", by="sample"):
    return f"""mem AS (SELECT *, CASE WHEN cell_type='TAM' THEN 'L' ELSE 'R' END AS side, CASE WHEN cell_type='TAM' THEN lig>0 ELSE rec>0 END AS pos FROM {ent} WHERE cell_type IN ('TAM','T')),
 kk AS (SELECT {by}, side, count(*) FILTER (pos) AS k FROM mem GROUP BY ALL),
 pk AS (SELECT m.*, d.draw FROM mem m CROSS JOIN (SELECT CAST(range AS INT) AS draw FROM range({n})) d JOIN kk USING ({by}, side)
   QUALIFY row_number() OVER (PARTITION BY {by}, side, draw ORDER BY {hx("'9'", 'draw', 'side', 'entity_id')}, entity_id) <= k)"""


@query("permutation_null", f"""WITH {perm_sql(20, N_DRAWS)}, e AS (SELECT a.sample, a.draw, count(*) AS n FROM pk a JOIN pk b ON a.sample=b.sample AND a.draw=b.draw AND a.side='L' AND b.side='R' AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 400 GROUP BY 1,2)
SELECT sample, CAST(20 AS DOUBLE) AS radius, draw, coalesce(n,0) AS n_mixed_edges FROM (SELECT DISTINCT sample FROM mem) CROSS JOIN (SELECT CAST(range AS INT) AS draw FROM range({N_DRAWS})) LEFT JOIN e USING (sample, draw)""", "ent")
def _(spark, sf):
    return Z.permutation_null(V.entities(spark, sf), AXIS, 20.0, N_DRAWS, 9, "sample")


@query("permutation_null_topology")
def _(spark, sf):
    return r(Z.permutation_null(V.entities(spark, sf), AXIS, 20.0, 3, 9, "sample", full=True), 6, "frac_in_mixed")


OBS_SQL = f"{NODES_SQL}, obs AS (SELECT a.sample, count(*) AS n FROM nodes a JOIN nodes b ON a.sample=b.sample AND a.is_lig AND NOT b.is_lig AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 400 GROUP BY 1)"
STAT = """count(*) AS n_draws, round((1+count(*) FILTER (d.n>=o.n))/CAST(1+count(*) AS DOUBLE),6) AS p, round(avg(d.n),6) AS null_mean, round(stddev_pop(d.n),6) AS null_sd, round(quantile_cont(CAST(d.n AS DOUBLE),0.025),6) AS q0, round(quantile_cont(CAST(d.n AS DOUBLE),0.25),6) AS q1, round(quantile_cont(CAST(d.n AS DOUBLE),0.75),6) AS q2, round(quantile_cont(CAST(d.n AS DOUBLE),0.975),6) AS q3"""


@query("perm_pvalue", f"""WITH {OBS_SQL}, {perm_sql(20, N_DRAWS)}, e AS (SELECT a.sample, a.draw, count(*) AS n FROM pk a JOIN pk b ON a.sample=b.sample AND a.draw=b.draw AND a.side='L' AND b.side='R' AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 400 GROUP BY 1,2),
 d AS (SELECT sample, draw, coalesce(n,0) AS n FROM (SELECT DISTINCT sample FROM mem) CROSS JOIN (SELECT CAST(range AS INT) AS draw FROM range({N_DRAWS})) LEFT JOIN e USING (sample, draw))
SELECT sample, CAST(any_value(o.n) AS DOUBLE) AS observed, {STAT}, round(any_value(o.n)/avg(d.n),6) AS enrich FROM d JOIN obs o USING (sample) GROUP BY 1""".replace("AS q0", "AS null_q025").replace("AS q1", "AS null_q25").replace("AS q2", "AS null_q75").replace("AS q3", "AS null_q975"), "ent")
def _(spark, sf):
    e = V.entities(spark, sf)
    obs = Z.observed_mixed(e, AXIS, [20.0], "sample")
    return r(Z.perm_pvalue(obs, Z.permutation_null(e, AXIS, 20.0, N_DRAWS, 9, "sample"), "sample"), 6, "p", "null_mean", "null_sd", "enrich", *QS)


FLOOR_SQL = """fl AS (SELECT sample, quantile_cont(confidence,0.0) AS f0, quantile_cont(confidence,0.5) AS f5 FROM ent WHERE cell_type IN ('TAM','T') GROUP BY 1),
 fe AS (SELECT ent.*, CAST(0.0 AS DOUBLE) AS conf_q FROM ent JOIN fl USING (sample) WHERE confidence>=f0 UNION ALL SELECT ent.*, CAST(0.5 AS DOUBLE) FROM ent JOIN fl USING (sample) WHERE confidence>=f5)"""


@query("radius_sensitivity", f"""WITH {FLOOR_SQL}, rad AS (SELECT CAST(v AS DOUBLE) AS radius FROM (VALUES (10),(20)) t(v)), {perm_sql(20, 10, 'fe', 'sample, conf_q')},
 nd AS (SELECT * FROM fe WHERE (cell_type='TAM' AND lig>0) OR (cell_type='T' AND rec>0)),
 base AS (SELECT sample, conf_q, count(*) FILTER (cell_type='TAM') AS n_lig, count(*) FILTER (cell_type='T') AS n_rec FROM nd GROUP BY 1,2),
 ob AS (SELECT a.sample, a.conf_q, radius, count(*) AS n FROM nd a JOIN nd b ON a.sample=b.sample AND a.conf_q=b.conf_q AND a.cell_type='TAM' AND b.cell_type='T' JOIN rad ON (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= radius*radius GROUP BY 1,2,3),
 e AS (SELECT a.sample, a.conf_q, radius, a.draw, count(*) AS n FROM pk a JOIN pk b ON a.sample=b.sample AND a.conf_q=b.conf_q AND a.draw=b.draw AND a.side='L' AND b.side='R' JOIN rad ON (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= radius*radius GROUP BY 1,2,3,4),
 d AS (SELECT sample, conf_q, radius, draw, coalesce(n,0) AS n FROM (SELECT DISTINCT sample, conf_q FROM mem) CROSS JOIN rad CROSS JOIN (SELECT CAST(range AS INT) AS draw FROM range(10)) LEFT JOIN e USING (sample, conf_q, radius, draw)),
 o AS (SELECT sample, conf_q, radius, n_lig, n_rec, coalesce(n,0) AS n FROM base CROSS JOIN rad LEFT JOIN ob USING (sample, conf_q, radius))
SELECT sample, conf_q, radius, n_lig, n_rec, o.n AS n_mixed_edges, {STAT}, CASE WHEN avg(d.n)>0 THEN round(o.n/avg(d.n),6) END AS enrich FROM d JOIN o USING (sample, conf_q, radius) GROUP BY sample, conf_q, radius, n_lig, n_rec, o.n""".replace("AS q0", "AS null_q025").replace("AS q1", "AS null_q25").replace("AS q2", "AS null_q75").replace("AS q3", "AS null_q975"), "ent")
def _(spark, sf):
    t = Z.radius_sensitivity(V.entities(spark, sf), AXIS, [10.0, 20.0], [0.0, 0.5], 10, 9, "sample")
    return r(t, 6, "p", "null_mean", "null_sd", "enrich", *QS)


# --- bootstrap ---------------------------------------------------------------------------------------

BOOT_SQL = f"""ix AS (SELECT sample, confidence AS v, row_number() OVER (PARTITION BY sample ORDER BY {hx("'4'", 'entity_id')}, entity_id) - 1 AS i, count(*) OVER (PARTITION BY sample) AS n FROM ent),
 pos AS MATERIALIZED (SELECT sample, rep, {hint("'4'", 'rep', 'sample', 'i')} % n AS i FROM ix CROSS JOIN (SELECT CAST(range AS INT) AS rep FROM range(20))),
 bs AS (SELECT sample, rep, v FROM pos JOIN ix USING (sample, i)),
 st AS (SELECT sample, rep, avg(v) AS mean, quantile_cont(v,0.5) AS median FROM bs GROUP BY 1,2)"""


@query("bootstrap_ci", f"""WITH {BOOT_SQL}, s AS (SELECT sample, 'mean' AS stat, mean AS v FROM st UNION ALL SELECT sample, 'median', median FROM st)
SELECT sample, stat, n, 20 AS n_draws, round(quantile_cont(v,0.025)+1e-8,6) AS ci_lo, round(quantile_cont(v,0.975)+1e-8,6) AS ci_hi FROM s JOIN (SELECT sample, count(*) AS n FROM ent GROUP BY 1) USING (sample) GROUP BY 1,2,3""", "ent")
def _(spark, sf):
    from .queries_summaries import settle
    e = V.entities(spark, sf)
    return settle(Z.bootstrap_ci(e, "sample", "confidence", ["mean", "median"], 20, 4, "entity_id"), 6, "ci_lo", "ci_hi")


# --- audits ------------------------------------------------------------------------------------------

@query("lineage_identity", f"""WITH {RATE_SQL}, t AS (SELECT *, CAST(floor(log10(greatest(n_tx,1))*10) AS BIGINT) AS bin FROM rated), cs0 AS (SELECT * FROM t WHERE cell_type='BUILDING' AND m2_k>=8), ot AS (SELECT * FROM t WHERE cell_type<>'BUILDING'), sn AS (SELECT * FROM t WHERE cell_type='BUILDING' AND m2_k<8),
 ok AS (SELECT sample FROM cs0 GROUP BY 1 HAVING count(*)>=5), cs AS (SELECT cs0.*, row_number() OVER (PARTITION BY sample, bin ORDER BY {hx("'2'", 'entity_id')}, entity_id) AS rk FROM cs0 WHERE sample IN (SELECT sample FROM ok)),
 o2 AS (SELECT *, row_number() OVER (PARTITION BY sample, bin ORDER BY {hx("'2'", 'entity_id')}, entity_id) AS pos FROM ot), s2 AS (SELECT *, row_number() OVER (PARTITION BY sample, bin ORDER BY {hx("'2'", 'entity_id')}, entity_id) AS pos FROM sn),
 lim AS (SELECT sample, bin, count(*)*5 AS m FROM cs GROUP BY 1,2),
 g AS (SELECT sample, n_tx, m1_k AS k, m1_rate AS rate, 'case' AS grp FROM cs UNION ALL SELECT o2.sample, n_tx, m1_k, m1_rate, 'matched' FROM o2 JOIN lim USING (sample, bin) WHERE pos<=m
  UNION ALL SELECT sample, n_tx, m1_k, m1_rate, 'raw' FROM ot WHERE sample IN (SELECT sample FROM ok) UNION ALL SELECT s2.sample, n_tx, m1_k, m1_rate, 'state' FROM s2 JOIN lim USING (sample, bin) WHERE pos<=m),
 x AS (SELECT *, CASE WHEN k>0 THEN 1.0 ELSE 0.0 END AS pos, CASE WHEN k<=0 OR n_tx<20 THEN 0.0 WHEN n_tx-k<20 THEN 1.0 ELSE 1-exp(lgamma(n_tx-k+1)-lgamma(greatest(n_tx-k-20+1,1))-(lgamma(n_tx+1)-lgamma(greatest(n_tx-20+1,1)))) END AS rare FROM g),
 w AS (SELECT sample, """ + ", ".join(f"count(*) FILTER (grp='{g}') AS {g}_n, CAST(avg(pos) FILTER (grp='{g}') AS DOUBLE) AS {g}_pos, avg(rate) FILTER (grp='{g}') AS {g}_rate, avg(rare) FILTER (grp='{g}') AS {g}_rare, quantile_cont(CAST(n_tx AS DOUBLE),0.5) FILTER (grp='{g}') AS {g}_med_tx" for g in ("case", "matched", "raw", "state")) + """ FROM x GROUP BY 1)
SELECT sample, """ + ", ".join(f"{g}_n, round({g}_pos,6) AS {g}_pos, round({g}_rate,6) AS {g}_rate, round({g}_rare,6) AS {g}_rare, {g}_med_tx" for g in ("case", "matched", "raw", "state")) + ", round(case_pos/raw_pos,6) AS ratio_raw, round(case_pos/matched_pos,6) AS ratio_depthmatched, round(case_rare/matched_rare,6) AS ratio_rarefied, round(case_pos/state_pos,6) AS ratio_vs_state FROM w", "mol")
def _(spark, sf):
    b = F.col("cell_type") == "BUILDING"
    t = Z.lineage_identity(rates(spark, sf), b & (F.col("m2_k") >= 8), ~b, b & (F.col("m2_k") < 8), "sample", "m1", seed=2, rounds=0, bins_per_decade=10)
    return r(t, 6, *[f"{g}_{v}" for g in ("case", "matched", "raw", "state") for v in ("pos", "rate", "rare")], "ratio_raw", "ratio_depthmatched", "ratio_rarefied", "ratio_vs_state")


PROX_SQL = """nn AS (SELECT s.sample, s.entity_id, any_value(s.cell_type) AS cell_type, any_value(s.lig) AS lig, sqrt(min((s.x-t.x)*(s.x-t.x)+(s.y-t.y)*(s.y-t.y))) AS dist FROM ent s JOIN ent t ON s.sample=t.sample AND t.cell_type='T' GROUP BY 1,2)"""


@query("proximity_audit", f"""WITH {PROX_SQL}, g AS (SELECT sample, entity_id, dist, 'all' AS g FROM nn UNION ALL SELECT sample, entity_id, dist, 'case' FROM nn WHERE cell_type='TAM' AND lig>0 UNION ALL SELECT sample, entity_id, dist, 'control' FROM nn WHERE cell_type='TAM' AND lig=0),
 m AS (SELECT sample, count(*) FILTER (g='case') AS n_case, count(*) FILTER (g='control') AS n_control, quantile_cont(dist,0.5) FILTER (g='case') AS a, quantile_cont(dist,0.5) FILTER (g='all') AS b, quantile_cont(dist,0.5) FILTER (g='control') AS c FROM g GROUP BY 1),
 ix AS (SELECT sample, g, dist AS v, row_number() OVER (PARTITION BY sample, g ORDER BY {hx("'6'", 'entity_id')}, entity_id) - 1 AS i, count(*) OVER (PARTITION BY sample, g) AS n FROM g),
 pos AS MATERIALIZED (SELECT sample, g, rep, {hint("'6'", 'rep', 'sample', 'g', 'i')} % n AS i FROM ix CROSS JOIN (SELECT CAST(range AS INT) AS rep FROM range(10))),
 st AS (SELECT sample, g, rep, quantile_cont(v,0.5) AS s FROM pos JOIN ix USING (sample, g, i) GROUP BY 1,2,3),
 rt AS (SELECT x.sample, quantile_cont(x.s/y.s,0.025) AS adj_lo, quantile_cont(x.s/y.s,0.975) AS adj_hi, quantile_cont(x.s/z.s,0.025) AS cc_lo, quantile_cont(x.s/z.s,0.975) AS cc_hi FROM st x JOIN st y ON x.sample=y.sample AND x.rep=y.rep AND x.g='case' AND y.g='all' JOIN st z ON x.sample=z.sample AND x.rep=z.rep AND z.g='control' GROUP BY 1),
 u AS (SELECT sample, 2.0*(sum(rk) FILTER (lig>0) - count(*) FILTER (lig>0)*(count(*) FILTER (lig>0)+1)/2.0)/(count(*) FILTER (lig>0)*count(*) FILTER (lig=0)) - 1 AS rb FROM (SELECT sample, lig, avg(rn) OVER (PARTITION BY sample, dist) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY dist) AS rn FROM nn WHERE cell_type='TAM')) GROUP BY 1)
SELECT sample, n_case, n_control, round(a,6) AS med_raw, round(b,6) AS med_background, round(c,6) AS med_control, round(adj_lo,6) AS adj_lo, round(adj_hi,6) AS adj_hi, round(cc_lo,6) AS cc_lo, round(cc_hi,6) AS cc_hi, round(rb,6) AS rank_biserial, round(a/b,6) AS adjusted, round(a/c,6) AS case_ctrl
FROM m JOIN rt USING (sample) JOIN u USING (sample)""", "ent")
def _(spark, sf):
    tam = F.col("cell_type") == "TAM"
    t = Z.proximity_audit(V.entities(spark, sf), F.col("cell_type") == "T", tam & (F.col("lig") > 0), tam & (F.col("lig") == 0), "sample", n=10, seed=6)
    cols = ["med_raw", "med_background", "med_control", "adj_lo", "adj_hi", "cc_lo", "cc_hi", "rank_biserial", "adjusted", "case_ctrl"]
    return r(t.drop("p_case_closer"), 6, *cols)
