"""Checked queries: neighbour joins, radius graphs and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import entities as E, graph as R, spatial as S
from . import views as V
from .queries_summaries import r, settle
from .registry import query

AXIS = ("lig", "TAM", "rec", "T")
SRC_SQL = "src AS (SELECT * FROM ent WHERE cell_type='TAM' AND lig>0), tgt AS (SELECT * FROM ent WHERE cell_type='T' AND rec>0)"
NODES_SQL = "nodes AS (SELECT entity_id, sample, etype, x, y, cell_type='TAM' AS is_lig FROM ent WHERE (cell_type='TAM' AND lig>0) OR (cell_type='T' AND rec>0))"


def pairs_sql(rr):
    return f"pairs AS (SELECT a.sample, a.entity_id AS a, b.entity_id AS b, a.is_lig AS al, b.is_lig AS bl, a.etype AS ae, b.etype AS be, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS dist FROM nodes a JOIN nodes b ON a.sample=b.sample AND a.entity_id<b.entity_id AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= {rr*rr})"


# component label by recursion over node pairs
COMP_SQL = """reach AS (SELECT entity_id AS n, entity_id AS m FROM nodes UNION
  SELECT r.n, CASE WHEN p.a = r.m THEN p.b ELSE p.a END FROM reach r JOIN pairs p ON p.a = r.m OR p.b = r.m),
 comp AS (SELECT n AS entity_id, min(m) AS component FROM reach GROUP BY 1)"""


def sides(spark, sf):
    e = V.entities(spark, sf)
    return E.population(e, "TAM", "lig"), E.population(e, "T", "rec")


def nodes(spark, sf):
    return R.axis_nodes(V.entities(spark, sf), AXIS).select("entity_id", "sample", "etype", "x", "y", "is_lig")


NEAR_SQL = """ranked AS (SELECT s.entity_id, s.sample, t.entity_id AS nearest_id, t.cell_type, sqrt((s.x-t.x)*(s.x-t.x)+(s.y-t.y)*(s.y-t.y)) AS dist,
  row_number() OVER (PARTITION BY s.sample, s.entity_id ORDER BY (s.x-t.x)*(s.x-t.x)+(s.y-t.y)*(s.y-t.y), t.entity_id) AS rn
  FROM src s JOIN tgt t ON s.sample = t.sample {extra})"""


@query("nearest", f"WITH {SRC_SQL}, {NEAR_SQL.format(extra='')} SELECT sample, entity_id, nearest_id, round(dist, 6) AS dist FROM ranked WHERE rn = 1", "ent")
def _(spark, sf):
    a, b = sides(spark, sf)
    return r(S.nearest(a, b, "sample"), 6, "dist")


OTHER_SQL = "src AS (SELECT * FROM ent), tgt AS (SELECT * FROM ent WHERE etype='cell')"


@query("nearest_other", f"WITH {OTHER_SQL}, {NEAR_SQL.format(extra='AND s.entity_id <> t.entity_id')} SELECT sample, entity_id, nearest_id, cell_type, round(dist, 6) AS dist FROM ranked WHERE rn = 1", "ent")
def _(spark, sf):
    e = V.entities(spark, sf)
    return r(S.nearest_other(e, e.where("etype = 'cell'"), "sample", "cell_type"), 6, "dist")


@query("nearest_within", f"WITH {SRC_SQL}, {NEAR_SQL.format(extra='')} SELECT sample, entity_id, nearest_id, round(dist, 6) AS dist FROM ranked WHERE rn = 1 AND dist < 25", "ent")
def _(spark, sf):
    a, b = sides(spark, sf)
    return r(S.nearest_within(a, b, "sample", 25.0), 6, "dist")


@query("radius_pairs", """SELECT a.sample, a.entity_id AS a, b.entity_id AS b, round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)), 6) AS dist FROM ent a JOIN ent b
  ON a.sample=b.sample AND a.entity_id<b.entity_id AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 25""", "ent")
def _(spark, sf):
    return r(S.radius_pairs(V.entities(spark, sf), 5.0, "sample"), 6, "dist")


@query("radius_join", f"""WITH {SRC_SQL} SELECT s.sample, CAST(floor(s.x/100) AS BIGINT) AS tx, CAST(floor(s.y/100) AS BIGINT) AS ty, count(*) AS n_pairs FROM src s JOIN tgt t
  ON s.sample=t.sample AND (s.x-t.x)*(s.x-t.x)+(s.y-t.y)*(s.y-t.y) <= 400 GROUP BY 1,2,3""", "ent")
def _(spark, sf):
    a, b = sides(spark, sf)
    return S.radius_join(a, b, 20.0, "sample", tile=100.0)


@query("niche_metric", f"""WITH {SRC_SQL}, {NEAR_SQL.format(extra='')} SELECT n.*, m, round(pct, 6) AS pct_within, round(m, 6) AS median_dist FROM
 (SELECT sample, count(*) AS n_source FROM src GROUP BY 1) n JOIN (SELECT sample, count(*) AS n_target FROM tgt GROUP BY 1) USING (sample) LEFT JOIN (SELECT sample, 100*avg(CASE WHEN dist<=20 THEN 1.0 ELSE 0 END) AS pct, quantile_cont(dist,0.5) AS m FROM ranked WHERE rn=1 GROUP BY 1) USING (sample)""".replace("n.*, m, ", "n.sample, n.n_source, n_target, "), "ent")
def _(spark, sf):
    a, b = sides(spark, sf)
    return r(S.niche_metric(a, b, "sample"), 6, "pct_within", "median_dist")


WIN_SQL = """ext AS (SELECT sample, min(x) AS xl, max(x) AS xh, min(y) AS yl, max(y) AS yh FROM ent GROUP BY 1),
 win AS (SELECT e.sample, wx, wy, count(*) AS n, count(*) FILTER (cell_type IN ('T','TAM','B')) AS n_imm, any_value(xl + wx*110.0) AS x0, any_value(yl + wy*110.0) AS y0
  FROM ent e JOIN ext USING (sample), range(60) a(wx), range(60) b(wy)
  WHERE x >= xl+wx*110.0 AND x < xl+wx*110.0+220 AND y >= yl+wy*110.0 AND y < yl+wy*110.0+220 AND xl+wx*110.0 < xh-220 AND yl+wy*110.0 < yh-220 GROUP BY 1,2,3)"""


def windows(spark, sf):
    w = S.window_join(V.entities(spark, sf), 220.0, 110.0, "sample", keep="cell_type")
    return w.groupBy("sample", "wx", "wy", "x0", "y0").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("cell_type").isin("T", "TAM", "B")).alias("n_imm"))


@query("window_join", f"WITH {WIN_SQL} SELECT sample, wx, wy, x0, y0, n, n_imm FROM win", "ent")
def _(spark, sf):
    return windows(spark, sf)


@query("pick_region", f"""WITH {WIN_SQL} SELECT sample, wx, wy, n, n_imm, LEAST(n_imm, 40) + 0.05*LEAST(n, 300) AS score FROM win WHERE n >= 30
 QUALIFY row_number() OVER (PARTITION BY sample ORDER BY LEAST(n_imm, 40) + 0.05*LEAST(n, 300) DESC, wx, wy) = 1""".replace("+ 0.05*LEAST(n, 300) AS score", "+ CAST(0.05 AS DOUBLE)*LEAST(n, 300) AS score").replace("40) + 0.05*LEAST(n, 300) DESC", "40) + CAST(0.05 AS DOUBLE)*LEAST(n, 300) DESC"), "ent")
def _(spark, sf):
    score = F.least("n_imm", F.lit(40)) + F.lit(0.05) * F.least("n", F.lit(300))
    return S.pick_region(windows(spark, sf), "sample", score, F.col("n") >= 30).select("sample", "wx", "wy", "n", "n_imm", "score")


@query("region_extract", f"""WITH {WIN_SQL}, top AS (SELECT * FROM win QUALIFY row_number() OVER (PARTITION BY sample ORDER BY n DESC, wx, wy) <= 2)
 SELECT e.sample, wx*1000 + wy AS region, entity_id, round(x - x0, 6) AS local_x, round(y - y0, 6) AS local_y FROM ent e JOIN top t ON e.sample = t.sample AND x >= x0 AND x < x0+220 AND y >= y0 AND y < y0+220""", "ent")
def _(spark, sf):
    from ..operators.windows import top_n_per_group
    top = top_n_per_group(windows(spark, sf), "sample", [F.desc("n"), "wx", "wy"], 2)
    top = top.select("sample", (F.col("wx") * 1000 + F.col("wy")).alias("region"), "x0", "y0")
    out = S.region_extract(V.entities(spark, sf), top, 220.0, "sample")
    return r(out, 6, "local_x", "local_y").select("sample", "region", "entity_id", "local_x", "local_y")


# --- graphs ------------------------------------------------------------------------------------------

@query("connected_components", f"WITH {NODES_SQL}, {pairs_sql(20)}, {COMP_SQL} SELECT sample, entity_id, component FROM comp JOIN nodes USING (entity_id)", "ent")
def _(spark, sf):
    n = nodes(spark, sf)
    p = S.radius_pairs(n, 20.0, "sample")
    return R.connected_components(p, n, "sample", "entity_id", "a", "b")


TOPO_SQL = """cs AS (SELECT n.sample, component, count(*) AS size, bool_or(is_lig) AND bool_or(NOT is_lig) AS mixed FROM comp JOIN nodes n USING (entity_id) GROUP BY 1,2),
 base AS (SELECT sample, count(*) FILTER (is_lig) AS n_lig, count(*) FILTER (NOT is_lig) AS n_rec, count(*) AS n_nodes FROM nodes GROUP BY 1),
 ed AS (SELECT sample, count(*) AS n_edges, count(*) FILTER (al <> bl) AS n_mixed_edges FROM pairs GROUP BY 1),
 topo AS (SELECT b.sample, n_lig, n_rec, n_nodes, coalesce(n_edges,0) AS n_edges, coalesce(n_mixed_edges,0) AS n_mixed_edges, count(*) AS n_comp, count(*) FILTER (mixed) AS n_mixed_comp,
   round(coalesce(sum(size) FILTER (mixed),0)/CAST(sum(size) AS DOUBLE),6) AS frac_in_mixed, coalesce(max(size) FILTER (mixed),0) AS largest_mixed, max(size) AS largest_comp
   FROM base b JOIN cs USING (sample) LEFT JOIN ed USING (sample) GROUP BY ALL)"""


@query("graph_topology", f"WITH {NODES_SQL}, {pairs_sql(20)}, {COMP_SQL}, {TOPO_SQL} SELECT sample, n_lig, n_rec, CASE WHEN sparse THEN 'too_sparse' ELSE 'ok' END AS status, " + ", ".join(f"CASE WHEN NOT sparse THEN {c} END AS {c}" for c in ("n_nodes", "n_edges", "n_mixed_edges", "n_comp", "n_mixed_comp", "frac_in_mixed", "largest_mixed", "largest_comp")) + " FROM (SELECT *, n_lig < 5 OR n_rec < 5 AS sparse FROM topo)", "ent")
def _(spark, sf):
    return r(R.graph_topology(nodes(spark, sf), 20.0, "sample"), 6, "frac_in_mixed")


@query("contribution_split", f"""WITH {NODES_SQL}, {pairs_sql(20)} SELECT n.*, coalesce(m,0) AS n_mixed_edges, coalesce(p,0) AS mixed_edges_with_partial, round(p/CAST(m AS DOUBLE),6) AS frac_mixed_needing_partial FROM
 (SELECT sample, count(*) FILTER (is_lig AND etype='cell') AS lig_whole, count(*) FILTER (is_lig AND etype='partial') AS lig_partial, count(*) FILTER (NOT is_lig AND etype='cell') AS rec_whole, count(*) FILTER (NOT is_lig AND etype='partial') AS rec_partial FROM nodes GROUP BY 1) n
 LEFT JOIN (SELECT sample, count(*) AS m, count(*) FILTER (ae='partial' OR be='partial') AS p FROM pairs WHERE al<>bl GROUP BY 1) USING (sample)""", "ent")
def _(spark, sf):
    return r(R.contribution_split(V.entities(spark, sf), AXIS, 20.0, "sample"), 6, "frac_mixed_needing_partial")


@query("largest_domain", f"""WITH {NODES_SQL}, {pairs_sql(20)}, {COMP_SQL} SELECT sample, size, n_lig, n_rec, round(cx,6) AS cx, round(cy,6) AS cy, component AS first_id FROM (
 SELECT n.sample, component, count(*) AS size, count(*) FILTER (is_lig) AS n_lig, count(*) FILTER (NOT is_lig) AS n_rec, avg(x) AS cx, avg(y) AS cy FROM comp JOIN nodes n USING (entity_id) GROUP BY 1,2)
 WHERE n_lig>0 AND n_rec>0 QUALIFY row_number() OVER (PARTITION BY sample ORDER BY size DESC, component) = 1""", "ent")
def _(spark, sf):
    return r(R.largest_domain(nodes(spark, sf), 20.0, "sample"), 6, "cx", "cy")


# --- shapes ------------------------------------------------------------------------------------------

@query("convex_footprint")
def _(spark, sf):
    return S.polygon_area(S.convex_footprint(V.molecules(spark, sf).select("entity_id", "x", "y")))


@query("entity_diagnostics", """WITH d AS (SELECT entity_id, x, y, qv AS z, count(*) AS m FROM mol GROUP BY 1,2,3,4),
 g AS (SELECT entity_id, CAST(sum(m) AS BIGINT) AS n, count(*) AS k, sum(m*x)/sum(m) AS cx, sum(m*y)/sum(m) AS cy, sum(m*z)/sum(m) AS cz,
   covar_pop(x,x) xx, covar_pop(y,y) yy, covar_pop(z,z) zz, covar_pop(x,y) xy, covar_pop(x,z) xz, covar_pop(y,z) yz FROM d GROUP BY 1),
 f AS (SELECT *, NOT (k >= 6 AND xx*(yy*zz-yz*yz) - xy*(xy*zz-yz*xz) + xz*(xy*yz-yy*xz) > 1e-9*xx*yy*zz) AS fallback FROM g WHERE n >= 3)
SELECT sample, entity_id, n AS n_transcripts, round(cx + 1e-8,6) AS centroid_x, round(cy + 1e-8,6) AS centroid_y, round(cz + 1e-8,6) AS centroid_z, fallback, NOT fallback OR n >= 5 AS rendered,
  row_number() OVER (PARTITION BY sample ORDER BY cy DESC, entity_id) - 1 AS rank_3d FROM f JOIN (SELECT DISTINCT entity_id, sample FROM mol) USING (entity_id)""", "mol")
def _(spark, sf):
    m = V.molecules(spark, sf).withColumn("z", F.col("qv"))
    lab = m.select("entity_id", "sample").distinct()
    return settle(S.entity_diagnostics(m, lab), 6, "centroid_x", "centroid_y", "centroid_z")
