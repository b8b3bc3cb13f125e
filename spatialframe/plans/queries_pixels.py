"""Checked queries: channels, footprints, masks and windows on the 50 x 50 grid."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions.durable import durable, fresh_path
from ..operators import pixels as X, resample as Z
from ..sources.sinks import write_table_bucketed
from . import views as V
from .queries_resample import hint, hx
from .queries_summaries import r, settle
from .registry import query

G = V.GRID
SHIFTS = X.shift_table(6, 8, G, G, 7)
SHIFT_SQL = "sh AS (SELECT * FROM (VALUES " + ",".join(f"({i},{dy},{dx})" for i, dy, dx in SHIFTS) + ") v(shift, dy, dx))"
CANON = {"BUILDING": "A", "MACHINERY": "N", "FURNITURE": "R"}
CANON_SQL = "canon AS (SELECT * FROM (VALUES ('BUILDING','A',0),('MACHINERY','N',1),('FURNITURE','R',2)) v(cell_type, marker, code))"


def grid(spark, sf):
    return V.pixels(spark, sf).select("row", "col").distinct()


def dist(spark, sf):
    return X.mask_distance(grid(spark, sf), V.mask(spark, sf))


def calibrated(spark, sf):
    """Distance raster and thresholds, each written once and shared by all that follows."""
    d = durable(dist(spark, sf))
    return d, durable(X.calibrate_threshold(V.pixels(spark, sf), d.where("dist > 3")))


THR_SQL = """bg AS (SELECT px.* FROM px JOIN dist USING (row, col) WHERE dist > 3 AND value > 0),
 ped AS (SELECT marker, value AS pedestal FROM (SELECT marker, value, count(*) AS c FROM bg GROUP BY 1,2) QUALIFY row_number() OVER (PARTITION BY marker ORDER BY c DESC, value)=1),
 ex AS (SELECT marker, pedestal, CAST(greatest(value-pedestal,0) AS DOUBLE) AS s FROM bg JOIN ped USING (marker)),
 t0 AS (SELECT marker, any_value(pedestal) AS pedestal, quantile_cont(s,0.95) AS q95, quantile_cont(s,0.99) AS q99, quantile_cont(s,0.999) AS q999, greatest(quantile_cont(s,0.99),1.0) AS thr, count(*) AS n_background FROM ex GROUP BY 1),
 thr AS (SELECT t0.*, b AS background_pos FROM t0 JOIN (SELECT ex.marker, avg(CASE WHEN s>thr THEN 1.0 ELSE 0.0 END) AS b FROM ex JOIN t0 USING (marker) GROUP BY 1) USING (marker))"""
STAT_SQL = THR_SQL + """, stats AS (SELECT entity_id, cell_type, entity_class, marker, count(*) AS n_px, avg(v) AS int, avg(p) AS pos, avg(p) FILTER (dist>2) AS pos_far, avg(p) FILTER (dist<=2) AS pos_near FROM (
  SELECT f.entity_id, f.cell_type, f.entity_class, px.marker, dist, CAST(greatest(value-pedestal,0) AS DOUBLE) AS v, CASE WHEN greatest(value-pedestal,0)>thr THEN 1.0::DOUBLE ELSE 0.0 END AS p
  FROM (SELECT *, CASE WHEN sample<=2 THEN 'cell' ELSE 'partial' END AS entity_class FROM foot) f JOIN dist USING (row, col) JOIN px USING (row, col) JOIN thr USING (marker)) GROUP BY 1,2,3,4)"""


def classed(spark, sf):
    return V.footprints(spark, sf).withColumn("entity_class", F.when(F.col("sample") <= 2, "cell").otherwise("partial"))


def stats(spark, sf, ready=None):
    d, thr = ready or calibrated(spark, sf)
    return durable(X.channel_stats(classed(spark, sf), V.pixels(spark, sf), thr, d, keep=["cell_type", "entity_class"]))


@query("mask_distance", "SELECT row, col, round(dist,6) AS dist FROM dist", "dist")
def _(spark, sf):
    return r(dist(spark, sf), 6, "dist")


@query("dilate", """WITH one AS (SELECT DISTINCT row+i AS row, col+j AS col FROM mask, (VALUES (0,0),(1,0),(-1,0),(0,1),(0,-1)) o(i,j))
SELECT DISTINCT row+i AS row, col+j AS col FROM one, (VALUES (0,0),(1,0),(-1,0),(0,1),(0,-1)) o(i,j)""", "mask")
def _(spark, sf):
    return X.dilate(V.mask(spark, sf), 2)


@query("footprint_stats", """SELECT entity_id, count(*) AS n_px, count(*) FILTER (dist>2) AS n_px_far, round(avg(CASE WHEN dist>2 THEN 1.0 ELSE 0 END)+1e-8,6) AS frac_px_far, round(avg(dist),6) AS dist_mean, round(max(dist),6) AS dist_max
 FROM foot LEFT JOIN dist USING (row, col) GROUP BY 1""", ("foot", "dist"))
def _(spark, sf):
    return settle(r(X.footprint_stats(V.footprints(spark, sf), dist(spark, sf)), 6, "dist_mean", "dist_max"), 6, "frac_px_far")


@query("pixel_join", "SELECT entity_id, row, col, marker, value FROM foot JOIN px USING (row, col)", ("foot", "px"))
def _(spark, sf):
    return X.pixel_join(V.footprints(spark, sf).select("entity_id", "row", "col"), V.pixels(spark, sf))


def bucketed(spark, df, head, buckets=8):
    """The frame as a stored table, bucketed by pixel."""
    path = fresh_path(spark, head)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    write_table_bucketed(df, name, buckets, "row", "col", path=path)
    return spark.table(name)


@query("pixel_join_bucketed", "SELECT entity_id, row, col, marker, value FROM foot JOIN px USING (row, col)", ("foot", "px"))
def _(spark, sf):
    foot = bucketed(spark, V.footprints(spark, sf).select("entity_id", "row", "col"), "foot")
    return X.pixel_join(foot, bucketed(spark, V.pixels(spark, sf), "px")).select("entity_id", "row", "col", "marker", "value")


@query("calibrate_threshold", f"WITH {THR_SQL} SELECT marker, pedestal, round(q95,6) AS q95, round(q99,6) AS q99, round(q999,6) AS q999, round(thr,6) AS thr, round(CAST(background_pos AS DOUBLE),6) AS background_pos, n_background FROM thr", "dist")
def _(spark, sf):
    return r(calibrated(spark, sf)[1], 6, "q95", "q99", "q999", "thr", "background_pos")


@query("channel_stats", f"""WITH {STAT_SQL} SELECT entity_id, cell_type, entity_class, marker, n_px, round(int+1e-8,6) AS int, round(pos+1e-8,6) AS pos, round(pos_far+1e-8,6) AS pos_far, round(pos_near+1e-8,6) AS pos_near FROM stats""", ("foot", "dist"))
def _(spark, sf):
    return settle(stats(spark, sf), 6, "int", "pos", "pos_far", "pos_near")


@query("channel_summary", """SELECT marker, max(value) AS max, max(row)-min(row)+1 AS height, max(col)-min(col)+1 AS width, count(*) AS n_px, round(quantile_cont(CAST(value AS DOUBLE),0.99),6) AS p99, CASE marker WHEN 'A' THEN 'mask' ELSE 'panel' END AS role FROM px GROUP BY 1""", "px")
def _(spark, sf):
    return r(X.channel_summary(V.pixels(spark, sf), {"A": "mask"}), 6, "p99")


CUTS = {"A": 50.0, "N": 50.0, "R": 50.0}
RES_SQL = """res AS (SELECT t.row, t.col, tissue, coalesce(tissue AND dist>2, false) AS residual FROM (SELECT row, col, count(*) FILTER (value > 50) >= 2 AS tissue FROM px GROUP BY 1,2) t LEFT JOIN dist USING (row, col))"""


def residual(spark, sf, d=None):
    return X.residual_mask(V.pixels(spark, sf), CUTS, dist(spark, sf) if d is None else d)


@query("residual_mask", f"WITH {RES_SQL} SELECT * FROM res", "dist")
def _(spark, sf):
    return residual(spark, sf)


@query("shift_join", f"""WITH {SHIFT_SQL}, ft AS (SELECT cell_type, row, col, count(*) AS n FROM foot GROUP BY 1,2,3)
SELECT cell_type, shift, CAST((row-1+dy)%50+1 AS INT) AS row, CAST((col-1+dx)%50+1 AS INT) AS col, n, marker, value FROM (SELECT cell_type, n, shift, (row-1+dy)%50+1 AS row, (col-1+dx)%50+1 AS col FROM ft CROSS JOIN sh) JOIN px USING (row, col)""".replace("CAST((row-1+dy)%50+1 AS INT) AS row, CAST((col-1+dx)%50+1 AS INT) AS col", "row, col"), ("foot", "px"))
def _(spark, sf):
    f = V.footprints(spark, sf).groupBy("cell_type", "row", "col").agg(F.count(F.lit(1)).alias("n"))
    return X.shift_join(f, V.pixels(spark, sf), SHIFTS, G, G)


NULL_SQL = f"""{SHIFT_SQL}, ft AS (SELECT cell_type, row, col, dist>2 AS far FROM foot JOIN dist USING (row, col)), den AS (SELECT cell_type, count(*) AS n, count(*) FILTER (far) AS nf FROM ft GROUP BY 1),
 pp AS (SELECT marker, row, col FROM px JOIN thr USING (marker) WHERE greatest(value-pedestal,0) > thr),
 hit AS (SELECT marker, shift, cell_type, count(*) AS p, count(*) FILTER (far) AS pf FROM ft CROSS JOIN sh JOIN pp ON pp.row=(ft.row-1+dy)%50+1 AND pp.col=(ft.col-1+dx)%50+1 GROUP BY 1,2,3),
 nul AS (SELECT marker, shift, cell_type, coalesce(p,0)/CAST(greatest(n,1) AS DOUBLE) AS pos_frac, coalesce(pf,0)/CAST(greatest(nf,1) AS DOUBLE) AS pos_frac_far FROM den CROSS JOIN (SELECT marker FROM thr) CROSS JOIN (SELECT shift FROM sh) LEFT JOIN hit USING (marker, shift, cell_type))"""


def null(spark, sf, ready=None):
    d, thr = ready or calibrated(spark, sf)
    return durable(X.toroidal_null(V.footprints(spark, sf), V.pixels(spark, sf), thr, d, SHIFTS, G, G))


@query("toroidal_null", f"WITH {THR_SQL}, {NULL_SQL} SELECT marker, shift, cell_type, round(pos_frac,9) AS pos_frac, round(pos_frac_far,9) AS pos_frac_far FROM nul", ("foot", "dist"))
def _(spark, sf):
    return r(null(spark, sf), 9, "pos_frac", "pos_frac_far")


NS_SQL = "ns AS (SELECT marker, cell_type, avg(pos_frac) AS nm, stddev_samp(pos_frac) AS nsd, avg(pos_frac_far) AS nmf, stddev_samp(pos_frac_far) AS nsdf FROM nul GROUP BY 1,2)"


@query("specificity_matrix", f"""WITH {STAT_SQL}, {NULL_SQL}, {NS_SQL}, g AS (SELECT entity_class, cell_type, marker, count(*) AS n, avg(pos) AS o, stddev_samp(pos)/sqrt(count(*)) AS se, avg(pos_far) AS ofar FROM stats WHERE n_px>=8 GROUP BY 1,2,3 HAVING count(*)>=30),
 e AS (SELECT g.*, nm, nsd, log2((o+1e-4)/(nm+1e-4)) AS le, (o-nm)/greatest(sqrt(se*se+nsd*nsd),1e-12) AS z, log2((ofar+1e-4)/(nmf+1e-4)) AS lef FROM g JOIN ns USING (marker, cell_type))
SELECT entity_class, cell_type, marker, n, round(o,6) AS obs, round(se,6) AS obs_se, round(nm,6) AS null_mean, round(nsd,6) AS null_sd, round(le,6) AS log2_enrich, round(z,5) AS z, round(lef,6) AS log2_enrich_far, round(le - quantile_cont(le,0.5) OVER (PARTITION BY entity_class, cell_type),6) AS rel_log2, coalesce((cell_type='BUILDING' AND marker='A') OR (cell_type='MACHINERY' AND marker='N') OR (cell_type='FURNITURE' AND marker='R'), false) AS is_canonical FROM e""", ("foot", "dist"))
def _(spark, sf):
    # p and q need a normal tail SQL lacks; they are tested on a fixture
    ready = calibrated(spark, sf)
    s = X.specificity_matrix(stats(spark, sf, ready), null(spark, sf, ready), canon=CANON)
    s = r(r(s, 6, "obs", "obs_se", "null_mean", "null_sd", "log2_enrich", "log2_enrich_far", "rel_log2"), 5, "z")
    return s.select("entity_class", "cell_type", "marker", "n", "obs", "obs_se", "null_mean", "null_sd", "log2_enrich", "z", "log2_enrich_far", "rel_log2", "is_canonical")


@query("marker_distribution", f"""WITH {STAT_SQL}, {NULL_SQL}, {NS_SQL}, ix AS (SELECT marker, entity_class, pos AS v, row_number() OVER (PARTITION BY marker, entity_class ORDER BY {hx("'0'", 'entity_id')}, entity_id)-1 AS i, count(*) OVER (PARTITION BY marker, entity_class) AS n FROM stats WHERE n_px>=8),
 ps AS MATERIALIZED (SELECT marker, entity_class, rep, {hint("'0'", 'rep', 'marker', 'entity_class', 'i')} % n AS i FROM ix CROSS JOIN (SELECT CAST(range AS INT) AS rep FROM range(10))),
 bm AS (SELECT marker, entity_class, rep, avg(v) AS m FROM ps JOIN ix USING (marker, entity_class, i) GROUP BY 1,2,3), ci AS (SELECT marker, entity_class, quantile_cont(m,0.025) AS lo, quantile_cont(m,0.975) AS hi FROM bm GROUP BY 1,2),
 np AS (SELECT marker, avg(nm) AS null_pos FROM ns GROUP BY 1)
SELECT s.marker, s.entity_class, count(*) AS n, round(avg(pos),6) AS mean_pos, round(quantile_cont(pos,0.5),6) AS median_pos, round(avg(int),6) AS mean_int, round(quantile_cont(int,0.5)+1e-8,6) AS median_int, round(lo,6) AS ci_lo, round(hi,6) AS ci_hi, round(null_pos,6) AS null_pos, pedestal, round(thr,6) AS thr, round(CAST(background_pos AS DOUBLE),6) AS background_pos, round(log2((avg(pos)+1e-4)/(null_pos+1e-4)),6) AS log2_enrich
 FROM stats s JOIN ci USING (marker, entity_class) JOIN np USING (marker) JOIN thr USING (marker) WHERE n_px>=8 GROUP BY s.marker, s.entity_class, lo, hi, null_pos, pedestal, thr, background_pos""", ("foot", "dist"))
def _(spark, sf):
    ready = calibrated(spark, sf)
    m = X.marker_distribution(stats(spark, sf, ready), null(spark, sf, ready), ready[1], n=10)
    return settle(r(m, 6, "mean_pos", "median_pos", "mean_int", "ci_lo", "ci_hi", "null_pos", "thr", "background_pos", "log2_enrich"), 6, "median_int")


NF_SQL = STAT_SQL + f""", {CANON_SQL}, nf AS (SELECT s.cell_type, s.marker, entity_class, count(*) AS n_paired, avg(pos_near) AS mw, avg(pos_far) AS mb, avg(pos_far-pos_near) AS md, count(*) FILTER (pos_far<>pos_near) AS n_discordant, count(*) FILTER (pos_far>pos_near) AS n_beyond_higher, quantile_cont(pos_far-pos_near,0.5) AS pm
 FROM stats s JOIN canon c ON c.cell_type=s.cell_type AND c.marker=s.marker WHERE n_px>=8 AND pos_near IS NOT NULL AND pos_far IS NOT NULL GROUP BY 1,2,3 HAVING count(*)>=10)"""


def nearfar(spark, sf):
    return X.near_far(stats(spark, sf), CANON, min_n=10)


@query("near_far", f"WITH {NF_SQL} SELECT cell_type, marker, entity_class, n_paired, round(mw,6) AS mean_within, round(mb,6) AS mean_beyond, round(md,6) AS mean_diff, n_discordant, n_beyond_higher, round(pm,6) AS paired_median_diff, round(mb/nullif(mw,0),6) AS retention FROM nf", ("foot", "dist"))
def _(spark, sf):
    return r(nearfar(spark, sf).drop("p_sign"), 6, "mean_within", "mean_beyond", "mean_diff", "paired_median_diff", "retention")


@query("near_far_retention", f"WITH {NF_SQL} SELECT cell_type, round(p,6) AS partial, round(c,6) AS cell, round(p-c,6) AS partial_minus_cell FROM (SELECT cell_type, max(mb/nullif(mw,0)) FILTER (entity_class='partial') AS p, max(mb/nullif(mw,0)) FILTER (entity_class='cell') AS c FROM nf GROUP BY 1)", ("foot", "dist"))
def _(spark, sf):
    return r(X.retention_table(nearfar(spark, sf)), 6, "partial", "cell", "partial_minus_cell")


CON_SQL = STAT_SQL + f""", {CANON_SQL}, rows_ AS (SELECT entity_id, s.cell_type, entity_class, any_value(c.code) AS code, [max(pos) FILTER (s.marker='A'), max(pos) FILTER (s.marker='N'), max(pos) FILTER (s.marker='R')] AS P, coalesce(sum(pos),0) AS tot, count(pos) AS k FROM stats s JOIN canon c ON c.cell_type=s.cell_type GROUP BY 1,2,3 HAVING count(pos)>=2)"""
at = lambda code: f"(P[{code}+1] - (tot - coalesce(P[{code}+1],0))/greatest(k-1,1))"


def rows(spark, sf):
    return Z.contrast_rows(stats(spark, sf), CANON, keep="entity_class")


@query("matched_contrast", f"WITH {CON_SQL} SELECT entity_id, cell_type, entity_class, code, CAST(k AS INT) AS k, round({at('code')}+1e-8,6) AS delta FROM rows_", ("foot", "dist"))
def _(spark, sf):
    return settle(Z.matched_contrast(stats(spark, sf), CANON, keep="entity_class"), 6, "delta")


other = lambda draw: f"CAST((code + 1 + {hint(chr(39) + '3' + chr(39), draw, 'entity_id')} % 2) % 3 AS INT)"


@query("identity_null", f"""WITH {CON_SQL}, lv AS (SELECT *, cell_type AS level FROM rows_ UNION ALL SELECT *, 'ALL' FROM rows_), s AS (SELECT *, {at('code')} AS d, {at('(code+1)%3')} AS sw FROM lv QUALIFY count(*) OVER (PARTITION BY entity_class, level) >= 30),
 o AS (SELECT entity_class, level, count(*) AS n, avg(d) AS md, avg(CASE WHEN d>0 THEN 1.0 ELSE 0 END) AS fp, quantile_cont(d,0.5) AS med, quantile_cont(sw,0.5) AS msw FROM s GROUP BY 1,2),
 x AS (SELECT entity_class, level, draw, {at(other('draw'))} AS v FROM s CROSS JOIN (SELECT CAST(range AS INT) AS draw FROM range(12))), dm AS (SELECT entity_class, level, draw, quantile_cont(v,0.5) AS m FROM x GROUP BY 1,2,3),
 nl AS (SELECT entity_class, level, quantile_cont(m,0.5) AS nm, stddev_samp(m) AS nsd, (count(*) FILTER (m>=med)+1)/13.0 AS p FROM dm JOIN o USING (entity_class, level) GROUP BY 1,2),
 pr AS (SELECT entity_class, level, d AS v, 1 AS own FROM s UNION ALL SELECT entity_class, level, {at(other("'-1'"))}, 0 FROM s),
 u AS (SELECT entity_class, level, 2.0*(sum(rk) FILTER (own=1) - count(*) FILTER (own=1)*(count(*) FILTER (own=1)+1)/2.0)/(count(*) FILTER (own=1)*count(*) FILTER (own=0))-1 AS cd FROM (SELECT *, avg(rn) OVER (PARTITION BY entity_class, level, v) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY entity_class, level ORDER BY v) AS rn FROM (SELECT entity_class, level, own, round(v,9) AS v FROM pr))) GROUP BY 1,2)
SELECT entity_class, level, n, round(md,6) AS mean_delta, round(fp,6) AS frac_positive_delta, round(med,6) AS median_delta, round(msw,6) AS median_delta_swapped_map, round(nm,6) AS null_median, round(nsd,6) AS null_sd, round(CAST(p AS DOUBLE),6) AS p_perm, round(cd,6) AS cliffs_delta_vs_null, round((med-nm)/greatest(nsd,1e-12),4) AS z_vs_null FROM o JOIN nl USING (entity_class, level) JOIN u USING (entity_class, level)""", ("foot", "dist"))
def _(spark, sf):
    lv = rows(spark, sf).withColumn("level", F.explode(F.array("cell_type", F.lit("ALL"))))
    t = Z.identity_null(lv, 3, 12, 3, ["entity_class", "level"])
    return r(r(t, 6, "mean_delta", "frac_positive_delta", "median_delta", "median_delta_swapped_map", "null_median", "null_sd", "p_perm", "cliffs_delta_vs_null"), 4, "z_vs_null")


# the same statistics over the marker channels and the two blank ones
STAT_ALL_SQL = re.sub(r"\bpx\b", "pxa", STAT_SQL)
GRP = "view, entity_class, subset, level"
pick = lambda ms, col="v": "[" + ", ".join(f"max({col}) FILTER (s.marker='{m}')" for m in ms) + "]"
summed = lambda a, n: " + ".join(f"coalesce({a}[{i}],0.0::DOUBLE)" for i in range(1, n + 1))
known = lambda a: f"list_aggregate({a}, 'count')"
blank = lambda tag: f"(C[{hint(chr(39) + '3' + chr(39), tag, 'entity_id')} % 2 + 1] - (ctot - coalesce(C[{hint(chr(39) + '3' + chr(39), tag, 'entity_id')} % 2 + 1],0))/greatest(ck-1,1))"


def effect_sql(name, case, null):
    return f"""{name} AS (SELECT {GRP}, 2.0*(sum(rk) FILTER (own=1) - n1*(n1+1)/2.0)/(n1*n0)-1 AS {name} FROM (SELECT *, count(*) FILTER (own=1) OVER (PARTITION BY {GRP}) AS n1, count(*) FILTER (own=0) OVER (PARTITION BY {GRP}) AS n0, avg(rn) OVER (PARTITION BY {GRP}, v) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY {GRP} ORDER BY v) AS rn FROM (
  SELECT {GRP}, 1 AS own, round({case},9) AS v FROM s UNION ALL SELECT {GRP}, 0, round({null},9) FROM s) WHERE v IS NOT NULL)) GROUP BY {GRP}, n1, n0)"""


CTRL_SQL = STAT_ALL_SQL + f""", {CANON_SQL}, mid AS (SELECT entity_id, cell_type, sample<=2 AS whole, avg(row) AS y, avg(col) AS x FROM foot GROUP BY ALL),
 dsc AS (SELECT entity_id, other <> cell_type AS dis FROM (SELECT a.entity_id, a.cell_type, b.cell_type AS other FROM mid a JOIN mid b ON b.whole AND b.entity_id<>a.entity_id QUALIFY row_number() OVER (PARTITION BY a.entity_id ORDER BY (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y), b.entity_id)=1)),
 vw AS (SELECT *, 'all_pixels' AS view, pos AS v FROM stats UNION ALL SELECT *, 'spillover_free', pos_far FROM stats),
 cr0 AS (SELECT entity_id, s.cell_type, entity_class, view, any_value(c.code) AS code, {pick('ANR')} AS P, {pick('FO')} AS C FROM vw s JOIN canon c ON c.cell_type=s.cell_type GROUP BY 1,2,3,4),
 cr AS (SELECT *, {summed('P', 3)} AS tot, {known('P')} AS k, {summed('C', 2)} AS ctot, {known('C')} AS ck FROM cr0 WHERE {known('P')}>=2),
 lv0 AS (SELECT *, cell_type AS level FROM cr UNION ALL SELECT *, 'ALL' FROM cr), lv AS (SELECT *, 'all' AS subset FROM lv0 UNION ALL SELECT lv0.*, 'discordant_neighbour' FROM lv0 JOIN dsc USING (entity_id) WHERE dis),
 s AS MATERIALIZED (SELECT *, {at('code')} AS d, {at('(code+1)%3')} AS sw, {at(other("'-1'"))} AS nu, {blank("'control'")} AS ct, {blank("'control null'")} AS cn FROM lv QUALIFY count(*) OVER (PARTITION BY {GRP}) >= 30),
 o AS (SELECT {GRP}, count(*) AS n, avg(d) AS md, avg(CASE WHEN d>0 THEN 1.0 WHEN d IS NOT NULL THEN 0 END) AS fp, quantile_cont(d,0.5) AS med, quantile_cont(sw,0.5) AS msw, quantile_cont(ct,0.5) AS mct, avg(CASE WHEN ct>0 THEN 1.0 WHEN ct IS NOT NULL THEN 0 END) AS fct FROM s GROUP BY ALL),
 x AS (SELECT {GRP}, draw, {at(other('draw'))} AS v FROM s CROSS JOIN (SELECT CAST(range AS INT) AS draw FROM range(12))), dm AS (SELECT {GRP}, draw, quantile_cont(v,0.5) AS m FROM x GROUP BY ALL),
 nl AS (SELECT {GRP}, quantile_cont(m,0.5) AS nm, stddev_samp(m) AS nsd, (count(*) FILTER (m>=med)+1)/13.0 AS p FROM dm JOIN o USING ({GRP}) GROUP BY ALL),
 ix AS (SELECT {GRP}, d AS v, row_number() OVER (PARTITION BY {GRP} ORDER BY {hx("'3'", 'entity_id')}, entity_id)-1 AS i, count(*) OVER (PARTITION BY {GRP}) AS n FROM s WHERE d IS NOT NULL),
 ps AS MATERIALIZED (SELECT {GRP}, rep, {hint("'3'", 'rep', 'view', 'entity_class', 'subset', 'level', 'i')} % n AS i FROM ix CROSS JOIN (SELECT CAST(range AS INT) AS rep FROM range(10))),
 bm AS (SELECT {GRP}, rep, quantile_cont(v,0.5) AS m FROM ps JOIN ix USING ({GRP}, i) GROUP BY ALL), ci AS (SELECT {GRP}, quantile_cont(m,0.025) AS lo, quantile_cont(m,0.975) AS hi FROM bm GROUP BY ALL),
 {effect_sql('cd', 'd', 'nu')}, {effect_sql('cds', 'sw', 'nu')}, {effect_sql('cdc', 'ct', 'cn')},
 bh AS (SELECT {GRP}, p, min(adj) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING) AS q FROM (SELECT {GRP}, CAST(p AS DOUBLE) AS p, CAST(p AS DOUBLE)*count(*) OVER ()/count(*) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING) AS adj FROM nl))"""


@query("identity_controls", f"""WITH {CTRL_SQL} SELECT {GRP}, n, round(md,6) AS mean_delta, round(fp,6) AS frac_positive_delta, round(med,6) AS median_delta, round(msw,6) AS median_delta_swapped_map, round(nm,6) AS null_median, round(nsd,6) AS null_sd, round(p,6) AS p_perm, round(cd,6) AS cliffs_delta_vs_null, round((med-nm)/greatest(nsd,1e-12),4) AS z_vs_null,
 round(lo,6) AS ci_lo, round(hi,6) AS ci_hi, round(mct,6) AS median_delta_control, round(fct,6) AS frac_positive_control, round(cds,6) AS cliffs_swapped_map, round(cdc,6) AS cliffs_control, round(least(q,1.0),6) AS q_bh
 FROM o JOIN nl USING ({GRP}) JOIN bh USING ({GRP}) LEFT JOIN ci USING ({GRP}) LEFT JOIN cd USING ({GRP}) LEFT JOIN cds USING ({GRP}) LEFT JOIN cdc USING ({GRP})""".replace("round(p,6) AS p_perm", "round(bh.p,6) AS p_perm"), ("foot", "dist", "pxa"))
def _(spark, sf):
    d = durable(dist(spark, sf))
    px = durable(V.pixels(spark, sf).unionByName(V.blank_pixels(spark, sf)))
    foot = durable(classed(spark, sf))
    s = X.channel_stats(foot, px, durable(X.calibrate_threshold(px, d.where("dist > 3"))), d, keep=["cell_type", "entity_class"])
    mid = foot.groupBy("entity_id", "cell_type", "entity_class").agg(F.avg("row").alias("y"), F.avg("col").alias("x"))
    near = Z.discordant(mid, F.col("entity_class") == "cell")
    rows = Z.control_rows(s, CANON, ["F", "O"], {"all_pixels": "pos", "spillover_free": "pos_far"}, keep="entity_class").join(near.select("entity_id", "discordant"), "entity_id", "left")
    lv = rows.withColumn("level", F.explode(F.array("cell_type", F.lit("ALL"))))
    lv = lv.withColumn("subset", F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("discordant"), "discordant_neighbour")))))
    t = Z.identity_controls(lv, 3, 2, 12, 10, 3, ["view", "entity_class", "subset", "level"])
    return r(r(t, 6, *[c for c in t.columns if c not in ("view", "entity_class", "subset", "level", "n", "z_vs_null")]), 4, "z_vs_null")


# --- windows -----------------------------------------------------------------------------------------

W, STRIDE = 12, 4
SUP_SQL = "sup AS (SELECT entity_id, any_value(cell_type) AS cell_type, CAST(floor(avg(row)) AS INT) AS row, CAST(floor(avg(col)) AS INT) AS col FROM foot GROUP BY 1)"
WIN_SQL = RES_SQL + f""", {SUP_SQL}, box AS (SELECT min(row) AS rl, max(row) AS rh, min(col) AS cl, max(col) AS ch FROM res WHERE tissue), wins AS (SELECT CAST(a.range AS INT) AS wr, CAST(b.range AS INT) AS wc, CAST(rl+a.range*{STRIDE} AS INT) AS r0, CAST(cl+b.range*{STRIDE} AS INT) AS c0 FROM box, range(60) a, range(60) b WHERE rl+a.range*{STRIDE} < rh-{W} AND cl+b.range*{STRIDE} < ch-{W}),
 wp AS (SELECT wr, wc, r0, c0, count(*) FILTER (tissue) AS t, count(*) FILTER (residual) AS rs FROM wins JOIN res ON row>=r0 AND row<r0+{W} AND col>=c0 AND col<c0+{W} GROUP BY ALL),
 ws AS (SELECT wr, wc, count(*) AS n_supported, count(DISTINCT cell_type) AS n_types, string_agg(DISTINCT cell_type, ',' ORDER BY cell_type) AS types FROM wins JOIN sup ON row>=r0 AND row<r0+{W} AND col>=c0 AND col<c0+{W} GROUP BY 1,2),
 elig AS (SELECT wr, wc, r0, c0, t/{W*W}.0::DOUBLE AS tissue_frac, rs/CAST(greatest(t,1) AS DOUBLE) AS residual_frac, n_supported, n_types, types FROM wp JOIN ws USING (wr, wc) WHERE t >= 0.3*{W*W} AND rs/CAST(greatest(t,1) AS DOUBLE) >= 0.1 AND n_supported >= 8 AND n_types >= 3)"""


def supported(spark, sf):
    return V.footprints(spark, sf).groupBy("entity_id").agg(F.first("cell_type").alias("cell_type"), F.floor(F.avg("row")).cast("int").alias("row"), F.floor(F.avg("col")).cast("int").alias("col"))


def eligible(spark, sf, res=None):
    return X.scan_windows(residual(spark, sf) if res is None else res, supported(spark, sf), W, STRIDE, tissue=0.3, residual=0.1)


@query("scan_windows", f"WITH {WIN_SQL} SELECT wr, wc, r0, c0, round(tissue_frac,6) AS tissue_frac, round(residual_frac,6) AS residual_frac, n_supported, CAST(n_types AS INT) AS n_types, types FROM elig", ("foot", "dist"))
def _(spark, sf):
    return r(eligible(spark, sf), 6, "tissue_frac", "residual_frac")


@query("capture_ratio", f"""WITH {WIN_SQL}, {CANON_SQL}, {THR_SQL}, rw AS (SELECT wr, wc, row, col FROM elig JOIN dist ON dist>2 AND row>=r0 AND row<r0+{W} AND col>=c0 AND col<c0+{W}), nr AS (SELECT wr, wc, count(*) AS n_res FROM rw GROUP BY 1,2),
 fw AS (SELECT DISTINCT wr, wc, r0, c0, f.cell_type, f.row, f.col FROM elig JOIN (SELECT * FROM foot WHERE cell_type IN ('BUILDING','MACHINERY','FURNITURE') AND sample>2) f ON f.row>=r0 AND f.row<r0+{W} AND f.col>=c0 AND f.col<c0+{W}),
 d1 AS (SELECT DISTINCT wr, wc, r0, c0, cell_type, row+i AS row, col+j AS col FROM fw, (VALUES (0,0),(1,0),(-1,0),(0,1),(0,-1)) o(i,j) WHERE row+i>=r0 AND row+i<r0+{W} AND col+j>=c0 AND col+j<c0+{W}),
 fm AS (SELECT DISTINCT wr, wc, cell_type, row+i AS row, col+j AS col FROM d1, (VALUES (0,0),(1,0),(-1,0),(0,1),(0,-1)) o(i,j) WHERE row+i>=r0 AND row+i<r0+{W} AND col+j>=c0 AND col+j<c0+{W}),
 pp AS (SELECT marker, row, col FROM px JOIN thr USING (marker) WHERE value-pedestal > thr),
 rp AS (SELECT DISTINCT rw.wr, rw.wc, c.cell_type, rw.row, rw.col FROM rw JOIN pp USING (row, col) JOIN canon c USING (marker) JOIN (SELECT DISTINCT wr, wc, cell_type FROM fw) x ON x.wr=rw.wr AND x.wc=rw.wc AND x.cell_type=c.cell_type),
 t AS (SELECT p.wr, p.wc, p.cell_type, pr, coalesce(cap,0)/CAST(pr AS DOUBLE) AS c, area/CAST(n_res AS DOUBLE) AS a FROM (SELECT wr, wc, cell_type, count(*) AS pr FROM rp GROUP BY 1,2,3) p JOIN (SELECT wr, wc, cell_type, count(*) AS area FROM fm SEMI JOIN rw USING (wr, wc, row, col) GROUP BY 1,2,3) USING (wr, wc, cell_type)
   LEFT JOIN (SELECT wr, wc, cell_type, count(*) AS cap FROM rp SEMI JOIN fm USING (wr, wc, cell_type, row, col) GROUP BY 1,2,3) USING (wr, wc, cell_type) JOIN nr USING (wr, wc) WHERE pr>=3)
SELECT wr, wc, round(sum(pr*c)/sum(pr),6) AS capture_frac, round(sum(pr*a)/sum(pr),6) AS area_frac, round(sum(pr*c/a)/sum(pr),6) AS capture_ratio FROM t GROUP BY 1,2""", ("foot", "dist"))
def _(spark, sf):
    d, thr = calibrated(spark, sf)
    foot = classed(spark, sf).where("entity_class = 'partial'")
    beyond = d.select("row", "col", (F.col("dist") > 2).alias("residual"))
    c = X.capture_ratio(eligible(spark, sf, durable(residual(spark, sf, d))), beyond, V.pixels(spark, sf), foot, thr, CANON, W, min_pos=3)
    return r(c, 6, "capture_frac", "area_frac", "capture_ratio")


@query("signed_distance_bands", """WITH ext AS (SELECT sample, CAST(ceil(max(x)/25)+1 AS INT) AS nx, CAST(ceil(max(y)/25)+1 AS INT) AS ny FROM ent GROUP BY 1), c AS (SELECT sample, CAST(floor(x/25) AS INT) AS row, CAST(floor(y/25) AS INT) AS col, cell_type FROM ent),
 o AS (SELECT i, j FROM (VALUES (-1),(0),(1)) a(i), (VALUES (-1),(0),(1)) b(j)), g AS (SELECT sample, CAST(a.range AS INT) AS row, CAST(b.range AS INT) AS col FROM ext, range(100) a, range(100) b WHERE a.range<nx AND b.range<ny),
 m AS (SELECT DISTINCT sample, row, col FROM c WHERE cell_type='TUMOR'), di AS (SELECT DISTINCT m.sample, m.row+i AS row, m.col+j AS col FROM m, o), dg AS (SELECT * FROM di SEMI JOIN g USING (sample, row, col)),
 cl AS (SELECT g.sample, g.row, g.col FROM g CROSS JOIN o JOIN dg ON dg.sample=g.sample AND dg.row=g.row+i AND dg.col=g.col+j GROUP BY 1,2,3 HAVING count(*)=9), nm AS (SELECT * FROM g ANTI JOIN cl USING (sample, row, col)),
 oc AS (SELECT sample, row, col, count(*) AS n, count(*) FILTER (cell_type='T') AS t FROM c GROUP BY 1,2,3),
 sd AS (SELECT oc.sample, oc.row, oc.col, oc.n, oc.t, sqrt(min((oc.row-cl.row)*(oc.row-cl.row)+(oc.col-cl.col)*(oc.col-cl.col)))*25 AS s FROM (SELECT * FROM oc ANTI JOIN cl USING (sample, row, col)) oc JOIN cl ON cl.sample=oc.sample GROUP BY ALL
  UNION ALL SELECT oc.sample, oc.row, oc.col, oc.n, oc.t, -sqrt(min((oc.row-nm.row)*(oc.row-nm.row)+(oc.col-nm.col)*(oc.col-nm.col)))*25 FROM (SELECT * FROM oc SEMI JOIN cl USING (sample, row, col)) oc JOIN nm ON nm.sample=oc.sample GROUP BY ALL)
SELECT sample, CAST(least(floor((s+300)/25),23) AS INT) AS band, -300+(CAST(least(floor((s+300)/25),23) AS INT)+0.5::DOUBLE)*25 AS mid, CAST(sum(n) AS BIGINT) AS n, CAST(sum(t) AS BIGINT) AS n_target, CASE WHEN sum(n)>=20 THEN round(sum(t)/sum(n),6) END AS share_of_entities FROM sd WHERE s BETWEEN -300 AND 300 GROUP BY 1,2""", "ent")
def _(spark, sf):
    t = X.signed_distance_bands(V.entities(spark, sf), F.col("cell_type") == "TUMOR", F.col("cell_type") == "T", "sample")
    return r(t, 6, "share_of_entities")
