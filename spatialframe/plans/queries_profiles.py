"""Checked queries: expression profiles, label transfer and neighbours in feature space."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rarefied_detection
from ..operators import profiles as P, stats as T, summaries as D, vectors as K
from . import views as V
from .queries_summaries import r
from .registry import query

B = lambda *ks: [f"Brand#{i}" for i in ks]
MODULES = {"m1": B(1, 2, 3), "m2": B(4, 5, 6)}
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PANEL = {t: B(3 * i + 1, 3 * i + 2, 3 * i + 3) for i, t in enumerate(SEGMENTS)}
LINEAGES = {"wood": ["BUILDING", "FURNITURE"], "metal": ["AUTOMOBILE"], "house": ["HOUSEHOLD"]}
inlist = lambda xs: "(" + ",".join(f"'{x}'" for x in xs) + ")"

CNT = "cnt AS (SELECT entity_id, feature, count(*) AS count FROM mol GROUP BY 1,2), ment AS (SELECT entity_id, any_value(sample) AS sample, any_value(cell_type) AS cell_type, count(*) AS n_tx FROM mol GROUP BY 1)"
PANEL_SQL = "panel AS (SELECT * FROM (VALUES " + ",".join(f"('{t}','{g}')" for t, gs in PANEL.items() for g in gs) + ") v(owner, feature))"


def counts(spark, sf):
    return D.count_matrix(V.molecules(spark, sf))


def ment(spark, sf):
    return V.molecules(spark, sf).groupBy("entity_id").agg(F.first("sample").alias("sample"), F.first("cell_type").alias("cell_type"), D.n_rows().alias("n_tx"))


def rates(spark, sf):
    return P.module_rate(counts(spark, sf), ment(spark, sf), MODULES)


RATE_SQL = CNT + f""", rated AS (SELECT m.*, coalesce(k1,0) AS m1_k, coalesce(k2,0) AS m2_k, coalesce(k1,0)/CAST(greatest(n_tx,1) AS DOUBLE)*1e4 AS m1_rate, coalesce(k2,0)/CAST(greatest(n_tx,1) AS DOUBLE)*1e4 AS m2_rate
 FROM ment m LEFT JOIN (SELECT entity_id, CAST(sum(count) FILTER (feature IN {inlist(MODULES['m1'])}) AS BIGINT) AS k1, CAST(sum(count) FILTER (feature IN {inlist(MODULES['m2'])}) AS BIGINT) AS k2 FROM cnt GROUP BY 1) USING (entity_id))"""


@query("module_rate", f"WITH {RATE_SQL} SELECT entity_id, m1_k, m2_k, round(m1_rate,6) AS m1_rate, round(m2_rate,6) AS m2_rate, m1_k>0 AS m1_pos, m2_k>0 AS m2_pos FROM rated", "mol")
def _(spark, sf):
    return r(rates(spark, sf), 6, "m1_rate", "m2_rate").select("entity_id", "m1_k", "m2_k", "m1_rate", "m2_rate", "m1_pos", "m2_pos")


POPS = {"all": "true", "building": "cell_type = 'BUILDING'", "machinery": "cell_type = 'MACHINERY'", "m1 high": "m1_k >= 5", "m2 high": "m2_k >= 5", "deep": "n_tx > 40"}
POP_SQL = "pop AS (" + " UNION ALL ".join(f"SELECT '{p}' AS population, * FROM rated WHERE {c}" for p, c in POPS.items()) + ")"
pops = lambda: {p: F.expr(c) for p, c in POPS.items()}


@query("population_summary", f"""WITH {RATE_SQL}, {POP_SQL} SELECT population, count(*) AS n, round(avg(m1_rate),6) AS mean_rate, round(avg(CASE WHEN m1_rate>0 THEN 1.0 ELSE 0 END),6) AS frac_pos,
  round(quantile_cont(m1_rate,0.5),6) AS median_rate, quantile_cont(CAST(n_tx AS DOUBLE),0.5) AS median_depth FROM pop GROUP BY 1""", "mol")
def _(spark, sf):
    return r(P.population_summary(rates(spark, sf), pops(), "m1_rate"), 6, "mean_rate", "frac_pos", "median_rate")


@query("gene_profile", f"""WITH {RATE_SQL}, {POP_SQL} SELECT population, feature, n, round(count(*)/CAST(any_value(n) AS DOUBLE),6) AS frac_pos, round(sum(count/CAST(n_tx AS DOUBLE)*1e4)/any_value(n),6) AS mean_rate
 FROM pop JOIN cnt USING (entity_id) JOIN (SELECT population, count(*) AS n FROM pop GROUP BY 1) USING (population) GROUP BY 1,2,3""", "mol")
def _(spark, sf):
    return r(P.gene_profile(counts(spark, sf), rates(spark, sf), pops()), 6, "frac_pos", "mean_rate")


@query("pseudobulk", f"""WITH {CNT}, t AS (SELECT sample, cell_type, sum(n_tx) AS d, count(*) AS n FROM ment GROUP BY 1,2), u AS (SELECT cell_type, count(*) AS n_units FROM t GROUP BY 1),
 g AS (SELECT sample, cell_type, feature, sum(count) AS s, count(*) AS p FROM ment JOIN cnt USING (entity_id) GROUP BY 1,2,3)
SELECT cell_type, feature, n_units, round(sum(ln(1+s/CAST(d AS DOUBLE)*1e4))/n_units,6) AS expr, round(sum(p/CAST(n AS DOUBLE))/n_units,6) AS frac_expressing FROM g JOIN t USING (sample, cell_type) JOIN u USING (cell_type) GROUP BY 1,2,3""", "mol")
def _(spark, sf):
    return r(P.pseudobulk(counts(spark, sf), ment(spark, sf), "cell_type"), 6, "expr", "frac_expressing")


ED_SQL = """ed AS (SELECT cell_type, feature, n_cells, median_depth, sum(ln(1+count/CAST(n_tx AS DOUBLE)*1e4))/n_cells AS expr, count(*)/CAST(n_cells AS DOUBLE) AS detect FROM ment JOIN cnt USING (entity_id)
  JOIN (SELECT cell_type, count(*) AS n_cells, quantile_cont(CAST(n_tx AS DOUBLE),0.5) AS median_depth FROM ment GROUP BY 1) USING (cell_type) GROUP BY 1,2,3,4)"""


def detected(spark, sf):
    return P.expr_detect(counts(spark, sf), ment(spark, sf), "cell_type")


@query("expr_detect", f"WITH {CNT}, {ED_SQL} SELECT cell_type, feature, n_cells, median_depth, round(expr,6) AS expr, round(detect,6) AS detect FROM ed", "mol")
def _(spark, sf):
    return r(detected(spark, sf), 6, "expr", "detect")


@query("dotplot_stats", f"""WITH {CNT}, s AS (SELECT sample, cell_type, count(*) AS n FROM ment GROUP BY 1,2), e AS (SELECT sample, cell_type, feature, sum(ln(1+count/CAST(n_tx AS DOUBLE)*1e4)) AS e, count(*) AS p FROM ment JOIN cnt USING (entity_id) GROUP BY 1,2,3)
SELECT sample, cell_type, f AS feature, n, round(coalesce(e/n,0),6) AS mean_expr, round(coalesce(p/CAST(n AS DOUBLE),0),6) AS frac_expr FROM s CROSS JOIN (VALUES ('Brand#1'),('Brand#2'),('Brand#99')) v(f) LEFT JOIN e ON e.sample=s.sample AND e.cell_type=s.cell_type AND e.feature=f""".replace("SELECT sample, cell_type, f AS", "SELECT s.sample, s.cell_type, f AS"), "mol")
def _(spark, sf):
    return r(P.dotplot_stats(counts(spark, sf), ment(spark, sf), ["Brand#1", "Brand#2", "Brand#99"], ["sample", "cell_type"]), 6, "mean_expr", "frac_expr")


PROF_SQL = CNT + """, prof AS (SELECT cell_type, feature, n_cells, CAST(total AS BIGINT) AS total, total/CAST(sum(total) OVER (PARTITION BY cell_type) AS DOUBLE)*1e6 AS cpm, det/CAST(n_cells AS DOUBLE) AS detection FROM
  (SELECT cell_type, feature, sum(count) AS total, count(*) AS det FROM ment JOIN cnt USING (entity_id) GROUP BY 1,2) JOIN (SELECT cell_type, count(*) AS n_cells FROM ment GROUP BY 1) USING (cell_type))"""
LIN_SQL = "lin AS (SELECT * FROM (VALUES " + ",".join(f"('{n}','{t}',{len(ts)})" for n, ts in LINEAGES.items() for t in ts) + ") v(lineage, cell_type, k))" + \
    """, sc AS (SELECT l.lineage, p.feature, sum(detection) FILTER (m.k IS NOT NULL)/any_value(l.k) AS detection, sum(cpm) FILTER (m.k IS NOT NULL)/any_value(l.k) AS cpm, coalesce(max(cpm) FILTER (m.k IS NULL),0) AS max_other_cpm
  FROM prof p CROSS JOIN (SELECT DISTINCT lineage, k FROM lin) l LEFT JOIN lin m ON m.lineage=l.lineage AND m.cell_type=p.cell_type GROUP BY 1,2),
 mods AS (SELECT *, cpm/greatest(max_other_cpm,1e-9) AS specificity, log2(greatest(cpm/greatest(max_other_cpm,1e-9),1e-9))*detection AS score FROM sc WHERE detection >= 0.2 AND cpm/greatest(max_other_cpm,1e-9) >= 0.8 AND cpm > 0 AND feature NOT IN ('Brand#7')
  QUALIFY row_number() OVER (PARTITION BY lineage ORDER BY score DESC, feature) <= 6)"""


def refprof(spark, sf):
    return P.reference_profile(counts(spark, sf), ment(spark, sf))


def modules(spark, sf):
    return P.derive_modules(refprof(spark, sf), LINEAGES, ["Brand#7"], det=0.2, spec=0.8, n=6)


@query("reference_profile", f"WITH {PROF_SQL} SELECT cell_type, feature, n_cells, total, round(cpm,4) AS cpm, round(detection,6) AS detection FROM prof", "mol")
def _(spark, sf):
    return r(r(refprof(spark, sf), 4, "cpm"), 6, "detection")


@query("derive_modules", f"WITH {PROF_SQL}, {LIN_SQL} SELECT lineage, feature, round(detection,6) AS detection, round(cpm,4) AS cpm, round(max_other_cpm,4) AS max_other_cpm, round(specificity,6) AS specificity, round(score,6) AS score FROM mods", "mol")
def _(spark, sf):
    return r(r(modules(spark, sf), 4, "cpm", "max_other_cpm"), 6, "detection", "specificity", "score")


@query("audit_markers", f"""WITH {PROF_SQL}, {LIN_SQL} SELECT feature, round(detection,6) AS detection, round(cpm,4) AS cpm, round(cpm/greatest(max_other_cpm,1e-9),6) AS specificity, detection>=0.35 AS passes_stability,
  feature IN (SELECT feature FROM mods WHERE lineage='wood') AS in_reference_module FROM sc WHERE lineage='wood' AND feature IN {inlist(B(1, 2, 3, 4, 5, 6, 7, 8))}""", "mol")
def _(spark, sf):
    return r(r(P.audit_markers(refprof(spark, sf), LINEAGES, "wood", B(*range(1, 9)), modules(spark, sf)), 4, "cpm"), 6, "detection", "specificity")


@query("centroid_matrix", f"""WITH {PROF_SQL} SELECT cell_type, """ + ", ".join(f"round(coalesce(max(cpm) FILTER (feature='{g}'),0),4) AS \"{g}\"" for g in B(1, 2, 3, 4)) + " FROM prof GROUP BY 1", "mol")
def _(spark, sf):
    return r(P.centroid_matrix(refprof(spark, sf), B(1, 2, 3, 4)), 4, *B(1, 2, 3, 4))


@query("label_coherence", f"""WITH {CNT}, {ED_SQL}, {PANEL_SQL}, zs AS (SELECT *, CASE WHEN stddev_samp(expr) OVER w = 0 THEN 0 ELSE (expr - avg(expr) OVER w)/stddev_samp(expr) OVER w END AS z FROM ed WINDOW w AS (PARTITION BY feature)),
 g AS (SELECT owner, cell_type, avg(z) AS z, avg(detect) AS d, max(n_cells) AS n, count(*) AS k FROM zs JOIN panel USING (feature) GROUP BY 1,2),
 c AS (SELECT owner AS cell_type, 3 AS n_markers, max(z) FILTER (owner=cell_type) AS own_z, max(z) FILTER (owner<>cell_type) AS best_other_z, arg_max(cell_type, z) FILTER (owner<>cell_type) AS most_confusable, max(d) FILTER (owner=cell_type) AS mean_detection, max(n) FILTER (owner=cell_type) AS n_cells FROM g GROUP BY 1)
SELECT cell_type, n_markers, round(own_z,6) AS own_z, round(best_other_z,6) AS best_other_z, round(own_z-best_other_z,6) AS specificity, most_confusable, round(mean_detection,6) AS mean_detection, n_cells, own_z-best_other_z<1.5 AS weak_specificity, mean_detection<0.6 AS weak_detection,
 CASE WHEN own_z-best_other_z<1.5 AND mean_detection<0.6 THEN 'ambiguous + sparse' WHEN own_z-best_other_z<1.5 THEN 'ambiguous' WHEN mean_detection<0.6 THEN 'sparse' ELSE 'ok' END AS flag FROM c""", "mol")
def _(spark, sf):
    z = D.zscore_by(detected(spark, sf), "feature", "expr")
    return r(P.label_coherence(z, PANEL, weak_det=0.6), 6, "own_z", "best_other_z", "specificity", "mean_detection")


CANON_SQL = CNT + f""", {PANEL_SQL}, kept AS (SELECT sample, cell_type, count(*) AS n FROM ment GROUP BY 1,2 HAVING count(*) >= 5),
 mean AS (SELECT k.sample, k.cell_type, p.feature, coalesce(sum(count/CAST(n_tx AS DOUBLE)*1e4),0)/k.n AS m FROM kept k CROSS JOIN (SELECT DISTINCT feature FROM panel) p JOIN ment e ON e.sample=k.sample AND e.cell_type=k.cell_type LEFT JOIN cnt c ON c.entity_id=e.entity_id AND c.feature=p.feature GROUP BY k.sample, k.cell_type, p.feature, k.n),
 fc AS (SELECT sample, cell_type, log2((m+1)/((sm-m)/(k-1)+1)) AS fc FROM (SELECT *, sum(m) OVER (PARTITION BY sample, feature) AS sm, count(*) OVER (PARTITION BY sample, feature) AS k FROM mean) JOIN panel ON owner=cell_type AND panel.feature=feature WHERE k > 1),
 ty AS (SELECT sample, cell_type, median(fc) AS log2fc, count(*) AS n_markers FROM fc GROUP BY 1,2 HAVING count(*) >= 2)""".replace("JOIN panel ON owner=cell_type AND panel.feature=feature", "q JOIN panel ON owner=q.cell_type AND panel.feature=q.feature")


def canonical(spark, sf, level):
    return P.canonical_log2fc(counts(spark, sf), ment(spark, sf).select("entity_id", "sample", "cell_type"), PANEL, "sample", level=level)


@query("canonical_log2fc", f"WITH {CANON_SQL} SELECT sample, cell_type, round(log2fc,6) AS log2fc, n_markers FROM ty", "mol")
def _(spark, sf):
    return r(canonical(spark, sf, "type"), 6, "log2fc")


@query("canonical_log2fc_group", f"WITH {CANON_SQL} SELECT sample, CASE WHEN count(*)>=2 THEN round(median(log2fc),6) END AS canonical_marker_log2fc, count(*) AS n_types_scored FROM ty GROUP BY 1", "mol")
def _(spark, sf):
    return r(canonical(spark, sf, "group"), 6, "canonical_marker_log2fc")


@query("select_anchors", f"""WITH {CNT}, lg AS (SELECT c.*, cell_type AS label, ln(1+count) AS l FROM cnt c JOIN ment USING (entity_id)), nc AS (SELECT cell_type AS label, count(*) AS n FROM ment GROUP BY 1), na AS (SELECT count(*) AS tot FROM ment),
 spec AS (SELECT label, feature, s/n - ga/tot AS sp FROM (SELECT label, feature, sum(l) AS s FROM lg GROUP BY 1,2) JOIN (SELECT feature, sum(l) AS ga FROM lg GROUP BY 1) USING (feature) JOIN nc USING (label), na),
 top AS (SELECT label, feature FROM spec QUALIFY row_number() OVER (PARTITION BY label ORDER BY sp DESC, feature) <= 5),
 en AS (SELECT entity_id, lg.label, CAST(sum(count) AS BIGINT) AS depth, coalesce(sum(l) FILTER (top.feature IS NOT NULL),0) AS score FROM lg LEFT JOIN top ON top.label=lg.label AND top.feature=lg.feature GROUP BY 1,2),
 cut AS (SELECT label, quantile_cont(CAST(depth AS DOUBLE),0.1) AS d10, quantile_cont(score,0.5) AS m50 FROM en GROUP BY 1),
 k AS (SELECT *, depth>=d10 AS deep, depth>=d10 AND score>=m50 AS both_, count(*) FILTER (depth>=d10 AND score>=m50) OVER (PARTITION BY label) AS b FROM en JOIN cut USING (label) JOIN nc USING (label))
SELECT entity_id, label, depth, round(score,6) AS score FROM k WHERE CASE WHEN n<=50 THEN true WHEN b<50 THEN deep ELSE both_ END QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('3|'||label||'|'||entity_id), entity_id) <= 60""", "mol")
def _(spark, sf):
    lab = ment(spark, sf).select("entity_id", F.col("cell_type").alias("label"))
    return r(P.select_anchors(counts(spark, sf), lab, cap=60, floor=50, n_top=5, seed=3), 6, "score")


# --- dense profiles as long values -------------------------------------------------------------------

LONG_SQL = "plong AS (SELECT vec_id, CAST(label AS VARCHAR) AS label, i AS feature, CAST(embedding[i] AS DOUBLE) AS value FROM embeddings, generate_series(1,64) t(i)), cent AS (SELECT label, feature, avg(value) AS value FROM plong GROUP BY 1,2)"
COS_SQL = LONG_SQL + """, cn AS (SELECT label, sqrt(sum(value*value)) AS n FROM cent GROUP BY 1), qn AS (SELECT vec_id, sqrt(sum(value*value)) AS n FROM plong GROUP BY 1),
 sims AS (SELECT q.vec_id, c.label, sum(q.value*c.value)/any_value(qn.n)/any_value(cn.n) AS cosine FROM plong q JOIN cent c USING (feature) JOIN cn ON cn.label=c.label JOIN qn ON qn.vec_id=q.vec_id GROUP BY 1,2)"""


def plong(spark, sf):
    p = V.profiles(spark, sf)
    return (p.select("vec_id", F.posexplode("embedding").alias("i", "v"))
            .select("vec_id", (F.col("i") + 1).cast("bigint").alias("feature"), F.col("v").cast("double").alias("value")))


def plabels(spark, sf):
    return V.profiles(spark, sf).select("vec_id", F.col("label").cast("string").alias("label"))


def pcent(spark, sf):
    return P.class_centroids(plong(spark, sf), plabels(spark, sf), "vec_id")


@query("class_centroids", f"WITH {LONG_SQL} SELECT label, feature, round(value,9) AS value FROM cent")
def _(spark, sf):
    return r(pcent(spark, sf), 9, "value")


@query("score_centroids", f"WITH {COS_SQL} SELECT vec_id, label, round(cosine,9) AS cosine FROM sims")
def _(spark, sf):
    return r(P.score_centroids(plong(spark, sf), pcent(spark, sf), "vec_id"), 9, "cosine")


@query("transfer_labels", f"""WITH {COS_SQL}, z AS (SELECT *, exp((cosine - max(cosine) OVER (PARTITION BY vec_id))/0.05) AS e, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, label) AS rn FROM sims), p AS (SELECT *, e/sum(e) OVER (PARTITION BY vec_id) AS pr FROM z)
SELECT vec_id, max(label) FILTER (rn=1) AS transferred_label, round(max(pr) FILTER (rn=1),6) AS transfer_confidence, max(label) FILTER (rn=2) AS second_label, round(max(pr) FILTER (rn=2),6) AS second_confidence FROM p GROUP BY 1""")
def _(spark, sf):
    t = P.transfer_labels(P.score_centroids(plong(spark, sf), pcent(spark, sf), "vec_id"), 0.05, "vec_id")
    return r(t, 6, "transfer_confidence", "second_confidence")


@query("reference_similarity", f"""WITH {PROF_SQL}, cn AS (SELECT cell_type, sqrt(sum(v*v)) AS n FROM (SELECT cell_type, ln(1+cpm) AS v FROM prof) GROUP BY 1), q AS (SELECT entity_id, feature, ln(1+count/CAST(n_tx AS DOUBLE)*1e6) AS v FROM cnt JOIN ment USING (entity_id)),
 qn AS (SELECT entity_id, sqrt(sum(v*v)) AS n FROM q GROUP BY 1), s AS (SELECT q.entity_id, c.cell_type, sum(q.v*ln(1+c.cpm))/any_value(qn.n)/any_value(cn.n) AS cosine FROM q JOIN prof c USING (feature) JOIN cn ON cn.cell_type=c.cell_type JOIN qn ON qn.entity_id=q.entity_id GROUP BY 1,2)
SELECT entity_id, round(cosine,9) AS cosine, cell_type AS best FROM s QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY cosine DESC, cell_type)=1""", "mol")
def _(spark, sf):
    cent = refprof(spark, sf).select("cell_type", "feature", F.log1p("cpm").alias("value"))
    return r(P.reference_similarity(counts(spark, sf), cent, ment(spark, sf).select("entity_id", "n_tx")), 9, "cosine")


@query("rarefied_detection", f"""WITH {RATE_SQL} SELECT entity_id, round(CASE WHEN m1_k<=0 OR n_tx<20 THEN 0.0 WHEN n_tx-m1_k<20 THEN 1.0 ELSE 1-exp(lgamma(n_tx-m1_k+1)-lgamma(greatest(n_tx-m1_k-20+1,1))-(lgamma(n_tx+1)-lgamma(greatest(n_tx-20+1,1)))) END,6) AS p FROM rated""", "mol")
def _(spark, sf):
    return rates(spark, sf).select("entity_id", F.round(rarefied_detection(F.col("n_tx"), F.col("m1_k"), 20), 6).alias("p"))


@query("marker_support", f"""WITH {CNT}, {PANEL_SQL}, s AS (SELECT entity_id, owner, round(coalesce(sum(ln(1+count/CAST(n_tx AS DOUBLE)*1e3)),0)/3, 12) AS sc FROM (SELECT m.*, owner, feature FROM ment m CROSS JOIN panel) LEFT JOIN cnt USING (entity_id, feature) GROUP BY 1,2),
 k AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY sc DESC, owner) AS rk, max(sc) OVER (PARTITION BY entity_id) AS mx FROM s)
SELECT entity_id, cell_type AS label, round(sc,6) AS own_score, rk<=2 AS marker_supported, rk<=2 AND sc>0 AS marker_supported_strict, mx=0 AS no_marker_signal FROM k JOIN ment USING (entity_id) WHERE owner=cell_type""", "mol")
def _(spark, sf):
    lab = ment(spark, sf).select("entity_id", F.col("cell_type").alias("label"))
    return r(P.marker_support(counts(spark, sf), lab, PANEL), 6, "own_score")


THIN_SQL = CNT + """, thin AS (SELECT entity_id, feature, count(*) AS count FROM (SELECT c.entity_id, feature, n_tx, unnest(generate_series(1, count)) AS i FROM cnt c JOIN ment USING (entity_id))
  WHERE CAST('0x'||substr(md5('5|'||entity_id||'|'||feature||'|'||i),1,8) AS BIGINT)/4294967296.0 < least(1.0, 15.0/greatest(n_tx,1)) GROUP BY 1,2)"""


def thinned(spark, sf):
    t = ment(spark, sf).select("entity_id", F.lit(15.0).alias("target"))
    return P.thin_counts(counts(spark, sf), t, 5)


@query("thin_counts", f"WITH {THIN_SQL} SELECT entity_id, feature, count FROM thin", "mol")
def _(spark, sf):
    return thinned(spark, sf)


TOP_SQL = "SELECT entity_id, feature AS label FROM {0} QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY count DESC, feature)=1"


@query("label_stability", f"WITH {THIN_SQL}, f AS ({TOP_SQL.format('cnt')}), t AS ({TOP_SQL.format('thin')}) SELECT f.label, round(avg(CASE WHEN f.label=t.label THEN 1.0 ELSE 0 END),6) AS label_kept, count(*) AS n FROM f JOIN t USING (entity_id) GROUP BY 1", "mol")
def _(spark, sf):
    from ..operators.windows import top_n_per_group
    top = lambda c: top_n_per_group(c, "entity_id", [F.desc("count"), "feature"], 1).select("entity_id", F.col("feature").alias("label"))
    return r(P.label_stability(top(counts(spark, sf)), top(thinned(spark, sf))), 6, "label_kept")


@query("ref_marker_support", f"""WITH {CNT}, {PANEL_SQL}, ln AS (SELECT entity_id, cell_type, feature, ln(1+count/CAST(n_tx AS DOUBLE)*1e4) AS v FROM cnt JOIN ment USING (entity_id)), n AS (SELECT cell_type, count(*) AS n FROM ment GROUP BY 1),
 m AS (SELECT owner, p.feature, n.cell_type, coalesce(sum(v),0)/any_value(n.n) AS v FROM panel p CROSS JOIN n LEFT JOIN ln ON ln.cell_type=n.cell_type AND ln.feature=p.feature GROUP BY 1,2,3)
SELECT owner, feature, true AS in_reference, round(max(v) FILTER (owner=cell_type),6) AS ref_mean_own, arg_max(cell_type, v) AS ref_top_class, arg_max(cell_type, v)=owner AS ref_own_is_top, round(max(v) FILTER (owner=cell_type)-max(v) FILTER (owner<>cell_type),6) AS ref_own_over_next FROM m GROUP BY 1,2""", "mol")
def _(spark, sf):
    lab = ment(spark, sf).select("entity_id", F.col("cell_type").alias("label"))
    return r(P.ref_marker_support(counts(spark, sf), lab, PANEL), 6, "ref_mean_own", "ref_own_over_next")


# --- neighbours in feature space ---------------------------------------------------------------------

KNN_SQL = """knn AS (SELECT a.vec_id AS id, b.vec_id AS neighbor_id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS dist, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS rank
  FROM embeddings a JOIN embeddings b ON a.vec_id<>b.vec_id QUALIFY rank <= 15)"""


def knn(spark, sf):
    return K.feature_knn(V.profiles(spark, sf), 15, "vec_id", "embedding")


@query("feature_knn", f"WITH {KNN_SQL} SELECT id, neighbor_id, round(dist,6) AS dist, CAST(rank AS INT) AS rank FROM knn")
def _(spark, sf):
    return r(knn(spark, sf), 6, "dist")


@query("knn_coherence", f"""WITH {KNN_SQL}, s AS (SELECT id, a.label, avg(CASE WHEN a.label=b.label THEN 1.0 ELSE 0 END) AS s FROM knn JOIN embeddings a ON a.vec_id=id JOIN embeddings b ON b.vec_id=neighbor_id GROUP BY 1,2)
SELECT label, n, round(avg(s),6) AS knn_same_label, round(n/CAST(t AS DOUBLE),6) AS baseline_type_freq, round(avg(s)/(n/CAST(t AS DOUBLE)),6) AS enrichment FROM s JOIN (SELECT label, count(*) AS n, sum(count(*)) OVER () AS t FROM embeddings GROUP BY 1) USING (label) GROUP BY label, n, t""")
def _(spark, sf):
    lab = V.profiles(spark, sf).select(F.col("vec_id").alias("id"), "label")
    return r(P.knn_coherence(knn(spark, sf), lab), 6, "knn_same_label", "baseline_type_freq", "enrichment")


@query("shared_embedding")
def _(spark, sf):
    p = V.profiles(spark, sf).select(F.col("vec_id").alias("id"), F.when(F.col("label") < 5, "a").otherwise("b").alias("arm"), F.col("embedding").alias("vector"))
    e = K.shared_embedding(p, k=10, lognorm=False)
    return e.select("id", "arm", F.round(F.col("pcs")[0], 4).alias("pc1"), F.round(F.col("pcs")[1], 4).alias("pc2"), F.size("pcs").alias("n_pc"))


@query("wide_embedding")
def _(spark, sf):
    p = V.profiles(spark, sf).select(F.col("vec_id").alias("id"), F.when(F.col("label") < 5, "a").otherwise("b").alias("arm"), F.col("embedding").alias("vector"))
    e = K.wide_embedding(p, k=10, lognorm=False)
    return e.select("id", "arm", F.round(F.col("pcs")[0], 4).alias("pc1"), F.round(F.col("pcs")[1], 4).alias("pc2"), F.size("pcs").alias("n_pc"))
