"""Checked queries: grouped summaries, method comparison and tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calls as C, entities as E, stats as T, summaries as D, windows as G
from . import views as V
from .registry import query

TYPES = ["TUMOR", "TAM", "T", "B", "STROMA", "MAST"]
AXES = [("lig-rec (tumour)", "lig", "TUMOR", "rec", "T"), ("lig-rec (TAM)", "lig", "TAM", "rec", "T"),
        ("rec-lig (TAM)", "rec", "TAM", "lig", "T")]


def r(df, digits, *cols):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def settle(df, digits, *cols):
    """Round means whose exact value may end in a 5: a tiny shift keeps both engines on the same side."""
    return df.withColumns({c: F.round(F.col(c) + 1e-8, digits) for c in cols})


def arms():
    """Three arms over one entity table: confident whole cells, all whole cells, everything."""
    return {"pre": (F.col("etype") == "cell") & (F.col("confidence") >= 0.7), "post_whole": F.col("etype") == "cell",
            "post_all": F.lit(True)}


ARM_SQL = """armed AS (SELECT 'pre' AS arm, * FROM ent WHERE etype = 'cell' AND confidence >= 0.7
 UNION ALL SELECT 'post_whole', * FROM ent WHERE etype = 'cell' UNION ALL SELECT 'post_all', * FROM ent)"""
AXIS_SQL = ARM_SQL + """, evaluable AS (
 SELECT sample, arm, axis, a AS n_anchor_pos, t AS n_target_pos, a >= 18 AND t >= 18 AS evaluable FROM (
  SELECT sample, arm, 'lig-rec (tumour)' AS axis, count(*) FILTER (lig>0 AND cell_type='TUMOR') AS a, count(*) FILTER (rec>0 AND cell_type='T') AS t FROM armed GROUP BY 1,2
  UNION ALL SELECT sample, arm, 'lig-rec (TAM)', count(*) FILTER (lig>0 AND cell_type='TAM'), count(*) FILTER (rec>0 AND cell_type='T') FROM armed GROUP BY 1,2
  UNION ALL SELECT sample, arm, 'rec-lig (TAM)', count(*) FILTER (rec>0 AND cell_type='TAM'), count(*) FILTER (lig>0 AND cell_type='T') FROM armed GROUP BY 1,2))"""


@query("inventory", """SELECT cell_type, o AS original, c AS complete, p AS partial, t AS total, round(t / CAST(o AS DOUBLE), 6) AS fold FROM (
  SELECT cell_type, count(*) FILTER (etype='cell' AND confidence >= 0.7) AS o, count(*) FILTER (etype='cell') AS c,
   count(*) FILTER (etype='partial') AS p, count(*) AS t FROM ent GROUP BY 1)""", "ent")
def _(spark, sf):
    e = V.entities(spark, sf)
    return r(D.inventory(e.where(arms()["pre"]), e), 6, "fold")


@query("composition", """SELECT sample, t AS cell_type, count(e.entity_id) AS n, round(count(e.entity_id) / CAST(any_value(total) AS DOUBLE), 6) AS fraction
 FROM (SELECT sample, count(*) AS total FROM ent GROUP BY 1) CROSS JOIN (VALUES ('TUMOR'),('TAM'),('T'),('B'),('STROMA'),('MAST')) v(t)
 LEFT JOIN ent e USING (sample) WHERE e.cell_type = t GROUP BY 1,2
 UNION ALL SELECT DISTINCT sample, 'MAST', 0, 0.0 FROM ent""", "ent")
def _(spark, sf):
    return r(D.composition(V.entities(spark, sf), "sample", "cell_type", TYPES), 6, "fraction")


PHASES = ["input", "group", "finalize"]
CLS = "CASE {0} WHEN 0 THEN 'original cell' WHEN 1 THEN 'partial' WHEN 3 THEN 'unassigned' WHEN 5 THEN 'neighboring cell' END"


@query("phase_counts", " UNION ALL ".join(
    f"SELECT '{p}' AS phase, etype_at_{p} AS etype, {CLS.format('etype_at_' + p)} AS cls, count(*) AS n FROM mol GROUP BY 1,2,3" for p in PHASES), "mol")
def _(spark, sf):
    return D.phase_counts(V.molecules(spark, sf), PHASES)


PAIRS = [("input", "group"), ("group", "finalize"), ("input", "finalize")]


@query("phase_transitions", " UNION ALL ".join(
    f"SELECT '{a}->{b}' AS transition, {CLS.format('etype_at_' + a)} AS src, {CLS.format('etype_at_' + b)} AS dst, count(*) AS n FROM mol GROUP BY 1,2,3"
    for a, b in PAIRS), "mol")
def _(spark, sf):
    return D.phase_transitions(V.molecules(spark, sf), PAIRS)


FATE_SQL = """WITH w AS (SELECT *, etype_at_input AS i, etype_at_finalize AS o, entity_id = owner_out AS same FROM mol),
q AS (SELECT unnest([
 {'quantity': 'total', 'n': count(*)}, {'quantity': 'in_orig_cell', 'n': count(*) FILTER (i=0)},
 {'quantity': 'in_unassigned', 'n': count(*) FILTER (i=3)}, {'quantity': 'out_orig_cell', 'n': count(*) FILTER (o=0)},
 {'quantity': 'out_partial', 'n': count(*) FILTER (o=1)}, {'quantity': 'out_neighboring', 'n': count(*) FILTER (o=5)},
 {'quantity': 'out_unassigned', 'n': count(*) FILTER (o=3)},
 {'quantity': 'redistributed', 'n': count(*) FILTER (i=0 AND o IN (0,1,5) AND NOT same)},
 {'quantity': 'kept_in_place', 'n': count(*) FILTER (i=0 AND o IN (0,1,5) AND same)},
 {'quantity': 'recovered_from_unassigned', 'n': count(*) FILTER (i=3 AND o IN (0,1,5))},
 {'quantity': 'unassigned_to_partial', 'n': count(*) FILTER (i=3 AND o=1)},
 {'quantity': 'unassigned_to_cell', 'n': count(*) FILTER (i=3 AND o=0)},
 {'quantity': 'origcell_to_partial', 'n': count(*) FILTER (i=0 AND o=1)},
 {'quantity': 'lost_to_unassigned', 'n': count(*) FILTER (i=0 AND o=3)}]) AS s, count(*) AS total FROM w)
SELECT s.quantity AS quantity, s.n AS n, round(100.0 * s.n / total, 6) AS pct_of_total FROM q"""


@query("molecule_fate", FATE_SQL, "mol")
def _(spark, sf):
    return r(D.molecule_fate(V.molecules(spark, sf)), 6, "pct_of_total")


@query("count_matrix", "SELECT entity_id, feature, count(*) AS count FROM mol GROUP BY 1,2", "mol")
def _(spark, sf):
    return D.count_matrix(V.molecules(spark, sf))


CENTROID_SQL = "SELECT entity_id, round(avg(x) + 1e-8, 5) AS x, round(avg(y) + 1e-8, 5) AS y, count(*) AS n_tx FROM mol GROUP BY 1"


@query("centroids", CENTROID_SQL, "mol")
def _(spark, sf):
    return settle(D.centroids(V.molecules(spark, sf)), 5, "x", "y")


@query("pool_weighted", """SELECT sample, cell_type, round(sum(v * n) / sum(n), 6) AS value, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT sample, cell_type, etype, avg(confidence) AS v, count(*) AS n FROM ent GROUP BY 1,2,3)
  GROUP BY 1,2 HAVING count(DISTINCT etype) = 2""", "ent")
def _(spark, sf):
    g = V.entities(spark, sf).groupBy("sample", "cell_type", "etype").agg(F.avg("confidence").alias("value"), D.n_rows().alias("n"))
    return r(D.pool_weighted(g, ["sample", "cell_type"], "etype", "value", "n"), 6, "value")


@query("equal_weight_mean", """SELECT cell_type, round(avg(v), 6) AS value, count(DISTINCT sample) AS n_units, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT sample, cell_type, avg(confidence) AS v, count(*) AS n FROM ent GROUP BY 1,2) GROUP BY 1""", "ent")
def _(spark, sf):
    g = V.entities(spark, sf).groupBy("sample", "cell_type").agg(F.avg("confidence").alias("value"), D.n_rows().alias("n"))
    return r(D.equal_weight_mean(g, "cell_type", "sample", "value", "n"), 6, "value")


@query("depth_summary", """SELECT cell_type, etype, count(*) AS n, CAST(sum(n_tx) AS BIGINT) AS total, quantile_cont(CAST(n_tx AS DOUBLE), 0.5) AS median,
  quantile_cont(CAST(n_tx AS DOUBLE), 0.25) AS q25, quantile_cont(CAST(n_tx AS DOUBLE), 0.75) AS q75 FROM ent GROUP BY 1,2""", "ent")
def _(spark, sf):
    return D.depth_summary(V.entities(spark, sf), ["cell_type", "etype"], "n_tx")


@query("composition_without", """SELECT cell_type, n AS n_full, w AS n_without, round(n / sum(n) OVER (), 6) AS frac_full, round(w / sum(w) OVER (), 6) AS frac_without,
  round((n - w) / CAST(n AS DOUBLE), 6) AS contributed FROM (SELECT cell_type, count(*) AS n, count(*) FILTER (sample <> 3) AS w FROM ent GROUP BY 1)""", "ent")
def _(spark, sf):
    return r(D.composition_without(V.entities(spark, sf), "cell_type", "sample", 3), 6, "frac_full", "frac_without", "contributed")


@query("area_density", f"""WITH {ARM_SQL}, area AS (SELECT sample, count(*) * 0.01 AS area_mm2 FROM (
   SELECT DISTINCT sample, floor(x/100.0), floor(y/100.0) FROM ent) GROUP BY 1)
 SELECT sample, arm, n_T, n_TAM, round(CAST(area_mm2 AS DOUBLE), 6) AS area_mm2, round(n_T / CAST(area_mm2 AS DOUBLE), 6) AS T_per_mm2,
   round(n_TAM / CAST(area_mm2 AS DOUBLE), 6) AS TAM_per_mm2
 FROM (SELECT sample, arm, count(*) FILTER (cell_type='T') AS n_T, count(*) FILTER (cell_type='TAM') AS n_TAM FROM armed GROUP BY 1,2) JOIN area USING (sample)""", "ent")
def _(spark, sf):
    return r(D.area_density(V.entities(spark, sf), arms(), {"T": "T", "TAM": "TAM"}), 6, "area_mm2", "T_per_mm2", "TAM_per_mm2")


def evaluable(spark, sf):
    return D.axis_evaluable(D.arm_rows(V.entities(spark, sf), arms()), AXES, ["sample", "arm"], 18)


@query("axis_evaluable", f"WITH {AXIS_SQL} SELECT * FROM evaluable", "ent")
def _(spark, sf):
    return evaluable(spark, sf)


MATRIX_SQL = f"""WITH {AXIS_SQL}, w AS (SELECT axis, sample, coalesce(bool_or(evaluable) FILTER (arm='pre'), false) AS pre, coalesce(bool_or(evaluable) FILTER (arm='post_whole'), false) AS wh,
  coalesce(bool_or(evaluable) FILTER (arm='post_all'), false) AS al, max(n_anchor_pos) FILTER (arm='pre') AS ap, max(n_anchor_pos) FILTER (arm='post_whole') AS aw FROM evaluable GROUP BY 1,2),
 cat AS (SELECT axis, sample, CASE WHEN pre AND wh AND aw >= 2 * GREATEST(ap, 1) THEN 'strengthened post' WHEN pre AND wh THEN 'visible pre'
  WHEN NOT pre AND wh THEN 'enabled post-whole' WHEN NOT pre AND NOT wh AND al THEN 'enabled by partials'
  WHEN pre AND NOT wh AND NOT al THEN 'visible pre' ELSE 'unsupported' END AS category FROM w)"""


@query("classify_axis", MATRIX_SQL + " SELECT axis, sample, category FROM cat", "ent")
def _(spark, sf):
    return D.axis_matrix(evaluable(spark, sf)).select("axis", "sample", "category")


@query("axis_matrix", MATRIX_SQL + """ SELECT axis, max(category) FILTER (sample=0) AS "0", max(category) FILTER (sample=1) AS "1", max(category) FILTER (sample=2) AS "2",
  max(category) FILTER (sample=3) AS "3", max(category) FILTER (sample=4) AS "4", any_value(m) AS median_anchor
  FROM cat JOIN (SELECT axis, quantile_cont(CAST(n_anchor_pos AS DOUBLE), 0.5) AS m FROM evaluable WHERE arm='post_all' GROUP BY 1) USING (axis) GROUP BY 1""", "ent")
def _(spark, sf):
    m = D.axis_matrix(evaluable(spark, sf))
    return m.groupBy("axis", "median_anchor").pivot("sample", list(range(5))).agg(F.max("category"))


@query("distance_summary", """SELECT cell_type, count(confidence) AS n, round(avg(confidence), 6) AS mean, round(quantile_cont(confidence, 0.5), 6) AS median,
  round(quantile_cont(confidence, 0.25), 6) AS q25, round(quantile_cont(confidence, 0.75), 6) AS q75 FROM ent GROUP BY 1""", "ent")
def _(spark, sf):
    return r(D.distance_summary(V.entities(spark, sf), "cell_type", "confidence"), 6, "mean", "median", "q25", "q75")


@query("binned_trend", """WITH b AS (SELECT *, CASE WHEN x < 0 OR x > 400 THEN NULL WHEN x = 400 THEN 4
   ELSE (CASE WHEN x >= 25 THEN 1 ELSE 0 END + CASE WHEN x >= 50 THEN 1 ELSE 0 END + CASE WHEN x >= 100 THEN 1 ELSE 0 END + CASE WHEN x >= 200 THEN 1 ELSE 0 END) END AS bin FROM ent),
 qc AS (SELECT list_distinct([quantile_cont(x, i/5.0) FOR i IN [0,1,2,3,4,5]]) AS c FROM (SELECT 1)),
 c AS (SELECT quantile_cont(x,0.0) c0, quantile_cont(x,0.2) c1, quantile_cont(x,0.4) c2, quantile_cont(x,0.6) c3, quantile_cont(x,0.8) c4, quantile_cont(x,1.0) c5 FROM ent),
 qb AS (SELECT ent.*, CASE WHEN x <= c1 THEN 0 WHEN x <= c2 THEN 1 WHEN x <= c3 THEN 2 WHEN x <= c4 THEN 3 ELSE 4 END AS bin, c.* FROM ent CROSS JOIN c)
SELECT 'edges' AS kind, bin, CAST([0,25,50,100,200][bin+1] AS DOUBLE) AS lo, CAST([25,50,100,200,400][bin+1] AS DOUBLE) AS hi, round(avg(confidence) + 1e-8, 6) AS mean,
  round(stddev_samp(confidence)/sqrt(count(*)), 6) AS sem, count(*) AS n FROM b WHERE bin IS NOT NULL GROUP BY bin
UNION ALL SELECT 'quantiles', bin, round(any_value([c0,c1,c2,c3,c4][bin+1]), 6), round(any_value([c1,c2,c3,c4,c5][bin+1]), 6), round(avg(confidence) + 1e-8, 6), round(stddev_samp(confidence)/sqrt(count(*)), 6), count(*)
  FROM qb GROUP BY bin""".replace(" qc AS (SELECT list_distinct([quantile_cont(x, i/5.0) FOR i IN [0,1,2,3,4,5]]) AS c FROM (SELECT 1)),\n", ""), "ent")
def _(spark, sf):
    e = V.entities(spark, sf)
    a = D.binned_trend(e, "x", "confidence", edges=[0, 25, 50, 100, 200, 400]).withColumn("kind", F.lit("edges"))
    b = D.binned_trend(e, "x", "confidence", q=5).withColumn("kind", F.lit("quantiles"))
    return settle(r(a.unionByName(b), 6, "lo", "hi", "sem"), 6, "mean")


@query("grid_domains", """SELECT sample, cell_type, n, CAST(t AS BIGINT) AS n_bin, round(n / CAST(t AS DOUBLE), 6) AS fraction, bx*25+12.5 AS cx, b*25+12.5 AS cy FROM (
  SELECT *, sum(n) OVER (PARTITION BY sample, bx, b) AS t FROM (SELECT sample, floor(x/25) AS bx, floor(y/25) AS b, cell_type, count(*) AS n FROM ent GROUP BY ALL))
  WHERE n / CAST(t AS DOUBLE) >= 0.25""", "ent")
def _(spark, sf):
    return r(D.grid_domains(V.entities(spark, sf)), 6, "fraction")


@query("row_centre", """SELECT entity_id, round(confidence - m, 6) AS centred FROM ent JOIN (SELECT sample, cell_type, quantile_cont(confidence, 0.5) AS m FROM ent GROUP BY 1,2) USING (sample, cell_type)""", "ent")
def _(spark, sf):
    return r(D.row_centre(V.entities(spark, sf), ["sample", "cell_type"], "confidence"), 6, "centred").select("entity_id", "centred")


@query("pivot_wide", """SELECT cell_type, round(c, 6) AS cell, round(p, 6) AS partial, round(p - c, 6) AS partial_minus_cell FROM (
  SELECT cell_type, avg(n_tx) FILTER (etype='cell') AS c, avg(n_tx) FILTER (etype='partial') AS p FROM ent GROUP BY 1)""", "ent")
def _(spark, sf):
    return r(D.pivot_wide(V.entities(spark, sf), "cell_type", "etype", "n_tx", ["cell", "partial"], ("partial", "cell")),
             6, "cell", "partial", "partial_minus_cell")


@query("zscore_by", """SELECT sample, cell_type, round(CASE WHEN s = 0 OR s IS NULL THEN 0 ELSE (v - m)/s END, 6) AS z FROM (
  SELECT *, avg(v) OVER (PARTITION BY cell_type) AS m, stddev_samp(v) OVER (PARTITION BY cell_type) AS s
  FROM (SELECT sample, cell_type, avg(n_tx) AS v FROM ent GROUP BY 1,2))""", "ent")
def _(spark, sf):
    g = V.entities(spark, sf).groupBy("sample", "cell_type").agg(F.avg("n_tx").alias("v"))
    return r(D.zscore_by(g, "cell_type", "v"), 6, "z").select("sample", "cell_type", "z")


@query("robust_limits", """SELECT sample, round(x0-(x1-x0)*0.03,6) AS x_lo, round(x1+(x1-x0)*0.03,6) AS x_hi, round(y0-(y1-y0)*0.03,6) AS y_lo, round(y1+(y1-y0)*0.03,6) AS y_hi FROM (
 SELECT sample, quantile_cont(x,0.002) x0, quantile_cont(x,0.998) x1, quantile_cont(y,0.002) y0, quantile_cont(y,0.998) y1 FROM ent GROUP BY 1)""", "ent")
def _(spark, sf):
    return r(D.robust_limits(V.entities(spark, sf), ["x", "y"], by="sample"), 6, "x_lo", "x_hi", "y_lo", "y_hi")


@query("histogram", """WITH b AS (SELECT cell_type, CASE WHEN x = 300 THEN 11 ELSE CAST(floor(x/25) AS INT) END AS bin FROM ent WHERE x >= 0 AND x <= 300)
SELECT cell_type, bin, bin*25.0 AS lo, n, round(n / CAST(sum(n) OVER (PARTITION BY cell_type) AS DOUBLE) / 25, 9) AS density FROM (SELECT cell_type, bin, count(*) AS n FROM b GROUP BY 1,2)""".replace("bin*25.0 AS lo", "CAST(bin*25 AS DOUBLE) AS lo"), "ent")
def _(spark, sf):
    return r(D.histogram(V.entities(spark, sf), "cell_type", "x", [25.0 * i for i in range(13)]), 9, "density")


@query("support_cut", """SELECT entity_id, sample, n_tx, cut FROM (SELECT *, quantile_cont(CAST(n_tx AS DOUBLE), 0.75) OVER (PARTITION BY sample) AS cut FROM ent WHERE etype='partial') WHERE n_tx >= cut""", "ent")
def _(spark, sf):
    return D.support_cut(V.entities(spark, sf), "sample", "n_tx", eligible=F.col("etype") == "partial").select("entity_id", "sample", "n_tx", "cut")


@query("kde_reflected", """WITH st AS (SELECT method, count(*) AS n, stddev_samp(max_weight) * pow(count(*), -0.2) AS h FROM calls GROUP BY 1 HAVING count(*) >= 5)
SELECT method, i, round(i/399.0, 9) AS "at", round(sum(exp(-0.5*pow((i/399.0-max_weight)/h,2)) + exp(-0.5*pow((-i/399.0-max_weight)/h,2)) + exp(-0.5*pow((2-i/399.0-max_weight)/h,2)))
  / any_value(n*h*sqrt(2*pi())), 6) AS density FROM calls JOIN st USING (method), (SELECT CAST(range AS INT) AS i FROM range(400)) GROUP BY 1,2""", "calls")
def _(spark, sf):
    return r(D.kde_reflected(V.calls(spark, sf), "method", "max_weight", 0.0, 1.0, 0.0, 1.0), 6, "density").withColumn("at", F.round("at", 9))


# --- calls -------------------------------------------------------------------------------------------

LEVELS = ["F", "O", "P", "X", "unscored"]


@query("call_composition", """SELECT setting, method, l AS call, count(c.cell_id) AS n FROM (SELECT DISTINCT setting, method FROM calls) g CROSS JOIN (VALUES ('F'),('O'),('P'),('X'),('unscored')) v(l)
 LEFT JOIN (SELECT setting, method, cell_id, coalesce(call,'unscored') AS cl FROM calls) c USING (setting, method) WHERE cl = l GROUP BY 1,2,3
 UNION ALL SELECT DISTINCT setting, method, 'X', 0 FROM calls""", "calls")
def _(spark, sf):
    return C.call_composition(V.calls(spark, sf), LEVELS)


SUMMARY_SQL = """summ AS (SELECT setting, method, count(*) AS n_entities, count(call) AS n_scored, round(1 - count(call)/CAST(count(*) AS DOUBLE), 6) AS frac_unscored,
  count(*) FILTER (call='F') AS n_singlet, round(count(*) FILTER (call='F')/CAST(count(*) AS DOUBLE), 6) AS singlet_frac_of_entities,
  round(quantile_cont(max_weight, 0.5) FILTER (call IS NOT NULL), 6) AS max_weight_median, round(quantile_cont(entropy, 0.5) FILTER (call IS NOT NULL), 6) AS entropy_median FROM calls GROUP BY 1,2)"""


def summary(spark, sf):
    return C.method_summary(V.calls(spark, sf), "F")


@query("method_summary", f"WITH {SUMMARY_SQL} SELECT * FROM summ", "calls")
def _(spark, sf):
    return r(summary(spark, sf), 6, "frac_unscored", "singlet_frac_of_entities", "max_weight_median", "entropy_median")


@query("choose_best", f"""WITH {SUMMARY_SQL} SELECT setting, method, n_singlet, row_number() OVER (PARTITION BY setting ORDER BY n_singlet DESC, method) = 1 AS chosen FROM summ""", "calls")
def _(spark, sf):
    return C.choose_best(summary(spark, sf)).select("setting", "method", "n_singlet", "chosen")


@query("arm_counts", """WITH b AS (SELECT sample AS arm, cell_type AS label, * EXCLUDE (cell_type) FROM ent UNION ALL SELECT sample, 'ALL', * EXCLUDE (cell_type) FROM ent)
SELECT arm, label, count(*) AS n, round(avg(confidence),6) AS mean_conf, round(avg(CASE WHEN confidence<0.4 THEN 1.0 ELSE 0.0 END),6) AS low_conf_frac,
  quantile_cont(CAST(n_tx AS DOUBLE),0.5) AS median_tx, round(count(*)/CAST(any_value(t) AS DOUBLE),6) AS frac_of_arm FROM b JOIN (SELECT sample AS arm, count(*) AS t FROM ent GROUP BY 1) USING (arm) GROUP BY 1,2""", "ent")
def _(spark, sf):
    e = V.entities(spark, sf).withColumnsRenamed({"sample": "arm", "cell_type": "label"})
    return r(C.arm_counts(e), 6, "mean_conf", "low_conf_frac", "frac_of_arm")


def long_metrics(spark, sf):
    s = summary(spark, sf)
    return s.select("setting", "method", F.explode(F.create_map(
        F.lit("max_weight_median"), F.col("max_weight_median"), F.lit("entropy_median"), F.col("entropy_median"),
        F.lit("frac_unscored"), F.col("frac_unscored"))).alias("metric", "value"))


LONG_SQL = """m0 AS (SELECT setting, method, quantile_cont(max_weight, 0.5) FILTER (call IS NOT NULL) AS max_weight_median, quantile_cont(entropy, 0.5) FILTER (call IS NOT NULL) AS entropy_median,
  1 - count(call)/CAST(count(*) AS DOUBLE) AS frac_unscored FROM calls GROUP BY 1,2),
 lm AS (UNPIVOT m0 ON max_weight_median, entropy_median, frac_unscored INTO NAME metric VALUE value),
 dl AS (SELECT a.setting, a.method, a.metric, a.value - b.value AS d FROM lm a JOIN lm b ON a.setting=b.setting AND a.metric=b.metric AND b.method='AFRICA' WHERE a.method<>'AFRICA')"""
FLIP_SQL = """flips AS (SELECT {k}, m, abs(sum(d * CASE WHEN (m >> (i-1)) & 1 = 1 THEN 1 ELSE -1 END))/count(*) AS v, abs(sum(d))/count(*) AS obs
  FROM (SELECT {k}, d, row_number() OVER (PARTITION BY {k} ORDER BY {o}) AS i FROM dl), range(32) t(m) GROUP BY ALL)"""


@query("paired_vs_baseline", f"""WITH {LONG_SQL}, {FLIP_SQL.format(k='method, metric', o='setting')}
SELECT method, metric, count(*) AS n_units, round(median(d),6) AS median_delta, round(min(d),6) AS min_delta, round(max(d),6) AS max_delta, count(*) FILTER (d>0) AS n_positive, any_value(p) AS p
FROM dl JOIN (SELECT method, metric, avg(CASE WHEN v >= obs - 1e-12 THEN 1.0 ELSE 0.0 END) AS p FROM flips GROUP BY 1,2) USING (method, metric) GROUP BY 1,2""", "calls")
def _(spark, sf):
    return r(C.paired_vs_baseline(long_metrics(spark, sf), "AFRICA"), 6, "median_delta", "min_delta", "max_delta")


@query("signflip_exact", f"""WITH {LONG_SQL}, {FLIP_SQL.format(k='method, metric', o='setting')}
SELECT method, metric, n, p FROM (SELECT method, metric, avg(CASE WHEN v >= obs - 1e-12 THEN 1.0 ELSE 0.0 END) AS p FROM flips GROUP BY 1,2)
JOIN (SELECT method, metric, count(*) AS n FROM dl GROUP BY 1,2) USING (method, metric)""", "calls")
def _(spark, sf):
    m = long_metrics(spark, sf)
    base = m.where("method = 'AFRICA'").select("setting", "metric", F.col("value").alias("b"))
    d = m.where("method <> 'AFRICA'").join(base, ["setting", "metric"]).withColumn("d", F.col("value") - F.col("b"))
    return T.signflip_exact(d, ["method", "metric"], "d")


@query("pooled_stratum", """SELECT method, count(*) AS n, round(avg(max_weight),6) AS mean_weight FROM (SELECT method, max_weight FROM calls
 UNION ALL SELECT 'pooled', max_weight FROM calls WHERE method IN ('ASIA','EUROPE')) GROUP BY 1""", "calls")
def _(spark, sf):
    p = C.pooled_stratum(V.calls(spark, sf), ["ASIA", "EUROPE"], "pooled")
    return p.groupBy("method").agg(D.n_rows().alias("n"), F.round(F.avg("max_weight"), 6).alias("mean_weight"))


@query("reproduction_gate", """SELECT count(*) FILTER (a.v IS NOT NULL AND b.v IS NOT NULL) AS n_compared, count(*) FILTER (a.v IS NULL OR b.v IS NULL) AS n_missing, round(max(abs(a.v-b.v)),9) AS max_abs_diff,
  count(*) FILTER (a.v IS NULL OR b.v IS NULL) = 0 AND max(abs(a.v-b.v)) < 1e-5 AS passed
 FROM (SELECT setting, method, avg(max_weight) AS v FROM calls GROUP BY 1,2) a FULL JOIN (SELECT setting, method, round(avg(max_weight),4) AS v FROM calls GROUP BY 1,2) b USING (setting, method)""", "calls")
def _(spark, sf):
    got = V.calls(spark, sf).groupBy("setting", "method").agg(F.avg("max_weight").alias("v"))
    return r(C.reproduction_gate(got, got.withColumn("v", F.round("v", 4)), ["setting", "method"], "v"), 9, "max_abs_diff")


@query("resource_table", """SELECT l_returnflag AS method, round(sum(l_quantity)/3600,6) AS wall_h, round(max(l_extendedprice)/1000,6) AS host_rss_gib, CAST(100 AS DOUBLE) AS host_req_gib,
  round(sum(l_tax)/1024,6) AS gpu_vram_gib, max(l_extendedprice)/1000 > 100 AS over_request FROM lineitem GROUP BY 1""")
def _(spark, sf):
    u = V.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("method")).agg(
        F.sum("l_quantity").alias("wall_clock_seconds"), (F.max("l_extendedprice") / 1000).alias("peak_host_rss_gb"),
        F.lit(100.0).alias("host_memory_requested_gb"), F.sum("l_tax").alias("peak_gpu_vram_mb"))
    return r(C.resource_table(u), 6, "wall_h", "host_rss_gib", "gpu_vram_gib")


@query("log_attempts", r"""WITH s AS (SELECT lang, unnest(regexp_extract_all(text, '\b([A-Z][a-z]+) [a-z]', 1)) AS process FROM documents),
 g AS (SELECT lang, unnest(regexp_extract_all(text, '\b([A-Z][a-z]+)[.,;]', 1)) AS process FROM documents),
 a AS (SELECT lang, unnest(regexp_extract_all(text, '\b([A-Z][a-z]+)\D{0,3}([0-9]{1,4})\b', 1)) AS process, unnest(regexp_extract_all(text, '\b([A-Z][a-z]+)\D{0,3}([0-9]{1,4})\b', 2)) AS n FROM documents)
SELECT lang, process, CAST(max(n) + 1 AS INT) AS attempts, CASE WHEN bool_or(x) THEN 'failed' ELSE 'success' END AS status FROM (
 SELECT lang, process, 0 AS n, false AS x FROM s UNION ALL SELECT lang, process, 0, true FROM g UNION ALL SELECT lang, process, CAST(n AS INT), false FROM a) GROUP BY 1,2""")
def _(spark, sf):
    d = V.table(spark, sf, "documents").select("lang", "text")
    return C.log_attempts(d, r"\b([A-Z][a-z]+) [a-z]", r"\b([A-Z][a-z]+)\D{0,3}([0-9]{1,4})\b", r"\b([A-Z][a-z]+)[.,;]", "text", "lang")


@query("tidy_metrics", """SELECT setting, CASE WHEN method IN ('ASIA','EUROPE') AND method='EUROPE' THEN 'EU' ELSE method END AS method, 'n_scored' AS metric, CAST(count(call) AS DOUBLE) AS value FROM calls GROUP BY 1,2
 UNION ALL SELECT setting, CASE WHEN method='EUROPE' THEN 'EU' ELSE method END, 'n_entities', CAST(count(*) AS DOUBLE) FROM calls GROUP BY 1,2""", "calls")
def _(spark, sf):
    long = summary(spark, sf).select("setting", "method", F.explode(F.create_map(
        F.lit("n_scored"), F.col("n_scored").cast("double"), F.lit("n_entities"), F.col("n_entities").cast("double"),
        F.lit("n_singlet"), F.col("n_singlet").cast("double"))).alias("metric", "value"))
    return C.tidy_metrics(long.unionByName(long), ["n_scored", "n_entities"], {"EUROPE": "EU"})


# --- tests -------------------------------------------------------------------------------------------

@query("bh_adjust", """WITH p AS (SELECT entity_id, sample, CASE WHEN n_tx > 200 THEN NULL ELSE confidence * confidence END AS p FROM ent),
 a AS (SELECT *, p * count(p) OVER (PARTITION BY sample) / count(p) OVER (PARTITION BY sample ORDER BY p RANGE UNBOUNDED PRECEDING) AS adj FROM p WHERE p IS NOT NULL)
SELECT p.entity_id, p.sample, CASE WHEN m IS NOT NULL THEN round(LEAST(1.0, m), 9) END AS q FROM p LEFT JOIN (SELECT entity_id, min(adj) OVER (PARTITION BY sample ORDER BY p DESC RANGE UNBOUNDED PRECEDING) AS m FROM a) USING (entity_id)""", "ent")
def _(spark, sf):
    e = V.entities(spark, sf).select("entity_id", "sample", F.when(F.col("n_tx") <= 200, F.col("confidence") * F.col("confidence")).alias("p"))
    return r(T.bh_adjust(e, "p", "sample"), 9, "q").select("entity_id", "sample", "q")


U_SQL = """u AS (SELECT sample, count(*) FILTER (lig=1) AS n_a, count(*) FILTER (lig=0) AS n_b, sum(CASE WHEN lig=1 THEN rk END) - count(*) FILTER (lig=1)*(count(*) FILTER (lig=1)+1)/2.0 AS u FROM (
  SELECT sample, lig, avg(rn) OVER (PARTITION BY sample, n_tx) AS rk FROM (SELECT sample, lig, n_tx, row_number() OVER (PARTITION BY sample ORDER BY n_tx) AS rn FROM ent)) GROUP BY 1)"""


@query("mann_whitney", f"WITH {U_SQL} SELECT sample, n_a, n_b, round(CAST(u AS DOUBLE),3) AS u, round(2.0*u/n_a/n_b-1,6) AS rank_biserial, 'asymptotic' AS method FROM u", "ent")
def _(spark, sf):
    # the p value needs a normal tail SQL lacks; it is tested on a fixture
    return r(T.mann_whitney(V.entities(spark, sf), "sample", "n_tx", "lig", 1).drop("p"), 6, "rank_biserial").withColumn("u", F.round("u", 3))


SMALL_SQL = "s AS (SELECT CAST(FLOOR(entity_id / 11.0) AS BIGINT) AS stratum, lig, y FROM ent)"


@query("mann_whitney_exact", f"""WITH {SMALL_SQL}, ways AS (WITH RECURSIVE w(m, n, u, c) AS (SELECT 0, 0, 0, CAST(1 AS BIGINT)
  UNION ALL SELECT m + t.a, n + 1 - t.a, u + t.a * n, CAST(sum(c) AS BIGINT) FROM w, (VALUES (0), (1)) t(a) WHERE m + n < 11 GROUP BY 1, 2, 3) SELECT * FROM w),
 k AS (SELECT stratum, count(*) FILTER (lig=1) AS n_a, count(*) FILTER (lig=0) AS n_b FROM s GROUP BY 1),
 o AS (SELECT k.*, (SELECT count(*) FROM s a JOIN s b ON a.stratum = b.stratum WHERE a.stratum = k.stratum AND a.lig = 1 AND b.lig = 0 AND a.y > b.y) AS u FROM k)
SELECT stratum, o.n_a, o.n_b, CAST(o.u AS DOUBLE) AS u, CASE WHEN o.n_a * o.n_b > 0 THEN round(2.0*o.u/o.n_a/o.n_b-1,6) END AS rank_biserial, CASE WHEN o.n_a * o.n_b > 0 THEN round(sum(c) FILTER (w.u >= o.u) / CAST(sum(c) AS DOUBLE), 12) END AS p, 'exact' AS method
FROM o JOIN ways w ON w.m = o.n_a AND w.n = o.n_b GROUP BY stratum, o.n_a, o.n_b, o.u""", "ent")
def _(spark, sf):
    s = V.entities(spark, sf).withColumn("stratum", F.floor(F.col("entity_id") / 11.0).cast("long"))
    return r(r(T.mann_whitney(s, "stratum", "y", "lig", 1), 6, "rank_biserial"), 12, "p")


NATION_SQL = """g AS (SELECT o_orderpriority AS setting, c_nationkey AS unit, avg(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
 d AS (SELECT a.setting, row_number() OVER (PARTITION BY a.setting ORDER BY a.unit) AS i, a.v - b.v AS d FROM g a JOIN g b ON a.unit = b.unit AND b.setting = '1-URGENT' WHERE a.setting <> '1-URGENT')"""


@query("signflip_halves", f"""WITH {NATION_SQL}, t AS (SELECT setting, count(*) AS n, abs(sum(d)) - 1e-12 * count(*) AS t FROM d GROUP BY 1),
 l AS (SELECT setting, m, sum(d * CASE WHEN (m >> (i - 1)) & 1 = 1 THEN 1 ELSE -1 END) AS s FROM d, range(4096) r(m) WHERE i <= 12 GROUP BY ALL),
 h AS (SELECT setting, m, sum(d * CASE WHEN (m >> (i - 13)) & 1 = 1 THEN 1 ELSE -1 END) AS s FROM d, range(8192) r(m) WHERE i > 12 GROUP BY ALL)
SELECT t.setting, t.n, count(*) FILTER (abs(l.s + h.s) >= t.t) / 33554432.0 AS p FROM t JOIN l USING (setting) JOIN h USING (setting) GROUP BY ALL""")
def _(spark, sf):
    o = V.table(spark, sf, "orders").join(V.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    g = o.groupBy(F.col("o_orderpriority").alias("setting"), F.col("c_nationkey").alias("unit")).agg(F.avg("o_totalprice").alias("v"))
    base = g.where("setting = '1-URGENT'").select("unit", F.col("v").alias("b"))
    return T.signflip_exact(g.where("setting <> '1-URGENT'").join(base, "unit").withColumn("d", F.col("v") - F.col("b")), "setting", "d")


@query("rank_correlation_kendall", """WITH s AS (SELECT a.sample, sum(sign(a.n_tx - b.n_tx) * sign(a.confidence - b.confidence)) AS s, count(*) AS all_pairs, count(*) FILTER (a.n_tx <> b.n_tx) AS dx, count(*) FILTER (a.confidence <> b.confidence) AS dy
  FROM ent a JOIN ent b ON a.sample = b.sample AND a.entity_id < b.entity_id GROUP BY 1)
SELECT sample, n, round(s / (sqrt(CAST(dx AS DOUBLE)) * sqrt(CAST(dy AS DOUBLE))), 9) AS kendall FROM s JOIN (SELECT sample, count(*) AS n FROM ent GROUP BY 1) USING (sample)""", "ent")
def _(spark, sf):
    return r(T.rank_correlation(V.entities(spark, sf), "n_tx", "confidence", "kendall", "sample"), 9, "kendall")


@query("cliffs_delta", f"WITH {U_SQL} SELECT sample, n_a, n_b, round(2.0*u/n_a/n_b-1,6) AS delta FROM u", "ent")
def _(spark, sf):
    return r(T.cliffs_delta(V.entities(spark, sf), "sample", "n_tx", "lig", 1), 6, "delta")


@query("auroc", f"WITH {U_SQL} SELECT sample, n_a AS n_pos, n_b AS n_neg, round(u/CAST(n_a AS DOUBLE)/n_b,6) AS auroc FROM u", "ent")
def _(spark, sf):
    return r(T.auroc(V.entities(spark, sf), "n_tx", F.col("lig") == 1, "sample"), 6, "auroc")


@query("sign_test", "SELECT sample, count(*) FILTER (confidence > 0.5) AS n_positive, count(*) FILTER (confidence <> 0.5) AS n_nonzero FROM ent GROUP BY 1", "ent")
def _(spark, sf):
    d = V.entities(spark, sf).select("sample", (F.col("confidence") - 0.5).alias("d"))
    return T.sign_test(d, "sample", "d").drop("p")


@query("sign_test_p")
def _(spark, sf):
    d = V.entities(spark, sf).select("sample", (F.col("confidence") - 0.5).alias("d"))
    return T.sign_test(d, "sample", "d")


@query("rank_correlation", """WITH k AS (SELECT sample, avg(a) OVER (PARTITION BY sample, n_tx) AS ra, avg(b) OVER (PARTITION BY sample, confidence) AS rb FROM (
  SELECT *, row_number() OVER (PARTITION BY sample ORDER BY n_tx) AS a, row_number() OVER (PARTITION BY sample ORDER BY confidence) AS b FROM ent))
 SELECT sample, n, spearman, pearson FROM (SELECT sample, count(*) AS n, round(corr(ra, rb),6) AS spearman FROM k GROUP BY 1) JOIN (SELECT sample, round(corr(n_tx, confidence),6) AS pearson FROM ent GROUP BY 1) USING (sample)""", "ent")
def _(spark, sf):
    e = V.entities(spark, sf)
    s = T.rank_correlation(e, "n_tx", "confidence", "spearman", "sample")
    p = T.rank_correlation(e, "n_tx", "confidence", "pearson", "sample").drop("n")
    return r(s.join(p, "sample"), 6, "spearman", "pearson")


@query("cohort_meta")
def _(spark, sf):
    g = V.entities(spark, sf).groupBy("sample", "cell_type").agg(
        (F.avg("n_tx") / 105.0).alias("enrich"), F.avg("confidence").alias("p"))
    return T.cohort_meta(g, "enrich", "p", "cell_type")
