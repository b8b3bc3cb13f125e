"""Checked queries: scans, filters, joins, windows and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hash_hex, stars
from ..functions.durable import fresh_path
from ..operators import entities as E, windows as G
from ..sources import sinks, tables as A
from . import views as V
from .registry import query


@query("scan_entities", "SELECT event_id AS entity_id, value AS x, event_type FROM events")
def _(spark, sf):
    return A.scan_entities(spark, f"{sf}/events.parquet", ["event_id", "value", "event_type"]) \
        .withColumnsRenamed({"event_id": "entity_id", "value": "x"})


@query("scan_arm", "SELECT 'post_all' AS arm, * FROM ent UNION ALL SELECT 'post_whole', * FROM ent WHERE etype = 'cell'", "ent")
def _(spark, sf):
    e, root = V.entities(spark, sf), fresh_path(spark, "arms")
    for arm in ("post_whole", "post_partial"):
        A.arm_of(e, arm).write.parquet(f"{root}/all_{arm}_spatial.parquet")
    return G.union_arms(*[A.scan_arm(spark, root, a) for a in ("post_all", "post_whole")])


@query("scan_molecules", "SELECT l_orderkey, l_extendedprice, l_quantity FROM lineitem")
def _(spark, sf):
    return A.scan_molecules(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_extendedprice", "l_quantity"])


@query("scan_window", "SELECT entity_id, cell_type, x, y FROM ent WHERE x >= 10 AND x < 60 AND y >= 100 AND y < 400 AND etype = 'cell'", "ent")
def _(spark, sf):
    return A.scan_window(V.entities(spark, sf), (10, 100, 60, 400), ["etype = 'cell'"]) \
        .select("entity_id", "cell_type", "x", "y")


@query("read_manifest", "SELECT event_id, CAST(json_extract_string(props,'$.k') AS INT) AS k FROM events")
def _(spark, sf):
    return A.read_manifest(V.table(spark, sf, "events"), "props", "struct<k:int>", keep="event_id")


@query("explode_profiles", """
SELECT vec_id AS entity_id, 'f' || CAST(i - 1 AS VARCHAR) AS feature, round(CAST(embedding[i] AS DOUBLE), 6) AS count
FROM embeddings, generate_series(1, 64) t(i) WHERE i <= 40 AND embedding[i] > 0""")
def _(spark, sf):
    p = V.profiles(spark, sf)
    # positive components stand for the stored values of a sparse row
    sparse = p.select(F.col("vec_id").alias("entity_id"), F.expr(
        "filter(sequence(0, size(embedding) - 1), i -> embedding[i] > 0)").alias("indices"),
        F.expr("filter(embedding, v -> v > 0)").alias("data"))
    panel = spark.range(40).select(F.col("id").cast("int").alias("index"),
                                   F.concat(F.lit("f"), F.col("id").cast("string")).alias("feature"))
    return A.explode_profiles(sparse, panel).withColumn("count", F.round(F.col("count").cast("double"), 6))


@query("scan_pixels", "SELECT marker, row, col, value FROM px WHERE marker IN ('A') AND row >= 10 AND row < 30", "px")
def _(spark, sf):
    return A.scan_pixels(V.pixels(spark, sf), "A", rows=(10, 30))


@query("scan_pixel_store", "SELECT marker, row, col, value FROM px WHERE marker IN ('A') AND row >= 10 AND row < 30 AND col >= 5 AND col < 45", "px")
def _(spark, sf):
    path = fresh_path(spark, "pixels")
    sinks.write_pixel_store(V.pixels(spark, sf), path, 8)
    return A.scan_pixel_store(spark, path, "A", rows=(10, 30), cols=(5, 45), height=8).select("marker", "row", "col", "value")


@query("enrich_missing", """
SELECT e.entity_id, e.lig, coalesce(c."Brand#1", 0) AS "Brand#1", coalesce(c."Brand#2", 0) AS "Brand#2"
FROM ent e LEFT JOIN (SELECT entity_id, CAST(sum(CASE WHEN feature='Brand#1' THEN 1 END) AS BIGINT) AS "Brand#1",
  CAST(sum(CASE WHEN feature='Brand#2' THEN 1 END) AS BIGINT) AS "Brand#2" FROM mol GROUP BY 1) c USING (entity_id)""", ("ent", "mol"))
def _(spark, sf):
    counts = V.molecules(spark, sf).groupBy("entity_id", "feature").count()
    return A.enrich_missing(V.entities(spark, sf).select("entity_id", "lig"), counts, ["lig", "Brand#1", "Brand#2"])


# --- filters and labels ------------------------------------------------------------------------------

@query("filter_confident", "SELECT * FROM ent WHERE confidence >= 0.5", "ent")
def _(spark, sf):
    return E.filter_confident(V.entities(spark, sf))


@query("population", "SELECT entity_id, sample, cell_type, x, y FROM ent WHERE cell_type IN ('TUMOR','TAM') AND lig > 0", "ent")
def _(spark, sf):
    return E.population(V.entities(spark, sf), ["TUMOR", "TAM"], "lig").select("entity_id", "sample", "cell_type", "x", "y")


@query("drop_unassigned", "SELECT cell_id, call FROM calls WHERE call IS NOT NULL AND call NOT IN ('P')", "calls")
def _(spark, sf):
    return E.drop_unassigned(V.calls(spark, sf), "call", {"P"}).select("cell_id", "call")


@query("crop_window", "SELECT entity_id, x, y FROM ent WHERE x >= 20 AND x < 120 AND y >= 50 AND y < 150", "ent")
def _(spark, sf):
    return E.crop_window(V.entities(spark, sf), 20, 50, 100).select("entity_id", "x", "y")


@query("filter_quality", "SELECT entity_id, feature, x, y, round(qv, 6) AS qv FROM mol WHERE qv >= 4.5", "mol")
def _(spark, sf):
    return E.filter_quality(V.molecules(spark, sf), 4.5).select("entity_id", "feature", "x", "y", F.round("qv", 6).alias("qv"))


@query("filter_depth", "SELECT entity_id, count(*) AS depth FROM mol GROUP BY 1 HAVING count(*) BETWEEN 30 AND 60", "mol")
def _(spark, sf):
    return E.filter_depth(V.molecules(spark, sf), 30, 60)


@query("require_support", """SELECT sample, cell_type, etype, count(*) AS n,
  CASE WHEN count(*) >= 150 THEN 'ok' ELSE 'too_sparse' END AS status FROM ent GROUP BY 1,2,3""", "ent")
def _(spark, sf):
    return E.require_support(V.entities(spark, sf), ["sample", "cell_type", "etype"], 150)


@query("harmonize_strict", """SELECT entity_id, CASE cell_type WHEN 'T' THEN 'lymphoid' WHEN 'B' THEN 'lymphoid' WHEN 'TAM' THEN 'myeloid'
  WHEN 'TUMOR' THEN 'epithelial' ELSE 'stromal' END AS label FROM ent""", "ent")
def _(spark, sf):
    m = {"T": "lymphoid", "B": "lymphoid", "TAM": "myeloid", "TUMOR": "epithelial", "STROMA": "stromal"}
    return E.harmonize_strict(V.entities(spark, sf), "cell_type", m).select("entity_id", "label")


@query("harmonize_rules", """SELECT p_partkey, CASE WHEN trim(p_name) = '' THEN 'unknown' WHEN p_name LIKE 'small%' THEN 'small'
   WHEN p_name LIKE 'red%' THEN 'red' ELSE trim(p_name) END AS fine,
  CASE WHEN trim(p_name) = '' THEN 'unknown' WHEN p_name LIKE 'small%' THEN 'size'
   WHEN p_name LIKE 'red%' THEN 'colour' ELSE trim(p_name) END AS coarse FROM part""")
def _(spark, sf):
    rules = [(E.prefix("small"), "small", "size"), (E.prefix("red"), "red", "colour")]
    return E.harmonize_rules(V.table(spark, sf, "part"), "p_name", rules).select("p_partkey", "fine", "coarse")


@query("affine_xy", "SELECT entity_id, round((1.5*x + -0.25*y + 10.0)*0.5, 6) AS col, round((0.25*x + 1.5*y + -4.0)*0.5, 6) AS row FROM ent", "ent")
def _(spark, sf):
    d = E.affine_xy(V.entities(spark, sf), (1.5, -0.25, 10), (0.25, 1.5, -4), 0.5)
    return d.select("entity_id", F.round("col", 6).alias("col"), F.round("row", 6).alias("row"))


@query("grid_bin", """SELECT entity_id, CAST(GREATEST(LEAST(FLOOR(x/25.0), 15), 0) AS INT) AS bx,
  CAST(GREATEST(LEAST(FLOOR(y/25.0), 15), 0) AS INT) AS "by" FROM ent""", "ent")
def _(spark, sf):
    return E.grid_bin(V.entities(spark, sf), 25.0, clip=(16, 16)).select("entity_id", "bx", "by")


@query("stratum_map", "SELECT entity_id, CASE etype WHEN 'cell' THEN 'whole' ELSE 'fragment' END AS method FROM ent", "ent")
def _(spark, sf):
    return E.stratum_map(V.entities(spark, sf), "etype", {"cell": "whole", "partial": "fragment"}).select("entity_id", "method")


@query("flag_table", """SELECT *, (flag_small OR flag_shallow OR flag_low_conf) AS flagged FROM (
 SELECT sample, cell_type, count(*) AS n, count(*) < 300 AS flag_small, avg(n_tx) < 105 AS flag_shallow,
  avg(CASE WHEN confidence < 0.4 THEN 1.0 ELSE 0.0 END) > 0.4 AS flag_low_conf FROM ent GROUP BY 1,2)""", "ent")
def _(spark, sf):
    g = V.entities(spark, sf).groupBy("sample", "cell_type").agg(
        F.count(F.lit(1)).alias("n"), F.avg("n_tx").alias("depth"),
        F.avg((F.col("confidence") < 0.4).cast("double")).alias("low"))
    return E.flag_table(g, {"flag_small": F.col("n") < 300, "flag_shallow": F.col("depth") < 105,
                            "flag_low_conf": F.col("low") > 0.4}).drop("depth", "low")


@query("stars", """SELECT entity_id, CASE WHEN confidence < 1e-3 THEN '***' WHEN confidence < 1e-2 THEN '**'
  WHEN confidence < 0.05 THEN '*' ELSE 'ns' END AS mark FROM ent""", "ent")
def _(spark, sf):
    return V.entities(spark, sf).select("entity_id", stars(F.col("confidence")).alias("mark"))


@query("sample_cap", """SELECT entity_id, sample FROM ent QUALIFY row_number() OVER (PARTITION BY sample
  ORDER BY md5('7|' || sample || '|' || entity_id), entity_id) <= 200""", "ent")
def _(spark, sf):
    return E.sample_cap(V.entities(spark, sf), "sample", 200, 7, "entity_id").select("entity_id", "sample")


# --- joins -------------------------------------------------------------------------------------------

@query("join_counts", "SELECT e.entity_id, e.cell_type, c.feature, c.n FROM ent e JOIN (SELECT entity_id, feature, count(*) AS n FROM mol GROUP BY 1,2) c USING (entity_id)", ("ent", "mol"))
def _(spark, sf):
    counts = V.molecules(spark, sf).groupBy("entity_id", "feature").agg(F.count(F.lit(1)).alias("n"))
    return E.join_counts(V.entities(spark, sf).select("entity_id", "cell_type"), counts)


@query("join_labels", "SELECT o_orderkey AS cell_id, coalesce(call, 'unscored') AS call FROM orders LEFT JOIN calls ON cell_id = o_orderkey", "calls")
def _(spark, sf):
    ids = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("cell_id"))
    return E.join_labels(ids, V.calls(spark, sf), "cell_id", ("call",)).select("cell_id", "call")


@query("check_contained", "SELECT DISTINCT o_custkey AS entity_id FROM orders WHERE o_custkey NOT IN (SELECT event_id FROM events WHERE value < 40)")
def _(spark, sf):
    sub = V.table(spark, sf, "orders").select(F.col("o_custkey").alias("entity_id"))
    sup = V.table(spark, sf, "events").where("value < 40").select(F.col("event_id").alias("entity_id"))
    return E.check_contained(sub, sup, "entity_id")


@query("semi_filter", "SELECT entity_id, feature, x, y FROM mol WHERE entity_id IN (SELECT entity_id FROM ent WHERE lig > 0)", ("ent", "mol"))
def _(spark, sf):
    ids = V.entities(spark, sf).where("lig > 0")
    return E.semi_filter(V.molecules(spark, sf), ids, "entity_id").select("entity_id", "feature", "x", "y")


@query("compare_runs", """SELECT count(*) AS n_common, round(avg(CASE WHEN a.call IS NOT DISTINCT FROM b.call THEN 1.0 ELSE 0.0 END), 6) AS agreement,
  round(max(abs(a.max_weight - b.w)), 6) AS max_abs_diff, round(corr(a.max_weight, b.w), 6) AS pearson,
  avg(CASE WHEN a.call IS NOT DISTINCT FROM b.call THEN 1.0 ELSE 0.0 END) >= 0.999 AND max(abs(a.max_weight - b.w)) <= 1e-3 AS passed
FROM calls a JOIN (SELECT cell_id, CASE WHEN max_weight > 0.95 THEN 'F' ELSE call END AS call, max_weight + 0.0001 * entropy AS w FROM calls) b USING (cell_id)""", "calls")
def _(spark, sf):
    a = V.calls(spark, sf)
    b = a.select("cell_id", F.when(F.col("max_weight") > 0.95, "F").otherwise(F.col("call")).alias("call"),
                 (F.col("max_weight") + 0.0001 * F.col("entropy")).alias("max_weight"))
    r = E.compare_runs(a, b, "cell_id", "call", "max_weight")
    return r.withColumns({c: F.round(c, 6) for c in ("agreement", "max_abs_diff", "pearson")})


@query("align_rows", "SELECT event_id AS row_id, value AS x, event_type FROM events")
def _(spark, sf):
    e = V.table(spark, sf, "events")
    return E.align_rows(e.select(F.col("event_id").alias("row_id"), F.col("value").alias("x")),
                        e.select(F.col("event_id").alias("row_id"), "event_type"))


# --- windows and sets --------------------------------------------------------------------------------

COUNTS_SQL = "cnt AS (SELECT entity_id, feature, count(*) AS n FROM mol GROUP BY 1,2)"


def counts(spark, sf):
    return V.molecules(spark, sf).groupBy("entity_id", "feature").agg(F.count(F.lit(1)).alias("n"))


@query("rank_within", f"WITH {COUNTS_SQL} SELECT entity_id, feature, row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, feature) AS rank FROM cnt", "mol")
def _(spark, sf):
    return G.rank_within(counts(spark, sf), "entity_id", [F.desc("n"), "feature"]).select(
        "entity_id", "feature", F.col("rank").cast("bigint").alias("rank"))


@query("top_n_per_group", "SELECT entity_id, sample, n_tx FROM ent QUALIFY row_number() OVER (PARTITION BY sample ORDER BY n_tx DESC, entity_id) <= 30", "ent")
def _(spark, sf):
    return G.top_n_per_group(V.entities(spark, sf), "sample", [F.desc("n_tx"), "entity_id"], 30).select("entity_id", "sample", "n_tx")


@query("top_k", "SELECT entity_id, n_tx, confidence FROM ent ORDER BY n_tx DESC, confidence DESC, entity_id LIMIT 40", "ent")
def _(spark, sf):
    return G.top_k(V.entities(spark, sf).select("entity_id", "n_tx", "confidence"),
                   [F.desc("n_tx"), F.desc("confidence"), "entity_id"], 40)


@query("running_stack", """SELECT sample, cell_type, n, CAST(stack_end - n AS BIGINT) AS stack_start, CAST(stack_end AS BIGINT) AS stack_end FROM (
  SELECT *, sum(n) OVER (PARTITION BY sample ORDER BY cell_type ROWS UNBOUNDED PRECEDING) AS stack_end
  FROM (SELECT sample, cell_type, count(*) AS n FROM ent GROUP BY 1,2))""", "ent")
def _(spark, sf):
    g = V.entities(spark, sf).groupBy("sample", "cell_type").agg(F.count(F.lit(1)).alias("n"))
    return G.running_stack(g, "sample", "cell_type", "n")


@query("running_min", """SELECT sample, bin, low, min(low) OVER (PARTITION BY sample ORDER BY bin DESC ROWS UNBOUNDED PRECEDING) AS running_min
  FROM (SELECT sample, CAST(FLOOR(n_tx/10.0) AS INT) AS bin, min(confidence) AS low FROM ent GROUP BY 1,2)""", "ent")
def _(spark, sf):
    g = V.entities(spark, sf).groupBy("sample", F.floor(F.col("n_tx") / 10.0).cast("int").alias("bin")).agg(F.min("confidence").alias("low"))
    return G.running_min(g, "sample", F.desc("bin"), "low")


@query("fixed_order", """SELECT o.ordinal, o.cell_type, n FROM (VALUES (0,'TUMOR'),(1,'TAM'),(2,'T'),(3,'MAST')) o(ordinal, cell_type)
  LEFT JOIN (SELECT cell_type, count(*) AS n FROM ent GROUP BY 1) USING (cell_type)""", "ent")
def _(spark, sf):
    g = V.entities(spark, sf).groupBy("cell_type").agg(F.count(F.lit(1)).alias("n"))
    return G.fixed_order(g, "cell_type", ["TUMOR", "TAM", "T", "MAST"]).select("ordinal", "cell_type", "n")


@query("group_share", "SELECT entity_id, sample, round(n_tx / CAST(sum(n_tx) OVER (PARTITION BY sample) AS DOUBLE), 9) AS share FROM ent", "ent")
def _(spark, sf):
    return G.group_share(V.entities(spark, sf), "sample", "n_tx").select("entity_id", "sample", F.round("share", 9).alias("share"))


@query("dedupe_first", "SELECT setting, method, cell_id FROM calls QUALIFY row_number() OVER (PARTITION BY setting, method ORDER BY max_weight DESC, cell_id) = 1", "calls")
def _(spark, sf):
    return G.dedupe_first(V.calls(spark, sf), ["setting", "method"], [F.desc("max_weight"), "cell_id"]).select("setting", "method", "cell_id")


@query("phase_pairs", """SELECT sample, cell_type AS phase, lead(cell_type) OVER (PARTITION BY sample ORDER BY n DESC, cell_type) AS next_phase
  FROM (SELECT sample, cell_type, count(*) AS n FROM ent GROUP BY 1,2) QUALIFY next_phase IS NOT NULL""", "ent")
def _(spark, sf):
    g = V.entities(spark, sf).groupBy("sample", F.col("cell_type").alias("phase")).agg(F.count(F.lit(1)).alias("n"))
    return G.phase_pairs(g, [F.desc("n"), "phase"], "phase", "sample").select("sample", "phase", "next_phase")


@query("union_arms", "SELECT entity_id, etype FROM ent WHERE etype='cell' UNION ALL SELECT entity_id, etype FROM ent WHERE etype='partial'", "ent")
def _(spark, sf):
    e = V.entities(spark, sf).select("entity_id", "etype")
    return G.union_arms(A.arm_of(e, "post_whole"), A.arm_of(e, "post_partial"))


@query("shared_features", "SELECT DISTINCT feature FROM mol WHERE sample = 0 AND feature IN (SELECT feature FROM mol WHERE sample = 1)", "mol")
def _(spark, sf):
    m = V.molecules(spark, sf)
    return G.shared_features(m.where("sample = 0"), m.where("sample = 1"))


@query("missing_features", "SELECT DISTINCT entity_id FROM mol WHERE entity_id NOT IN (SELECT entity_id FROM ent WHERE confidence >= 0.5)", ("mol", "ent"))
def _(spark, sf):
    return G.missing_features(V.molecules(spark, sf), E.filter_confident(V.entities(spark, sf)), "entity_id")


@query("union_distinct", "SELECT feature FROM mol WHERE cell_type='BUILDING' UNION SELECT feature FROM mol WHERE cell_type='MACHINERY'", "mol")
def _(spark, sf):
    m = V.molecules(spark, sf)
    return G.union_distinct(*[m.where(F.col("cell_type") == c).select("feature") for c in ("BUILDING", "MACHINERY")])


@query("same_set", """SELECT l AS only_left, r AS only_right, l = 0 AND r = 0 AS same FROM (SELECT
  (SELECT count(*) FROM (SELECT entity_id FROM ent EXCEPT SELECT entity_id FROM mol)) AS l,
  (SELECT count(*) FROM (SELECT entity_id FROM mol EXCEPT SELECT entity_id FROM ent)) AS r)""", ("ent", "mol"))
def _(spark, sf):
    return G.same_set(V.entities(spark, sf), V.molecules(spark, sf), "entity_id")
