"""Checked queries: text sources, sinks and streams. Text files are written from the driver's tables first."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.durable import fresh_path
from ..sources import sinks, text
from ..streaming import incremental as J
from . import views as V
from .queries_summaries import CENTROID_SQL, FATE_SQL, r, settle
from .registry import query


def scratch(spark) -> str:
    return fresh_path(spark, "files")


@query("read_table_text", "SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def _(spark, sf):
    path = scratch(spark)
    sinks.write_results(V.table(spark, sf, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"), path, "tsv")
    return text.read_table_text(spark, path, "p_partkey long, p_name string, p_size int, p_retailprice double")


@query("read_many", "SELECT setting, cell_id, max_weight FROM calls", "calls")
def _(spark, sf):
    path = scratch(spark)
    c = V.calls(spark, sf).select(F.col("setting").alias("part"), "cell_id", "max_weight")
    c.write.partitionBy("part").option("header", True).option("sep", "\t").csv(path)
    out = text.read_many(spark, f"{path}/part=*", r"part=([^/]+)/", "cell_id long, max_weight double")
    return out.withColumn("setting", F.url_decode("setting"))


@query("read_polygons_window", """SELECT cell_id, x_min, x_max, y_min, y_max FROM (SELECT CAST(c_custkey AS VARCHAR) AS cell_id, CAST(c_nationkey AS DOUBLE) AS x_min, c_nationkey + 2.0::DOUBLE AS x_max, CAST(c_custkey AS DOUBLE)/10 AS y_min, c_custkey/10.0::DOUBLE + 1 AS y_max FROM customer) WHERE x_max >= 4 AND x_min <= 11 AND y_max >= 9 AND y_min <= 61""")
def _(spark, sf):
    path = scratch(spark)
    c = V.table(spark, sf, "customer").select(F.col("c_nationkey").alias("g"), F.floor(F.col("c_custkey") / 256).alias("block"), F.to_json(F.struct(
        F.struct(F.col("c_custkey").cast("string").alias("cell_id")).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.expr(
            "array(array(array(c_nationkey, c_custkey/10), array(c_nationkey+2, c_custkey/10), array(c_nationkey+2, c_custkey/10+1), array(c_nationkey, c_custkey/10+1)))").alias("coordinates")).alias("geometry"))).alias("f"))
    # one collection per nation and block of 256 customer keys, one line each
    docs = c.groupBy("g", "block").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("f"), ","), F.lit("]}")).alias("value"))
    docs.select("value").write.text(path)
    polys = text.read_polygons_window(spark, path, (5, 10, 10, 60), 1.0, per_line=True)
    return polys.select("cell_id", "x_min", "x_max", "y_min", "y_max")


def in_order(df, path):
    """One text file with the lines in the order of column ``k`` (test input only)."""
    df.repartition(1).sortWithinPartitions("k").select("value").write.text(path)


@query("wide_text_to_long", """SELECT cell_type || '-' || sample AS cell_id, feature, CAST(count(*) AS DOUBLE) AS count FROM mol WHERE feature <> 'Brand#3' GROUP BY 1,2""", "mol")
def _(spark, sf):
    path = scratch(spark)
    m = V.molecules(spark, sf).withColumn("cell", F.concat_ws("-", "cell_type", "sample"))
    n = m.groupBy("feature", "cell").count()
    cells = [x[0] for x in n.select("cell").distinct().orderBy("cell").collect()]  # 5 segments x 5 regions
    dense = n.groupBy("feature").pivot("cell", cells).agg(F.first("count")).fillna(0)
    body = dense.select(F.col("feature").alias("k"), F.concat_ws("\t", F.concat("feature", F.lit("|x")), *[F.col(f"`{c}`") for c in cells]).alias("value"))
    head = spark.createDataFrame([("", "\t".join(["gene", *cells]))], "k string, value string")
    in_order(head.unionByName(body), path)
    keep = m.select("feature").distinct().where("feature <> 'Brand#3'")
    return text.wide_text_to_long(spark, path, features=keep)


@query("read_mtx", """SELECT 'c' || vec_id AS cell_id, 'g' || CAST((i-1)//2 AS VARCHAR) || '__' || CAST((i-1)%2 AS VARCHAR) AS feature, CAST(round(CAST(embedding[i] AS DOUBLE),6) AS DOUBLE) AS count FROM embeddings, generate_series(1,64) t(i) WHERE round(CAST(embedding[i] AS DOUBLE),6) <> 0""")
def _(spark, sf):
    path = scratch(spark)
    p = V.profiles(spark, sf)
    n = p.count()
    body = (p.select("vec_id", F.posexplode("embedding").alias("g", "v")).withColumn("v", F.round(F.col("v").cast("double"), 6)).where("v <> 0")
            .select(F.concat_ws(" ", F.col("g") + 1, F.col("vec_id") + 1, F.format_string("%.6f", "v")).alias("value")))
    lines = lambda rows: spark.createDataFrame(rows, "k long, value string")
    in_order(lines([(-2, "%%MatrixMarket matrix coordinate real general"), (-1, f"64 {n} {body.count()}")]), f"{path}/mtx")
    body.write.mode("append").text(f"{path}/mtx")  # triples have no order: no task holds them all
    in_order(lines([(i, f"g{i // 2}") for i in range(64)]), f"{path}/names")
    in_order(lines([(-1, "id")]).unionByName(p.select(F.col("vec_id").alias("k"), F.concat(F.lit("c"), F.col("vec_id").cast("string")).alias("value"))), f"{path}/meta")
    one = lambda d: f"{path}/{d}/part-*"
    return text.read_mtx(spark, one("mtx"), one("names"), one("meta"))


@query("write_results", "SELECT cell_type, count(*) AS n FROM ent GROUP BY 1", "ent")
def _(spark, sf):
    path = scratch(spark)
    g = V.entities(spark, sf).groupBy("cell_type").agg(F.count(F.lit(1)).alias("n"))
    for fmt in ("tsv", "csv", "json", "parquet"):
        sinks.write_results(g, f"{path}/{fmt}", fmt, single=True)
    return spark.read.schema("cell_type string, n long").json(f"{path}/json")


@query("write_blocks", "SELECT entity_id, sample, x, y FROM ent", "ent")
def _(spark, sf):
    path = scratch(spark)
    sinks.write_blocks(V.entities(spark, sf).select("entity_id", "sample", "x", "y"), path, "sample")
    return spark.read.schema("entity_id long, x double, y double, sample int").parquet(path)


def molecule_stream(spark, sf):
    """The line items as a stream, joined to the static tables."""
    t = lambda n: V.table(spark, sf, n)
    schema = t("lineitem").schema
    return V.molecules_from(J.read_stream(spark, sf, "lineitem.parquet", schema), t)


@query("molecule_fate_stream", FATE_SQL, "mol")
def _(spark, sf):
    base = scratch(spark)
    state = J.run_available(J.molecule_fate_stream(molecule_stream(spark, sf)), f"{base}/out", f"{base}/state")
    return r(J.fate_result(state), 6, "pct_of_total")


@query("entity_accumulator_stream", CENTROID_SQL, "mol")
def _(spark, sf):
    base = scratch(spark)
    state = J.run_available(J.entity_accumulator_stream(molecule_stream(spark, sf)), f"{base}/out", f"{base}/state", "entity_id")
    return settle(J.centroid_result(state), 5, "x", "y")
