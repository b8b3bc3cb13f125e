"""Entity, molecule, call and pixel views over the driver's tables, in Spark and in SQL.

Each view exists twice with the same meaning: a DataFrame builder, and the SQL text used by the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

GRID = 50  # the pixel views live on a 50 x 50 grid, rows and columns 1..50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id").alias("entity_id"),
        (F.col("user_id") % 5).cast("int").alias("sample"),
        F.when(F.col("user_id") % 3 == 0, "partial").otherwise("cell").alias("etype"),
        F.when(F.col("event_type") == "click", "T").when(F.col("event_type") == "view", "TAM")
         .when(F.col("event_type") == "purchase", "TUMOR").when(F.col("event_type") == "signup", "B")
         .otherwise("STROMA").alias("cell_type"),
        F.col("value").alias("x"),
        ((F.col("event_id") * 7919 % 10007).cast("double") / 20.0
         + F.floor(F.col("event_id") / 10007.0).cast("double") * 500.0).alias("y"),
        (1 + (F.col("event_id") * 104729) % 211).cast("int").alias("n_tx"),
        (((F.col("event_id") * 15485863) % 1000).cast("double") / 1000.0).alias("confidence"),
        F.when(k >= 70, 1).otherwise(0).alias("lig"),
        F.when(k % 3 == 0, 1).otherwise(0).alias("rec"))


ENT_SQL = """ent AS (
SELECT CAST(event_id AS BIGINT) entity_id, CAST(user_id % 5 AS INT) sample,
  CASE WHEN user_id % 3 = 0 THEN 'partial' ELSE 'cell' END etype,
  CASE event_type WHEN 'click' THEN 'T' WHEN 'view' THEN 'TAM' WHEN 'purchase' THEN 'TUMOR'
                  WHEN 'signup' THEN 'B' ELSE 'STROMA' END cell_type,
  value x,
  CAST(event_id * 7919 % 10007 AS DOUBLE)/20.0 + CAST(FLOOR(event_id/10007.0) AS DOUBLE)*500.0 y,
  CAST(1 + (event_id * 104729) % 211 AS INT) n_tx,
  CAST((event_id * 15485863) % 1000 AS DOUBLE)/1000.0 confidence,
  CASE WHEN CAST(json_extract_string(props,'$.k') AS INT) >= 70 THEN 1 ELSE 0 END lig,
  CASE WHEN CAST(json_extract_string(props,'$.k') AS INT) % 3 = 0 THEN 1 ELSE 0 END rec
FROM events)"""


def molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    return molecules_from(t("lineitem"), t)


def molecules_from(lineitem: DataFrame, t) -> DataFrame:
    """The molecule view over a batch or streaming line-item table."""
    flag, disc = F.col("l_returnflag"), F.col("l_discount") * 100.0
    return (lineitem
            .join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
            .select(
                F.col("o_custkey").alias("entity_id"), F.col("n_regionkey").alias("sample"),
                F.col("c_mktsegment").alias("cell_type"), F.col("p_brand").alias("feature"),
                (F.col("l_extendedprice") / 100.0).alias("x"), (F.col("l_quantity") * 10.0).alias("y"),
                disc.alias("qv"),
                F.when(flag == "A", 0).when(flag == "N", 3).otherwise(5).alias("etype_at_input"),
                F.when(disc < 2.5, 0).when(disc < 5.5, 1).when(disc < 8.5, 5).otherwise(3).alias("etype_at_group"),
                F.when(disc >= 9.5, 3).when(F.col("l_linestatus") == "F", 0).otherwise(1)
                 .alias("etype_at_finalize"),
                F.when(F.col("l_tax") < 0.045, F.col("o_custkey")).otherwise(F.col("l_suppkey"))
                 .alias("owner_out")))


MOL_SQL = """mol AS (
SELECT o_custkey entity_id, n_regionkey sample, c_mktsegment cell_type, p_brand feature,
  l_extendedprice/100.0 x, l_quantity*10.0 y, l_discount*100.0 qv,
  CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 3 ELSE 5 END etype_at_input,
  CASE WHEN l_discount*100.0 < 2.5 THEN 0 WHEN l_discount*100.0 < 5.5 THEN 1
       WHEN l_discount*100.0 < 8.5 THEN 5 ELSE 3 END etype_at_group,
  CASE WHEN l_discount*100.0 >= 9.5 THEN 3 WHEN l_linestatus = 'F' THEN 0 ELSE 1 END etype_at_finalize,
  CASE WHEN l_tax < 0.045 THEN o_custkey ELSE l_suppkey END owner_out
FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey
  JOIN nation ON c_nationkey=n_nationkey JOIN part ON l_partkey=p_partkey)"""


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    return (t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("o_orderpriority").alias("setting"), F.col("r_name").alias("method"),
                F.col("o_orderkey").alias("cell_id"),
                F.when(F.col("o_totalprice") >= 50000, F.col("o_orderstatus")).alias("call"),
                (F.col("o_totalprice") / 500000.0).alias("max_weight"),
                F.log(1.0 + F.col("o_totalprice") / 100000.0).alias("entropy")))


CALLS_SQL = """calls AS (
SELECT o_orderpriority setting, r_name AS method, o_orderkey cell_id,
  CASE WHEN o_totalprice >= 50000 THEN o_orderstatus END AS call,
  o_totalprice/500000.0 max_weight, ln(1.0 + o_totalprice/100000.0) entropy
FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey
  JOIN region ON n_regionkey=r_regionkey)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "lineitem")
            .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
            .groupBy(F.col("l_returnflag").alias("marker"), F.col("p_size").cast("int").alias("row"),
                     F.col("l_quantity").cast("int").alias("col"))
            .agg(F.expr("cast(sum(cast(round(l_discount * 100) as int)) * 10 div count(1) as int)").alias("value")))


PX_SQL = """px AS (
SELECT l_returnflag marker, CAST(p_size AS INT) AS row, CAST(l_quantity AS INT) AS col,
  CAST(sum(CAST(round(l_discount * 100) AS INT)) * 10 // count(*) AS INT) AS value
FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY 1,2,3)"""


def blank_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two channels on the same grid that stand in for autofluorescence: they carry no marker of a type."""
    return (table(spark, sf_dir, "lineitem")
            .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
            .groupBy(F.col("l_linestatus").alias("marker"), F.col("p_size").cast("int").alias("row"), F.col("l_quantity").cast("int").alias("col"))
            .agg(F.expr("cast(sum(cast(round(l_discount * 100) as int)) * 10 div count(1) as int)").alias("value")))


BLANK_SQL = """pxa AS (
SELECT * FROM px UNION ALL SELECT l_linestatus, CAST(p_size AS INT), CAST(l_quantity AS INT),
  CAST(sum(CAST(round(l_discount * 100) AS INT)) * 10 // count(*) AS INT)
FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY 1,2,3)"""


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Molecules projected to the 50 x 50 grid, one row per distinct entity pixel."""
    m = molecules(spark, sf_dir)
    return m.select(
        "entity_id", "cell_type", "sample",
        F.least(F.floor(F.col("x") / 21.0), F.lit(GRID - 1)).cast("int").alias("_r"),
        F.floor(F.col("y") / 10.0).cast("int").alias("col"),
    ).select("entity_id", "cell_type", "sample", (F.col("_r") + 1).alias("row"), "col").distinct()


FOOT_SQL = """foot AS (
SELECT DISTINCT entity_id, cell_type, sample, CAST(LEAST(FLOOR(x/21.0), 49) AS INT) + 1 AS row,
  CAST(FLOOR(y/10.0) AS INT) AS col FROM mol)"""


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bright pixels of channel A: the stand-in for 'inside a cell of the original segmentation'."""
    px = pixels(spark, sf_dir).where("marker = 'A'")
    cut = px.agg(F.percentile("value", F.lit(0.97)).alias("cut"))  # one value of a 2,500-pixel channel
    return px.join(F.broadcast(cut), F.col("value") >= F.col("cut"), "left_semi").select("row", "col")


MASK_SQL = """mask AS (
SELECT row, col FROM px WHERE marker = 'A'
  AND value >= (SELECT quantile_cont(value, 0.97) FROM px WHERE marker = 'A'))"""

# pixel distance to the mask
DIST_SQL = """dist AS (
SELECT g.row, g.col, sqrt(min((g.row-m.row)*(g.row-m.row)+(g.col-m.col)*(g.col-m.col))) dist
FROM (SELECT DISTINCT row, col FROM px) g CROSS JOIN mask m GROUP BY 1,2)"""

VIEW_SQL = {"ent": [ENT_SQL], "mol": [MOL_SQL], "calls": [CALLS_SQL], "px": [PX_SQL],
            "foot": [MOL_SQL, FOOT_SQL], "mask": [PX_SQL, MASK_SQL], "dist": [PX_SQL, MASK_SQL, DIST_SQL], "pxa": [PX_SQL, BLANK_SQL]}


def with_views(body: str, *views: str) -> str:
    """Prefix a query with the view definitions it uses, as one WITH clause."""
    parts: list[str] = []
    for v in views:
        for p in VIEW_SQL[v]:
            if p not in parts:
                parts.append(p)
    body = body.strip()
    if body[:5].upper() == "WITH ":
        parts.append(body[5:].strip())
        return "WITH RECURSIVE " + ",\n".join(parts)
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" + body) if parts else body
