"""Text inputs: delimited tables, manifests of polygons, wide matrices and MatrixMarket triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.durable import durable


def read_table_text(spark: SparkSession, path: str, schema, sep: str = "\t") -> DataFrame:
    """TSV/CSV with a header and a declared schema (no inference pass over the data)."""
    return spark.read.csv(path, schema=schema, sep=sep, header=True, nullValue="", nanValue="nan")


def read_many(spark: SparkSession, glob: str, key_regex: str, schema, key: str = "setting", sep: str = "\t") -> DataFrame:
    """Many files of one shape read as one table; the key of each row comes from its file name."""
    df = read_table_text(spark, glob, schema, sep)
    return df.select(F.regexp_extract(F.col("_metadata.file_path"), key_regex, 1).alias(key), *df.columns)


POLYGONS = ("struct<features:array<struct<properties:struct<cell_id:string>,"
            "geometry:struct<type:string,coordinates:array<array<array<double>>>>>>>")


def polygons_of(df: DataFrame, json_col: str, keep=()) -> DataFrame:
    """(cell_id, ring) from GeoJSON collections in a text column; a ring is an array of (x, y)."""
    f = df.select(*keep, F.explode(F.from_json(json_col, POLYGONS)["features"]).alias("f"))
    ring = F.transform(F.get(F.col("f.geometry.coordinates"), F.lit(0)), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return f.select(*keep, F.col("f.properties.cell_id").alias("cell_id"), ring.alias("ring"))


def polygons_in_window(polys: DataFrame, box=None, pad: float = 0.0) -> DataFrame:
    """Polygons whose extent meets a window (x0, y0, x1, y1) widened by ``pad``."""
    edge = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    p = polys.withColumns({"x_min": edge(F.array_min, "x"), "x_max": edge(F.array_max, "x"), "y_min": edge(F.array_min, "y"), "y_max": edge(F.array_max, "y")})
    if box is None:
        return p
    x0, y0, x1, y1 = box
    return p.where((F.col("x_max") >= x0 - pad) & (F.col("x_min") <= x1 + pad) & (F.col("y_max") >= y0 - pad) & (F.col("y_min") <= y1 + pad))


def read_polygons_window(spark: SparkSession, path: str, box=None, pad: float = 0.0, per_line: bool = False) -> DataFrame:
    """Polygon collections cut to a window, one JSON document per file or, with ``per_line``, per line, so that large files can be split."""
    return polygons_in_window(polygons_of(spark.read.text(path, wholetext=not per_line), "value"), box, pad)


def wide_text_to_long(spark: SparkSession, path: str, cells: DataFrame | None = None, features: DataFrame | None = None, sep: str = "\t",
                      skip_bad: bool = False) -> DataFrame:
    """Feature-per-line matrix with a header of cell names -> (cell_id, feature, count), zeros and blanks dropped.

    Lines are split where they lie; each file has its own header, its first line, matched by position. A feature name may carry an
    alias after '|'. A line whose width differs from its header and a value that is no number stop the job; with ``skip_bad`` they are
    left out.
    """
    lines = spark.read.text(path).where(F.length("value") > 0).select(
        F.split("value", sep).alias("p"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"),
        F.monotonically_increasing_id().alias("_seq"))
    head = lines.where("_at = 0").groupBy("_file").agg(F.min_by("p", "_seq").alias("_head"), F.min("_seq").alias("_first"))
    names = head.select("_file", F.posexplode("_head").alias("pos", "cell_id")).where("pos > 0")
    if cells is not None:
        names = names.join(cells.select("cell_id"), "cell_id", "left_semi")
    body = lines.join(head.select("_file", "_first", F.size("_head").alias("_w")), "_file").where("_at <> 0 or _seq <> _first")
    if skip_bad:
        body = body.where(F.size("p") == F.col("_w"))
    else:
        body = body.withColumn("p", F.expr("case when size(p) = _w then p else cast(raise_error(concat('line of another width than its header in ', _file)) as array<string>) end"))
    body = body.withColumn("feature", F.split(F.get("p", F.lit(0)), r"\|")[0])
    if features is not None:
        body = body.join(features.select("feature"), "feature", "left_semi")
    long = body.select("_file", "feature", F.posexplode("p").alias("pos", "v")).where("pos > 0 and trim(v) <> ''")
    number = "try_cast(v as double)" if skip_bad else "coalesce(try_cast(v as double), cast(raise_error(concat('no number: ', v, ' in ', _file)) as double))"
    return long.withColumn("count", F.expr(number)).where("count <> 0").join(names, ["_file", "pos"]).select("cell_id", "feature", "count")


def unique_names(names: DataFrame, index: str = "index", name: str = "feature") -> DataFrame:
    """Number repeated names ``x__0``, ``x__1`` in file order, every name if any of them repeats."""
    from pyspark.sql import Window as W
    dup = names.groupBy(name).agg(F.count(F.lit(1)).alias("_k")).agg((F.max("_k") > 1).alias("_any"))
    n = F.row_number().over(W.partitionBy(name).orderBy(index)) - 1
    return (names.withColumn("_n", n).join(F.broadcast(dup))
            .select(index, F.when(F.col("_any"), F.concat_ws("__", name, F.col("_n").cast("string"))).otherwise(F.col(name)).alias(name)))


def _numbered(df: DataFrame) -> DataFrame:
    """Line numbers of a small name or metadata file, read as one piece."""
    return df.select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("index", "line"))


def read_mtx(spark: SparkSession, mtx: str, names: str, meta: str, partitions: int | None = None) -> DataFrame:
    """MatrixMarket triples with names and metadata -> (cell_id, feature, count).

    The matrix is turned so that cells are rows, whichever way it was stored; a shape that fits neither way stops the
    job. A compressed matrix is one split: pass ``partitions`` to spread it after reading. ``mtx`` may name several files, one of which has the banner
    and the size line; the others hold triples only.
    """
    gene = unique_names(_numbered(spark.read.text(names, wholetext=True)).select("index", F.trim(F.split("line", "\t")[0]).alias("feature")))
    cell = _numbered(spark.read.text(meta, wholetext=True)).where("index > 0").select((F.col("index") - 1).alias("index"), F.split("line", "\t")[0].alias("cell_id"))
    gene, cell = durable(gene), durable(cell)  # their sizes are known: the triples aren't shuffled to meet a small one
    raw = spark.read.text(mtx).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_seq"))
    triple = ~F.col("value").startswith("%")
    # the size line is the first one after the comments in the first block of the file with the banner
    heads = raw.where("_at = 0").groupBy("_file").agg(F.min_by("value", "_seq").alias("banner"), F.min(F.when(triple, F.struct("_seq", "value"))).alias("top"))
    first = heads.where(F.col("banner").startswith("%%MatrixMarket")).limit(2).collect()
    if len(first) > 1:
        raise ValueError(f"several files with a banner: {', '.join(r['_file'] for r in first)}")
    head = first[0] if first else heads.where("top is not null").orderBy("top").first()
    n_r, n_c = (int(v) for v in head["top"]["value"].split()[:2])
    body = raw.where(triple & ~((F.col("_file") == head["_file"]) & (F.col("_at") == 0) & (F.col("_seq") == head["top"]["_seq"])))
    if partitions:
        body = body.repartition(partitions)
    p = F.split(F.trim("value"), r"\s+")
    t = body.select(*[p[i].cast("double").alias(c) for i, c in enumerate("ijv")])
    n_gene, n_cell = gene.count(), cell.count()
    if (n_r, n_c) == (n_gene, n_cell) and n_gene != n_cell:
        g, c = "i", "j"
    elif (n_r, n_c) == (n_cell, n_gene):
        g, c = "j", "i"
    elif (n_r, n_c) == (n_gene, n_cell):
        g, c = "i", "j"
    else:
        raise ValueError(f"matrix is {n_r} x {n_c}, but there are {n_cell} cells and {n_gene} features")
    t = t.select((F.col(g) - 1).cast("int").alias("_g"), (F.col(c) - 1).cast("int").alias("_c"), F.col("v").alias("count"))
    return (t.join(gene.withColumnRenamed("index", "_g"), "_g").join(cell.withColumnRenamed("index", "_c"), "_c").select("cell_id", "feature", "count"))
