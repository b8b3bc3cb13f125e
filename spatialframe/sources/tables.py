"""Columnar scans. Column lists and predicates are pushed into the Parquet scan by Catalyst."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import as_list


def scan_entities(spark: SparkSession, path: str, columns=None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


# one arm may be stored as several files of the same sample
ARM_FILES = {"pre": ["pre"], "post_whole": ["post_whole"], "post_partial": ["post_partial"],
             "post_all": ["post_whole", "post_partial"]}


def scan_arm(spark: SparkSession, root: str, arm: str, sample: str = "*") -> DataFrame:
    """One segmentation variant, for one sample or for all; ``post_all`` is whole plus partial entities."""
    if arm not in ARM_FILES:
        raise ValueError(f"unknown arm {arm}; have {sorted(ARM_FILES)}")
    parts = [spark.read.parquet(f"{root}/{sample}_{f}_spatial.parquet") for f in ARM_FILES[arm]]
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    name = F.regexp_extract("_metadata.file_path", r"([^/]+)_(?:pre|post_whole|post_partial)_spatial\.parquet", 1)
    tagged = [p.withColumn("sample", name) for p in parts] if "sample" not in df.columns else parts
    return (reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
            .withColumn("arm", F.lit(arm)))


def arm_of(df: DataFrame, arm: str) -> DataFrame:
    """The same resolver for one table that holds whole and partial entities together."""
    if arm == "post_all":
        return df
    want = {"post_whole": "cell", "post_partial": "partial"}.get(arm)
    if want is None:
        raise ValueError(f"unknown arm {arm}")
    return df.where(F.col("etype") == want)


scan_molecules = scan_entities


def scan_window(df: DataFrame, box, preds=()) -> DataFrame:
    """Rows inside ``box = (x0, y0, x1, y1)`` (half-open) that meet all predicates.

    Plain comparisons on stored columns, so row groups outside the box are skipped.
    """
    x0, y0, x1, y1 = box
    out = df.where((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1))
    for p in ([preds] if isinstance(preds, (str, Column)) else preds):
        out = out.where(p)
    return out


def read_manifest(df: DataFrame, json_col: str, schema: str, keep=()) -> DataFrame:
    """Rows of a nested JSON manifest held in a text column: one row per entry of the parsed value.

    ``schema`` is a DDL type: an array or map is exploded, a struct becomes columns.
    """
    parsed = df.select(*as_list(keep), F.from_json(json_col, schema).alias("_j"))
    kind = schema.strip().lower()
    if kind.startswith("array<struct"):
        return parsed.select(*as_list(keep), F.inline_outer("_j"))
    if kind.startswith(("map", "array")):
        return parsed.select(*as_list(keep), F.explode("_j"))
    return parsed.select(*as_list(keep), "_j.*")


def read_manifest_file(spark: SparkSession, path: str, explode_path: str) -> DataFrame:
    """A JSON file with a nested list; ``explode_path`` names the list (dots for nesting)."""
    return spark.read.option("multiLine", True).json(path).select(F.inline_outer(explode_path))


def explode_profiles(df: DataFrame, features: DataFrame | None = None, id_col: str = "entity_id",
                     indices: str = "indices", data: str = "data") -> DataFrame:
    """Sparse rows (index array, value array) -> long triples, keeping only wanted features.

    ``features`` holds (index, feature); it is a panel, joined by Spark's own size rule.
    """
    long = df.select(id_col, F.inline(F.arrays_zip(F.col(indices).alias("index"), F.col(data).alias("count"))))
    long = long.where(F.col("count") != 0)
    return long if features is None else long.join(features, "index").select(id_col, "feature", "count")


def scan_pixels(df: DataFrame, marker, rows=None, cols=None) -> DataFrame:
    """Pixels of one or more channels inside a row/column band (half-open). With a table partitioned by
    marker and row band the marker filter prunes partitions."""
    out = df.where(F.col("marker").isin(as_list(marker)))
    for name, band in (("row", rows), ("col", cols)):
        if band is not None:
            out = out.where((F.col(name) >= band[0]) & (F.col(name) < band[1]))
    return out


def with_row_band(df: DataFrame, height: int = 256) -> DataFrame:
    """The partition column of the stored pixel table."""
    return df.withColumn("row_band", F.floor(F.col("row") / height).cast("int"))


def band_column(height: int) -> str:
    return f"band_{height}"


def scan_pixel_store(spark: SparkSession, path: str, marker, rows=None, cols=None, height: int = 256, schema: str = "marker string, row int, col int, value int") -> DataFrame:
    """``scan_pixels`` over a table of ``sinks.write_pixel_store``: only the folders of the wanted markers and row bands are read, and
    inside them row groups are skipped by the statistics of ``row`` and ``col``."""
    if band_column(height) not in spark.read.parquet(path).columns:
        raise ValueError(f"{path} has no bands of {height} rows")
    px, band = spark.read.schema(f"{schema}, {band_column(height)} int").parquet(path), F.col(band_column(height))
    if rows is not None:
        px = px.where((band >= rows[0] // height) & (band <= (rows[1] - 1) // height))
    return scan_pixels(px, marker, rows, cols).drop(band_column(height))


def enrich_missing(df: DataFrame, counts: DataFrame, features: list[str], key: str = "entity_id") -> DataFrame:
    """Add a count column per feature the table lacks; entities without molecules get 0. Safe to rerun."""
    todo = [f for f in features if f not in df.columns]
    if not todo:
        return df
    wide = (counts.where(F.col("feature").isin(todo)).groupBy(key)
            .agg(*[F.sum(F.when(F.col("feature") == f, F.col("count"))).alias(f) for f in todo]))
    return (df.join(wide, key, "left")
            .select(*df.columns, *[F.coalesce(F.col(f), F.lit(0)).alias(f) for f in todo]))


def file_digests(spark: SparkSession, glob: str) -> DataFrame:
    """SHA-256 of every matching file, to compare an input with a recorded one. A file is one row, so this is for
    reference files below 2 GB."""
    return (spark.read.format("binaryFile").load(glob)
            .select("path", "length", F.sha2("content", 256).alias("sha256")))
