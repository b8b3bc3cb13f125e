"""Result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .tables import band_column, with_row_band

FORMATS = {"csv": {"header": True}, "tsv": {"header": True, "sep": "\t"}, "json": {}, "parquet": {}, "orc": {}}


def write_results(df: DataFrame, path: str, fmt: str = "csv", single: bool = False, mode: str = "errorifexists") -> None:
    """Write a result table. ``single`` gives one file and is meant for small summary tables."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}; have {sorted(FORMATS)}")
    out = df.coalesce(1) if single else df
    out.write.mode(mode).options(**FORMATS[fmt]).format("csv" if fmt == "tsv" else fmt).save(path)


def write_blocks(df: DataFrame, path: str, partition_by=(), mode: str = "errorifexists") -> None:
    """Write a large table in blocks, one directory per partition value; rows of one value are brought together
    first, and AQE splits a value that is too large for one task."""
    by = [partition_by] if isinstance(partition_by, str) else list(partition_by)
    out = df.hint("rebalance", *by) if by else df
    out.write.mode(mode).partitionBy(*by).parquet(path)


def write_pixel_store(px: DataFrame, path: str, height: int = 256, mode: str = "errorifexists") -> None:
    """Store pixels by marker and band of ``height`` rows, sorted inside a file, for ``tables.scan_pixel_store``. The band's column carries
    its height in the name, so a reader that assumes another one fails instead of missing rows."""
    band = band_column(height)
    out = with_row_band(px, height).withColumnRenamed("row_band", band)
    out.hint("rebalance", "marker", band).sortWithinPartitions("marker", band, "row", "col").write.mode(mode).partitionBy("marker", band).parquet(path)


def write_table_bucketed(df: DataFrame, name: str, buckets: int, *cols: str, path: str | None = None) -> None:
    """Store a table bucketed by its join key, one sorted file per bucket, so joins of tables with the same key and number of buckets
    need neither shuffle nor sort. All rows of one key are in one bucket and adaptive execution can't split it at the join: keep tables
    with hot keys unbucketed. ``path`` puts the files elsewhere than in the warehouse."""
    out = df.repartition(buckets, *cols).write.bucketBy(buckets, *cols).sortBy(*cols)
    (out.option("path", path) if path else out).saveAsTable(name)
