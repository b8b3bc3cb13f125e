"""Places in a total order, counted over all tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from spatialframe.functions.durable import Scratch

IN_PART = 33        # bits of ``monotonically_increasing_id`` that number the rows of one partition


def global_index(df: DataFrame, order: list[str | Column], scratch: Scratch, name: str, index: str = "index") -> DataFrame:
    """``df`` with the place (0, 1, 2, ...) of every row in the order, as the table ``name`` of ``scratch``. The rows are sorted by ranges, and the
    place is what lies in earlier ranges and what comes before in its own: the offsets are one row per range, whatever the size of the table.
    Only rows equal in all order columns must share a range."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = scratch.keep(ranged.withColumn("__place", F.monotonically_increasing_id()), name)
    part = F.shiftright("__place", IN_PART)
    sizes = ranged.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__part", before.alias("__before"))          # at most ``parts`` rows
    at = F.col("__before") + F.col("__place").bitwiseAND(F.lit((1 << IN_PART) - 1))
    return ranged.join(F.broadcast(offsets), part == F.col("__part")).withColumn(index, at).drop("__place", "__part", "__before")
