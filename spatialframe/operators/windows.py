"""Ranking, running totals, limits and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import as_list


def _order(order):
    return [F.col(o) if isinstance(o, str) else o for o in as_list(order)]


def _window(by, order):
    by = as_list(by)
    return (W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy(*_order(order))


def rank_within(df: DataFrame, by, order, out: str = "rank") -> DataFrame:
    return df.withColumn(out, F.row_number().over(_window(by, order)))


def top_n_per_group(df: DataFrame, by, order, n: int) -> DataFrame:
    """First n rows of each group; Spark adds a group limit before the shuffle."""
    return df.withColumn("__rn", F.row_number().over(_window(by, order))).where(F.col("__rn") <= n).drop("__rn")


def top_k(df: DataFrame, order, n: int) -> DataFrame:
    return df.orderBy(*_order(order)).limit(n)


def running_stack(df: DataFrame, by, order, col: str) -> DataFrame:
    """Start and end offset of every bar of a stack."""
    w = _window(by, order).rowsBetween(W.unboundedPreceding, 0)
    out = df.withColumn("stack_end", F.sum(col).over(w))
    return out.withColumn("stack_start", F.col("stack_end") - F.col(col))


def running_min(df: DataFrame, by, order, col: str, out: str = "running_min") -> DataFrame:
    return df.withColumn(out, F.min(col).over(_window(by, order).rowsBetween(W.unboundedPreceding, 0)))


def fixed_order(df: DataFrame, col: str, levels) -> DataFrame:
    """Rows in the order of a given category list; an absent category gives a NULL row."""
    spark = df.sparkSession
    dim = spark.createDataFrame([(i, v) for i, v in enumerate(levels)], f"ordinal int, {col} string")
    return F.broadcast(dim).join(df, col, "left")


def group_share(df: DataFrame, by, col: str, out: str = "share") -> DataFrame:
    """Share of the group total. Totals come from an aggregate joined back, not from a window over the
    group, so a large group is not gathered in one task."""
    by = as_list(by)
    tot = df.groupBy(*by).agg(F.sum(col).alias("__t"))
    joined = df.join(tot, by) if by else df.join(F.broadcast(tot))
    return joined.withColumn(out, F.col(col) / F.col("__t")).drop("__t")


def dedupe_first(df: DataFrame, by, order) -> DataFrame:
    return top_n_per_group(df, by, order, 1)


def phase_pairs(phases: DataFrame, ordinal: str = "ordinal", col: str = "phase", by=()) -> DataFrame:
    """Consecutive pairs of an ordered phase list."""
    return (phases.withColumn("next_phase", F.lead(col).over(_window(by, ordinal)))
            .where("next_phase is not null"))


def union_arms(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def shared_features(a: DataFrame, b: DataFrame, floor: int = 5, col: str = "feature") -> DataFrame:
    """Features present in both tables; fewer than ``floor`` stops the job."""
    both = a.select(col).intersect(b.select(col))
    n = both.agg(F.count(F.lit(1)).alias("__n"))
    enough = F.when(F.col("__n") < floor, F.raise_error(F.lit("too few shared features"))).otherwise(F.lit(True))
    return both.join(F.broadcast(n.select(enough.cast("boolean").alias("__ok")))).where("__ok").select(col)


def missing_features(a: DataFrame, b: DataFrame, col: str = "feature") -> DataFrame:
    return a.select(col).subtract(b.select(col))


def union_distinct(*dfs: DataFrame) -> DataFrame:
    return union_arms(*dfs).distinct()


def same_set(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: do both tables hold the same ids, and how many are on one side only."""
    left = a.select(key).distinct().withColumn("__a", F.lit(1))
    right = b.select(key).distinct().withColumn("__b", F.lit(1))
    j = left.join(right, key, "full_outer")
    out = j.agg(F.count_if(F.col("__b").isNull()).alias("only_left"),
                F.count_if(F.col("__a").isNull()).alias("only_right"))
    return out.withColumn("same", (F.col("only_left") == 0) & (F.col("only_right") == 0))
