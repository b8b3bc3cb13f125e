"""Declared input schemas and the edge checks that go with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

ENTITY = T.StructType([
    T.StructField("entity_id", T.StringType(), False), T.StructField("sample", T.StringType(), False),
    T.StructField("arm", T.StringType()), T.StructField("etype", T.StringType()),
    T.StructField("cell_type", T.StringType()), T.StructField("x", T.DoubleType()),
    T.StructField("y", T.DoubleType()), T.StructField("n_tx", T.IntegerType()),
    T.StructField("confidence", T.DoubleType())])

MOLECULE = T.StructType([
    T.StructField("entity_id", T.StringType()), T.StructField("feature", T.StringType(), False),
    T.StructField("x", T.DoubleType(), False), T.StructField("y", T.DoubleType(), False),
    T.StructField("z", T.DoubleType()), T.StructField("qv", T.FloatType())])

COUNTS = T.StructType([
    T.StructField("entity_id", T.StringType(), False), T.StructField("feature", T.StringType(), False),
    T.StructField("count", T.LongType(), False)])

PIXEL = T.StructType([
    T.StructField("marker", T.StringType(), False), T.StructField("row", T.IntegerType(), False),
    T.StructField("col", T.IntegerType(), False), T.StructField("value", T.IntegerType())])

CALL = T.StructType([
    T.StructField("setting", T.StringType()), T.StructField("method", T.StringType()),
    T.StructField("cell_id", T.StringType(), False), T.StructField("call", T.StringType()),
    T.StructField("max_weight", T.DoubleType()), T.StructField("entropy", T.DoubleType())])


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")
    return df


def ingest(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast to a declared schema and turn NaN into NULL, so that aggregates skip it."""
    require_columns(df, *[f.name for f in schema if not f.nullable])
    cols = []
    for f in schema:
        if f.name not in df.columns:
            continue
        c = F.col(f.name).cast(f.dataType)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        cols.append(c.alias(f.name))
    return df.select(*cols)
