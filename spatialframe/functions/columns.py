"""Column builders that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def as_list(x) -> list:
    if x is None:
        return []
    return [x] if isinstance(x, (str, Column)) else list(x)


def clean_nan(df: DataFrame, *cols: str) -> DataFrame:
    """NaN -> NULL, because Spark's aggregates skip NULL but not NaN."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in cols})


def hash_hex(*parts) -> Column:
    """Seeded draw key: md5 of the parts joined by '|'. Same value for any partitioning or retry."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def hash_int(*parts) -> Column:
    """First 32 bits of the draw key as a non-negative integer."""
    return F.conv(F.substring(hash_hex(*parts), 1, 8), 16, 10).cast("bigint")


def hash_unit(*parts) -> Column:
    """Uniform value in [0, 1)."""
    return hash_int(*parts) / F.lit(4294967296.0)


def rate_per(count: Column, total: Column, scale: float = 1e4) -> Column:
    return count / F.greatest(total, F.lit(1)) * F.lit(float(scale))


def rarefied_detection(n: Column, k: Column, d: int) -> Column:
    """P(at least one of k marked molecules survives when n are thinned to d without replacement)."""
    n, k = n.cast("double"), k.cast("double")
    miss = F.aggregate(
        F.sequence(F.lit(0), F.lit(d - 1)), F.lit(1.0),
        lambda acc, i: acc * (n - k - i) / (n - i))
    return (F.when((k <= 0) | (n < d), 0.0)
            .when(n - k < d, 1.0)
            .otherwise(1.0 - miss))


def stars(p: Column) -> Column:
    """Significance mark; NULL and NaN read as not significant."""
    return (F.when(p.isNull() | F.isnan(p), "ns")
            .when(p < 1e-3, "***").when(p < 1e-2, "**").when(p < 0.05, "*")
            .otherwise("ns"))


def n_rows() -> Column:
    return F.count(F.lit(1))
