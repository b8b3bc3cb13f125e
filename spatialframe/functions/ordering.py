"""Order statistics that never put a whole group into one task.

``percentile`` keeps every distinct value of a group in one reducer and a plain running window sorts a
whole group in one task. The helpers here first split a group into value or hash buckets, so a group that
holds a large share of all rows is still spread over many tasks. All results are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .columns import as_list
from .durable import durable

ACCURACY = 10_000
BUCKETS = 1024
FEW = 50_000  # rows of brackets that may be broadcast


def exact_percentiles(df: DataFrame, by, specs: dict[str, tuple[str | Column, float]], derived: bool = False) -> DataFrame:
    """Interpolated percentiles per group: ``specs`` maps output name -> (column, probability).

    Pass one takes a bounded-size sketch per group and reads off, for every wanted rank, a value bracket
    that must contain it. Pass two counts the values below the bracket and the distinct values inside it.
    NULL and NaN are skipped; a group without any value has no row. Both passes read the input: set ``derived`` where
    it is the result of joins or aggregates, and it is written once instead of being computed twice.
    """
    by = as_list(by)
    measures = {}
    for name, (col, p) in specs.items():
        measures.setdefault(str(col), (F.col(col) if isinstance(col, str) else col, []))[1].append((name, p))
    cols = list(measures.values())

    one = "__all" if not by else None
    base = df.withColumn(one, F.lit(1)) if one else df
    keys = by or [one]
    long = (base.select(*keys, F.posexplode(F.array(*[c.cast("double") for c, _ in cols])).alias("__m", "__v"))
            .where("__v is not null and not isnan(__v)"))
    if derived:
        long = durable(long)

    probs = sorted({p for _, wants in cols for _, p in wants})
    # the sketch may be off by n/ACCURACY ranks: leave twice that on either side
    margin = 2.0 / ACCURACY
    marks = sorted({min(max(q, 0.0), 1.0) for p in probs for q in (p - margin, p + margin)})
    sketch = long.groupBy(*keys, "__m").agg(
        F.count("__v").alias("__n"),
        F.min("__v").alias("__min"), F.max("__v").alias("__max"),
        F.percentile_approx("__v", [float(q) for q in marks], ACCURACY).alias("__q"))

    def mark(q, edge, limit):
        q = min(max(q, 0.0), 1.0)
        return F.col(edge) if q == limit else F.col("__q")[marks.index(q)]

    wanted = F.array(*[
        F.struct(F.lit(i).alias("w"), F.lit(float(p)).alias("p"),
                 mark(p - margin, "__min", 0.0).alias("lo"), mark(p + margin, "__max", 1.0).alias("hi"))
        for i, p in enumerate(probs)])
    brackets = sketch.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__m").alias("__m2"), "__n", wanted.alias("__w"))
    # written and counted: by estimate it may seem larger than its input, and Spark would broadcast all values instead
    brackets = durable(brackets)
    if brackets.count() <= FEW:
        brackets = F.broadcast(brackets)
    same = F.col("__m") == F.col("__m2")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    hit = (long.join(brackets, same)
           .select(*keys, "__m", "__v", "__n", F.explode("__w").alias("__b"))
           .select(*keys, "__m", "__n", F.col("__b.w").alias("__w"), F.col("__b.p").alias("__p"), "__v",
                   F.expr("case when __v < __b.lo then 0 when __v <= __b.hi then 1 else 2 end").alias("__z")))
    counts = (hit.groupBy(*keys, "__m", "__w", "__p", "__n", "__z", F.expr("case when __z = 1 then __v end").alias("__x"))
              .agg(F.count(F.lit(1)).alias("__c"), F.min("__v").alias("__first"), F.max("__v").alias("__last")))
    order = W.partitionBy(*keys, "__m", "__w").orderBy("__z", "__x")
    placed = (counts
              .withColumn("__hi", F.sum("__c").over(order.rowsBetween(W.unboundedPreceding, 0)))
              .withColumn("__lo", F.col("__hi") - F.col("__c"))
              .withColumn("__h", (F.col("__n") - 1) * F.col("__p"))
              .where("__hi > floor(__h) and __lo <= ceil(__h)"))

    def at(k):
        # a wanted rank lies inside the bracket, or is the last value below it or the first above it
        return F.expr(
            f"case when __lo > {k} or __hi <= {k} then null when __z = 1 then __x "
            f"when __z = 0 and __hi = {k} + 1 then __last when __z = 2 and __lo = {k} then __first "
            f"else cast(raise_error('rank outside its bracket') as double) end")

    stat = placed.groupBy(*keys, "__m", "__w", "__h").agg(
        F.max(at("floor(__h)")).alias("__a"), F.max(at("ceil(__h)")).alias("__z"))
    stat = stat.withColumn("__s", F.expr("__a + (__z - __a) * (__h - floor(__h))"))
    out = [
        F.max(F.when((F.col("__m") == m) & (F.col("__w") == probs.index(p)), F.col("__s"))).alias(name)
        for m, (_, wants) in enumerate(cols) for name, p in wants]
    out_df = stat.groupBy(*keys).agg(*out)
    return out_df.drop(one) if one else out_df


def prefix_sums(df: DataFrame, by, order: str, sums: dict[str, str], descending: bool = False) -> DataFrame:
    """Running totals of ``sums`` (output name -> column), rows before the current one in ``order``.

    ``order`` must be numeric and unique within a group. A group is cut into equal-width value buckets; the
    window inside a bucket and the window over the bucket totals are both small.
    """
    by = as_list(by)
    one = None if by else "__all"
    base = df.withColumn(one, F.lit(1)) if one else df
    keys = by or [one]
    span = base.groupBy(*keys).agg(F.min(order).alias("__min"), F.max(order).alias("__max"))
    pos = F.when(F.col("__max") > F.col("__min"),
                 F.least(F.floor((F.col(order) - F.col("__min")) / (F.col("__max") - F.col("__min")) * BUCKETS),
                         F.lit(BUCKETS - 1))).otherwise(F.lit(0))
    cut = base.join(span, keys).withColumn("__b", pos).drop("__min", "__max")
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    prior = lambda *parts: W.partitionBy(*parts)
    totals = cut.groupBy(*keys, "__b").agg(*[F.sum(c).alias(f"__t_{o}") for o, c in sums.items()])
    over_buckets = prior(*keys).orderBy(direction("__b")).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*keys, "__b", *[
        F.coalesce(F.sum(f"__t_{o}").over(over_buckets), F.lit(0)).alias(f"__o_{o}") for o in sums])
    inside = prior(*keys, "__b").orderBy(direction(order)).rowsBetween(W.unboundedPreceding, -1)
    out = cut.join(totals, [*keys, "__b"]).withColumns({
        o: F.col(f"__o_{o}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for o, c in sums.items()})
    drop = ["__b", *[f"__o_{o}" for o in sums]] + ([one] if one else [])
    return out.drop(*drop)


def hash_rank(df: DataFrame, by, hex_col: str, id_col: str, rank: str = "rank") -> DataFrame:
    """1-based position of every row in ``(hex_col, id_col)`` order within its group.

    The first three hex digits split a group into 4,096 parts of near-equal size, whatever its size.
    """
    by = as_list(by)
    one = None if by else "__all"
    base = df.withColumn(one, F.lit(1)) if one else df
    keys = by or [one]
    cut = base.withColumn("__b", F.substring(hex_col, 1, 3))
    sizes = cut.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__c"))
    before = W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(*keys, "__b", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__o"))
    inside = W.partitionBy(*keys, "__b").orderBy(hex_col, id_col)
    # built from the sizes, part by part; by estimate the rows may seem small enough to be broadcast
    out = cut.join(sizes.hint("shuffle_hash"), [*keys, "__b"]).withColumn(rank, F.col("__o") + F.row_number().over(inside))
    return out.drop("__b", "__o", *([one] if one else []))


def take_hash_ranked(df: DataFrame, by, hex_col: str, id_col: str, n_col: str) -> DataFrame:
    """The first ``n_col`` rows of every group in hash order.

    Whole buckets are taken or left by their counts; only the one bucket that holds the cut is ranked.
    """
    by = as_list(by)
    cut = df.withColumn("__b", F.substring(hex_col, 1, 3))
    sizes = cut.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__c"), F.max(n_col).alias("__n"))
    w = W.partitionBy(*by).orderBy("__b").rowsBetween(W.unboundedPreceding, 0)
    sizes = (sizes.withColumn("__hi", F.sum("__c").over(w))
             .withColumn("__left", F.col("__n") - (F.col("__hi") - F.col("__c")))
             .where("__left > 0")
             .select(*by, "__b", "__left", (F.col("__left") < F.col("__c")).alias("__edge")))
    kept = cut.join(sizes, [*by, "__b"])
    whole = kept.where("not __edge")
    inside = W.partitionBy(*by, "__b").orderBy(hex_col, id_col)
    edge = (kept.where("__edge").withColumn("__r", F.row_number().over(inside))
            .where("__r <= __left").drop("__r"))
    return whole.unionByName(edge).drop("__b", "__left", "__edge")


def level_percentiles(hist: DataFrame, by, value: str, count: str, specs: dict[str, float]) -> DataFrame:
    """Interpolated percentiles from counts per level, for values with few levels (pixel intensities)."""
    by = as_list(by)
    w = W.partitionBy(*by).orderBy(value)
    h = hist.withColumns({"__hi": F.sum(count).over(w.rowsBetween(W.unboundedPreceding, 0)), "__n": F.sum(count).over(W.partitionBy(*by))})
    h = h.withColumn("__lo", F.col("__hi") - F.col(count))
    out = []
    for name, p in specs.items():
        pos = (F.col("__n") - 1) * p
        at = lambda k: F.max(F.when((F.col("__lo") <= k) & (F.col("__hi") > k), F.col(value).cast("double")))
        a, z = at(F.floor(pos)), at(F.ceil(pos))
        out.append((a + (z - a) * F.max(pos - F.floor(pos))).alias(name))
    return h.groupBy(*by).agg(*out)
