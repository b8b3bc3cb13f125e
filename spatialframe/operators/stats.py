"""Tests and rank statistics. Global ranks come from distinct-value counts, never from one global sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import as_list, n_rows, prefix_sums
from ..functions.durable import durable
from ..functions.tails import binom_two_sided, exact_u, normal_isf, normal_sf, signflip_halves, t_quantile


def bh_adjust(df: DataFrame, p: str, by=(), out: str = "q") -> DataFrame:
    """Benjamini-Hochberg adjusted p within each group; NULL and NaN p keep a NULL q.

    Equal p values share one row of a distinct-value table, whose running counts and running minimum are
    taken bucket-wise.
    """
    by = as_list(by)
    ok = F.col(p).isNotNull() & ~F.isnan(p)
    one = None if by else "__all"
    base = df.withColumn(one, F.lit(1)) if one else df
    keys = by or [one]
    vals = base.where(ok).groupBy(*keys, F.col(p).cast("double").alias("__p")).agg(n_rows().alias("__c"))
    tot = vals.groupBy(*keys).agg(F.sum("__c").alias("__n"))
    placed = prefix_sums(vals, keys, "__p", {"__before": "__c"}).join(tot, keys)
    adj = placed.withColumn("__a", F.col("__p") * F.col("__n") / (F.col("__before") + F.col("__c")))
    # running minimum from the largest p down: inside a bucket of p, then over the buckets above it
    adj = adj.withColumn("__b", F.floor(F.col("__p") * 1000))
    best = adj.groupBy(*keys, "__b").agg(F.min("__a").alias("__m"))
    above = W.partitionBy(*keys).orderBy(F.desc("__b")).rowsBetween(W.unboundedPreceding, -1)
    best = best.select(*keys, "__b", F.min("__m").over(above).alias("__m"))
    inside = W.partitionBy(*keys, "__b").orderBy(F.desc("__p")).rowsBetween(W.unboundedPreceding, 0)
    q = adj.join(best, [*keys, "__b"]).select(
        *keys, "__p", F.least(F.least(F.min("__a").over(inside), F.coalesce("__m", F.lit(1.0))), F.lit(1.0)).alias(out))
    res = base.withColumn("__p", F.when(ok, F.col(p).cast("double"))).join(q, [*keys, "__p"], "left").drop("__p")
    return res.drop(one) if one else res


#: Units of an exact sign-flip test: 2^n patterns up to ``ALL_PATTERNS``, two halves of 2^(n/2) sums beyond.
ALL_PATTERNS, MAX_UNITS = 16, 40


def signflip_exact(df: DataFrame, by, d: str) -> DataFrame:
    """Exact two-sided paired sign-flip test per group, over all sign patterns of its differences: by enumeration in small groups, by meeting in the
    middle in others (the signed sums of both halves, counted against each other). Groups of more than
    ``MAX_UNITS`` units keep their row with their n and a NULL p; units are counted before any are gathered."""
    by = as_list(by)
    one = None if by else "__all"
    keys = by or [one]
    known = df.where(F.col(d).isNotNull() & ~F.isnan(d))
    known = (known.withColumn(one, F.lit(1)) if one else known).select(*keys, F.col(d).cast("double").alias("_d"))
    sizes = known.groupBy(*keys).agg(n_rows().alias("n"))
    few = sizes.where(F.col("n") <= MAX_UNITS).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)])
    few = known.join(few, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)], "left_semi")
    few = few.groupBy(*keys).agg(n_rows().alias("n"), F.array_sort(F.collect_list("_d")).alias("_v"))
    many = sizes.where(F.col("n") > MAX_UNITS).withColumn("_v", F.lit(None).cast("array<double>"))
    g = few.unionByName(many)
    g = g.drop(one) if one else g
    total = "aggregate(_v, 0D, (a, v) -> a + v)"
    flips = F.expr(f"""
      size(filter(sequence(0L, shiftleft(1L, least(cast(n as int), {ALL_PATTERNS})) - 1L), m -> abs(aggregate(
             transform(_v, (v, i) -> if((shiftright(m, i) & 1L) = 1L, v, -v)), 0D, (a, v) -> a + v)) / n
           >= abs({total}) / n - 1e-12))""")
    small = F.col("n") <= ALL_PATTERNS
    halves = signflip_halves(F.when(small, None).otherwise(F.col("_v")))
    return g.select(*by, "n", F.when(small, flips / F.pow(F.lit(2.0), F.col("n"))).otherwise(halves).alias("p"))


def value_counts(df: DataFrame, by, value: str, flag) -> DataFrame:
    """Distinct values with the number of rows on either side of a flag."""
    return (df.where(F.col(value).isNotNull() & ~F.isnan(value) & flag.isNotNull())
            .groupBy(*as_list(by), F.col(value).cast("double").alias("_v"))
            .agg(F.count_if(flag).alias("_a"), F.count_if(~flag).alias("_b")))


def _pair_counts(df: DataFrame, by, value: str, flag) -> DataFrame:
    """Per group: sizes, sum over the first side of (#second below + half #second equal), and the tie term."""
    by = as_list(by)
    one = None if by else "__all"
    keys = by or [one]
    v = value_counts(df.withColumn(one, F.lit(1)) if one else df, keys, value, flag)
    c = prefix_sums(v, keys, "_v", {"_below": "_b"})
    t = F.col("_a") + F.col("_b")
    g = c.groupBy(*keys).agg(
        F.sum("_a").alias("n_a"), F.sum("_b").alias("n_b"),
        F.sum(F.col("_a") * (F.col("_below") + F.col("_b") / 2.0)).alias("u"),
        F.sum((t * t * t - t).cast("double")).alias("ties"))
    return g.drop(one) if one else g


#: The exact test of two ranks samples: the smaller one has at most so many values, U takes at most so many.
EXACT_SIDE, EXACT_CELLS = 8, 4_000_000


def mann_whitney(df: DataFrame, by, value: str, group: str, case, side: str = "greater") -> DataFrame:
    """U of the case group, rank-biserial correlation, and the one-sided p: exact where the smaller side has at most ``EXACT_SIDE`` values, no two values
    are equal and U has at most ``EXACT_CELLS`` outcomes, else asymptotic with tie and continuity correction. ``method`` says which. With an
    empty side p is NULL."""
    g = _pair_counts(df, by, value, F.col(group) == F.lit(case))
    n = F.col("n_a") + F.col("n_b")
    m = F.col("n_a") * F.col("n_b")
    sd = F.when(n > 1, F.sqrt(m / 12.0 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1)))))
    dev = F.col("u") - m / 2.0
    z = F.when(sd > 0, ((dev if side == "greater" else -dev) - 0.5) / sd)
    exact = (F.least("n_a", "n_b") <= EXACT_SIDE) & (F.col("ties") == 0) & (m < EXACT_CELLS)
    counted = exact_u(side == "greater")(F.when(exact, F.col("n_a")), F.when(exact, F.col("n_b")), F.when(exact, F.col("u")))
    return (g.withColumn("rank_biserial", F.when(m > 0, 2.0 * F.col("u") / m - 1.0))
            .withColumn("p", F.coalesce(counted, F.when(~exact, normal_sf(z)))).withColumn("method", F.when(exact, "exact").otherwise("asymptotic")).drop("ties"))


def cliffs_delta(df: DataFrame, by, value: str, group: str, case) -> DataFrame:
    """P(case > other) - P(case < other)."""
    g = _pair_counts(df, by, value, F.col(group) == F.lit(case))
    m = F.col("n_a") * F.col("n_b")
    return g.withColumn("delta", F.when(m > 0, 2.0 * F.col("u") / m - 1.0)).drop("u", "ties")


def auroc(df: DataFrame, score: str, label, by=()) -> DataFrame:
    """Area under the ROC curve of ``score`` for a boolean column, ties averaged."""
    g = _pair_counts(df, by, score, F.col(label) if isinstance(label, str) else label)
    m = F.col("n_a") * F.col("n_b")
    return g.withColumn("auroc", F.when(m > 0, F.col("u") / m)).withColumnsRenamed({"n_a": "n_pos", "n_b": "n_neg"}).drop("u", "ties")


def sign_test(df: DataFrame, by, value: str) -> DataFrame:
    g = df.groupBy(*as_list(by)).agg(F.count_if(F.col(value) > 0).alias("n_positive"),
                                     F.count_if(F.col(value) != 0).alias("n_nonzero"))
    return g.withColumn("p", binom_two_sided("n_positive", "n_nonzero"))


def average_ranks(df: DataFrame, by, col: str, out: str) -> DataFrame:
    """Ranks with ties averaged, per distinct value."""
    by = as_list(by)
    v = df.groupBy(*by, F.col(col).cast("double").alias("_v")).agg(n_rows().alias("_c"))
    return (prefix_sums(v, by, "_v", {"_before": "_c"})
            .select(*by, F.col("_v").alias(col), (F.col("_before") + (F.col("_c") + 1) / 2.0).alias(out)))


#: Digits of the ranks by which concordant pairs are told apart.
DIGIT = 16


def _kendall(src: DataFrame, keys, x: str, y: str) -> DataFrame:
    """Kendall's tau-b per group from distributed dominance counts. Ranks of x are cut into digits: two ranks part at one digit, so at every digit
    rows that share the higher ones are counted by digit, and running totals along y give the pairs in which both values rise. The work is one
    row per distinct pair and digit; no group meets in one task."""
    cells = src.groupBy(*keys, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(n_rows().alias("_c"))
    rank = prefix_sums(cells.groupBy(*keys, "_x").agg(F.sum("_c").alias("_t"), F.lit(1).cast("long").alias("_one")), keys, "_x", {"_r": "_one"})
    pairs = lambda c: (F.col(c).cast("decimal(38,0)") * (F.col(c) - 1) / 2).cast("decimal(38,0)")
    size = cells.groupBy(*keys).agg(F.sum("_c").alias("n"), F.sum(pairs("_c")).alias("_same"))
    tied_x = rank.groupBy(*keys).agg(F.sum(pairs("_t")).alias("_tx"), F.max("_r").alias("_most"))
    tied_y = cells.groupBy(*keys, "_y").agg(F.sum("_c").alias("_t")).groupBy(*keys).agg(F.sum(pairs("_t")).alias("_ty"))
    ranked = cells.join(rank.select(*keys, "_x", "_r"), [*keys, "_x"])
    most = tied_x.agg(F.max("_most").alias("m")).first()["m"] or 0
    levels = next(k for k in range(1, 17) if DIGIT ** k > most)
    part = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.floor(F.col("_r") / DIGIT ** (k + 1)).cast("long").alias("high"), (F.floor(F.col("_r") / DIGIT ** k) % DIGIT).cast("int").alias("digit")) for k in range(levels)]))
    cut = ranked.select(*keys, "_y", "_c", part.alias("_e")).select(*keys, "_e.level", "_e.high", "_e.digit", "_y", "_c")
    along = cut.groupBy(*keys, "level", "high", "_y").agg(*[F.sum(F.when(F.col("digit") == d, F.col("_c")).otherwise(0)).alias(f"_d{d}") for d in range(DIGIT)])
    before = prefix_sums(along, [*keys, "level", "high"], "_y", {f"_b{d}": f"_d{d}" for d in range(DIGIT - 1)})
    rises, lower = F.lit(0).cast("decimal(38,0)"), F.lit(0)
    for d in range(1, DIGIT):
        lower = lower + F.col(f"_b{d - 1}")
        rises = rises + F.col(f"_d{d}").cast("decimal(38,0)") * lower
    up = before.groupBy(*keys).agg(F.sum(rises.cast("decimal(38,0)")).alias("_up"))
    g = size.join(tied_x, keys).join(tied_y, keys).join(up, keys)
    double = lambda c: F.col(c).cast("double")
    every = double("n") * (double("n") - 1) / 2
    rest = every - double("_tx") - double("_ty") + double("_same")           # pairs that differ in both
    scale = F.sqrt(every - double("_tx")) * F.sqrt(every - double("_ty"))
    return g.select(*keys, "n", F.when(scale > 0, (2 * double("_up") - rest) / scale).alias("kendall"))


def rank_correlation(df: DataFrame, x: str, y: str, method: str = "spearman", by=()) -> DataFrame:
    """Pearson, Spearman or Kendall (tau-b) correlation per group, over rows with both values. NULL where a side has one value only."""
    by = as_list(by)
    one = None if by else "__all"
    keys = by or [one]
    src = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *by, F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y))
    src = src.withColumn(one, F.lit(1)) if one else src
    if method == "kendall":
        out = _kendall(durable(src.where(~F.isnan(x) & ~F.isnan(y))), keys, x, y)
        return out.drop(one) if one else out
    if method == "spearman":
        src = (src.join(average_ranks(src, keys, x, "_rx"), [*keys, x])
               .join(average_ranks(src, keys, y, "_ry"), [*keys, y]))
        a, b = "_rx", "_ry"
    elif method == "pearson":
        a, b = x, y
    else:
        raise ValueError(f"unknown method {method}")
    out = src.groupBy(*keys).agg(n_rows().alias("n"), F.corr(a, b).alias(method))
    return out.drop(one) if one else out


def cohort_meta(df: DataFrame, enrich: str, p: str, by=()) -> DataFrame:
    """Combine one enrichment per unit: mean log2 with t interval, fold, sign test and Stouffer z."""
    by = as_list(by)
    l2 = F.log2(F.col(enrich))
    src = df.where(F.col(enrich).isNotNull() & ~F.isnan(enrich) & (F.col(enrich) > 0)).withColumn("_z", normal_isf(p))
    g = src.groupBy(*by).agg(
        n_rows().alias("n_units"), F.avg(l2).alias("mean_log2"), (F.stddev_samp(l2) / F.sqrt(n_rows())).alias("_se"),
        F.median(enrich).alias("median_enrich"), F.count_if(F.col(enrich) > 1).alias("n_enrich_gt1"),
        (F.sum("_z") / F.sqrt(n_rows())).alias("stouffer_z"), F.count_if(F.col(p) < 0.05).alias("n_p_lt_05"))
    half = t_quantile(F.lit(0.975), (F.col("n_units") - 1).cast("double")) * F.col("_se")
    g = g.withColumn("_half", half)
    return (g.withColumns({
        "ci_lo": F.col("mean_log2") - F.col("_half"), "ci_hi": F.col("mean_log2") + F.col("_half"),
        "fold": F.pow(F.lit(2.0), F.col("mean_log2")),
        "sign_test_p": binom_two_sided("n_enrich_gt1", "n_units"), "stouffer_p": normal_sf("stouffer_z")})
        .withColumns({"fold_lo": F.pow(F.lit(2.0), F.col("ci_lo")), "fold_hi": F.pow(F.lit(2.0), F.col("ci_hi"))})
        .drop("_se", "_half"))
