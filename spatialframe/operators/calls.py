"""Comparison of segmentation methods on per-entity calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import as_list, n_rows, exact_percentiles
from .stats import signflip_exact
from .windows import top_n_per_group

BY = ["setting", "method"]


def call_composition(calls: DataFrame, levels, by=BY) -> DataFrame:
    """Entities per call, unscored entities included, with zero rows for absent calls."""
    by = as_list(by)
    n = calls.groupBy(*by, F.coalesce("call", F.lit("unscored")).alias("call")).agg(n_rows().alias("n"))
    grid = n.select(*by).distinct().withColumn("call", F.explode(F.array(*[F.lit(v) for v in levels])))
    return grid.join(n, [*by, "call"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def method_summary(calls: DataFrame, singlet: str = "singlet", by=BY) -> DataFrame:
    by = as_list(by)
    scored = F.col("call").isNotNull()
    a = calls.groupBy(*by).agg(
        n_rows().alias("n_entities"), F.count_if(scored).alias("n_scored"),
        F.avg((~scored).cast("double")).alias("frac_unscored"),
        F.count_if(F.col("call") == singlet).alias("n_singlet"),
        (F.count_if(F.col("call") == singlet) / n_rows()).alias("singlet_frac_of_entities"))
    q = exact_percentiles(calls.where(scored), by, {"max_weight_median": ("max_weight", .5), "entropy_median": ("entropy", .5)})
    return a.join(q, by, "left")


def choose_best(summary: DataFrame, by="setting", metric: str = "n_singlet", name: str = "method") -> DataFrame:
    """All candidates, with a flag on the one that has the largest metric (ties: first name)."""
    by = as_list(by)
    best = top_n_per_group(summary.select(*by, name, metric), by, [F.desc(metric), name], 1)
    return summary.join(best.select(*by, F.col(name).alias("_best")), by, "left").withColumn(
        "chosen", F.col(name).eqNullSafe(F.col("_best"))).drop("_best")


def arm_counts(df: DataFrame, label: str = "label", arm: str = "arm", conf: str = "confidence", depth: str = "n_tx",
               low: float = 0.4) -> DataFrame:
    """Per arm and type, and per arm over all types: size, share, median depth, confidence."""
    both = df.withColumn("_level", F.explode(F.array(F.col(label), F.lit("ALL"))))
    g = both.groupBy(arm, "_level").agg(
        n_rows().alias("n"), F.avg(conf).alias("mean_conf"), F.avg((F.col(conf) < low).cast("double")).alias("low_conf_frac"))
    q = exact_percentiles(both, [arm, "_level"], {"median_tx": (depth, .5)})
    tot = g.where("_level = 'ALL'").select(arm, F.col("n").alias("_t"))
    return (g.join(q, [arm, "_level"], "left").join(tot, arm)
            .withColumn("frac_of_arm", F.col("n") / F.col("_t")).drop("_t").withColumnRenamed("_level", label))


def paired_vs_baseline(df: DataFrame, baseline: str, unit: str = "setting", name: str = "method", metric: str = "metric",
                       value: str = "value") -> DataFrame:
    """Per method and metric: differences to the baseline over the units, and the exact sign-flip p."""
    base = df.where(F.col(name) == baseline).select(unit, metric, F.col(value).alias("_base"))
    d = (df.where(F.col(name) != baseline).join(base, [unit, metric])
         .withColumn("_d", F.col(value) - F.col("_base")).where("_d is not null"))
    g = d.groupBy(name, metric).agg(n_rows().alias("n_units"), F.median("_d").alias("median_delta"),
                                    F.min("_d").alias("min_delta"), F.max("_d").alias("max_delta"),
                                    F.count_if(F.col("_d") > 0).alias("n_positive"))
    return g.join(signflip_exact(d, [name, metric], "_d").select(name, metric, "p"), [name, metric], "left")


def pooled_stratum(df: DataFrame, strata, pooled: str, name: str = "method") -> DataFrame:
    """Repeat the rows of some strata under a pooled name, without reading the input twice."""
    hit = F.col(name).isin(as_list(strata))
    return df.withColumn(name, F.explode(F.when(hit, F.array(F.col(name), F.lit(pooled))).otherwise(F.array(F.col(name)))))


def reproduction_gate(got: DataFrame, want: DataFrame, key, value: str, tol: float = 1e-5) -> DataFrame:
    """Largest difference to published values on shared keys, and whether all keys are there."""
    key = as_list(key)
    j = (got.select(*key, F.col(value).alias("_g"))
         .join(want.select(*key, F.col(value).alias("_w")), key, "full_outer"))
    both = F.col("_g").isNotNull() & F.col("_w").isNotNull()
    return j.agg(F.count_if(both).alias("n_compared"), F.count_if(~both).alias("n_missing"),
                 F.max(F.abs(F.col("_g") - F.col("_w"))).alias("max_abs_diff")).withColumn(
        "passed", (F.col("n_missing") == 0) & (F.col("max_abs_diff") < tol))


def resource_table(usage: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Run resources in hours and GiB, with a flag where memory used passes the memory asked for."""
    name = F.col("method")
    if aliases:
        m = F.create_map(*[F.lit(v) for kv in aliases.items() for v in kv])
        name = F.coalesce(F.try_element_at(m, F.col("method")), F.col("method"))
    return usage.select(
        *[c for c in usage.columns if c == "setting"], name.alias("method"),
        (F.col("wall_clock_seconds") / 3600.0).alias("wall_h"), F.col("peak_host_rss_gb").alias("host_rss_gib"),
        F.col("host_memory_requested_gb").alias("host_req_gib"), (F.col("peak_gpu_vram_mb") / 1024.0).alias("gpu_vram_gib"),
        (F.col("peak_host_rss_gb") > F.col("host_memory_requested_gb")).alias("over_request"))


def log_attempts(lines: DataFrame, submitted: str, retried: str, ignored: str, col: str = "value", by=(),
                 not_applicable: DataFrame | None = None) -> DataFrame:
    """Retry history from log lines: attempts and final status per process.

    ``submitted`` and ``ignored`` capture the process name, ``retried`` the name and the retry number.
    """
    by = as_list(by)
    c = F.col(col)
    seen = lines.select(*by, F.explode(F.regexp_extract_all(c, F.lit(submitted), 1)).alias("process"))
    zero = seen.select(*by, "process", F.lit(0).alias("retries"), F.lit(False).alias("ignored"))
    again = lines.select(*by, F.explode(F.arrays_zip(
        F.regexp_extract_all(c, F.lit(retried), 1).alias("process"),
        F.regexp_extract_all(c, F.lit(retried), 2).alias("n"))).alias("r")).select(
        *by, "r.process", F.col("r.n").cast("int").alias("retries"), F.lit(False).alias("ignored"))
    gone = lines.select(*by, F.explode(F.regexp_extract_all(c, F.lit(ignored), 1)).alias("process")).select(
        *by, "process", F.lit(0).alias("retries"), F.lit(True).alias("ignored"))
    out = (zero.unionByName(again).unionByName(gone).groupBy(*by, "process")
           .agg((F.max("retries") + 1).alias("attempts"), F.max("ignored").alias("_x"))
           .select(*by, "process", "attempts", F.when(F.col("_x"), "failed").otherwise("success").alias("status")))
    return out if not_applicable is None else out.unionByName(not_applicable.withColumns(
        {"attempts": F.lit(0), "status": F.lit("not applicable")}))


def tidy_metrics(df: DataFrame, metrics, aliases: dict[str, str] | None = None, methods=None, key=("setting",)) -> DataFrame:
    """Long metric table: alias names resolved first, wanted metrics kept, one row per key, method and metric.

    Two different values under one key stop the job instead of the first one winning silently.
    """
    key = as_list(key)
    name = F.col("method")
    if aliases:
        m = F.create_map(*[F.lit(v) for kv in aliases.items() for v in kv])
        name = F.coalesce(F.try_element_at(m, F.col("method")), F.col("method"))
    d = df.withColumn("method", name).where(F.col("metric").isin(list(metrics)) & F.col("value").isNotNull())
    if methods is not None:
        d = d.where(F.col("method").isin(list(methods)))
    g = d.groupBy(*key, "method", "metric").agg(F.min("value").alias("value"), F.max("value").alias("_hi"))
    clash = F.raise_error(F.concat_ws(" ", F.lit("conflicting values for"), F.col("method"), F.col("metric")))
    return g.withColumn("value", F.when(F.col("value") == F.col("_hi"), F.col("value")).otherwise(clash.cast("double"))).drop("_hi")
