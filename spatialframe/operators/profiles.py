"""Expression profiles: module rates, reference profiles, label transfer, marker support.

Counts are long triples (entity, feature, count). An absent triple is a zero: means and shares take their
denominators from the entity table, so zeros need no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import as_list, exact_percentiles, hash_hex, hash_unit, n_rows, rarefied_detection, rate_per
from ..functions.durable import durable
from .entities import sample_cap
from .windows import top_n_per_group


def panel_table(spark: SparkSession, panel: dict[str, list[str]], name: str = "module", feature: str = "feature") -> DataFrame:
    """A fixed marker panel as a broadcast dimension table; its size is that of the literal."""
    rows = [(k, f) for k, fs in panel.items() for f in fs]
    return F.broadcast(spark.createDataFrame(rows, f"{name} string, {feature} string"))


def module_rate(counts: DataFrame, ent: DataFrame, modules: dict[str, list[str]], key: str = "entity_id", depth: str = "n_tx",
                scale: float = 1e4) -> DataFrame:
    """Per entity and module: count, rate per ``scale`` molecules and a positive flag, as wide columns."""
    every = sorted({f for fs in modules.values() for f in fs})
    sums = counts.where(F.col("feature").isin(every)).groupBy(key).agg(*[
        F.sum(F.when(F.col("feature").isin(fs), F.col("count"))).alias(f"_{m}") for m, fs in modules.items()])
    d = ent.join(sums, key, "left")
    out = {}
    for m in modules:
        k = F.coalesce(F.col(f"_{m}"), F.lit(0))
        out |= {f"{m}_k": k, f"{m}_rate": rate_per(k, F.col(depth), scale), f"{m}_pos": k > 0}
    return d.withColumns(out).drop(*[f"_{m}" for m in modules])


def member_rows(df: DataFrame, pops: dict[str, Column], out: str = "population") -> DataFrame:
    """One row per entity and population it belongs to; populations may overlap."""
    return df.withColumn(out, F.explode(F.filter(F.array(*[F.when(c, F.lit(p)) for p, c in pops.items()]), lambda p: p.isNotNull())))


def population_summary(df: DataFrame, pops: dict[str, Column], rate: str, depth: str = "n_tx") -> DataFrame:
    """Per population: size, mean and median rate, share positive and median depth."""
    m = durable(member_rows(df, pops).select("population", rate, depth))
    g = m.groupBy("population").agg(n_rows().alias("n"), F.avg(rate).alias("mean_rate"), F.avg((F.col(rate) > 0).cast("double")).alias("frac_pos"))
    return g.join(exact_percentiles(m, "population", {"median_rate": (rate, .5), "median_depth": (depth, .5)}), "population", "left")


def gene_profile(counts: DataFrame, ent: DataFrame, pops: dict[str, Column], key: str = "entity_id", depth: str = "n_tx", scale: float = 1e4) -> DataFrame:
    """Per population and feature: share of entities with it and mean rate, zeros included."""
    m = member_rows(ent, pops)
    size = m.groupBy("population").agg(n_rows().alias("n"))
    g = (m.select(key, depth, "population").join(counts, key).where("count > 0").groupBy("population", "feature")
         .agg(n_rows().alias("_pos"), F.sum(rate_per(F.col("count"), F.col(depth), scale)).alias("_r")))
    return g.join(size, "population").select("population", "feature", "n", (F.col("_pos") / F.col("n")).alias("frac_pos"), (F.col("_r") / F.col("n")).alias("mean_rate"))


def pseudobulk(counts: DataFrame, ent: DataFrame, group, unit: str = "sample", key: str = "entity_id", depth: str = "n_tx", scale: float = 1e4) -> DataFrame:
    """Per unit and group log1p of the summed rate and the share expressing; then the plain mean over units.

    A unit that holds the group but lacks the feature counts as zero.
    """
    group = as_list(group)
    tot = ent.groupBy(unit, *group).agg(F.sum(depth).alias("_d"), n_rows().alias("_n"))
    units = tot.groupBy(*group).agg(n_rows().alias("n_units"))
    g = (ent.select(key, unit, *group).join(counts, key).where("count > 0").groupBy(unit, *group, "feature")
         .agg(F.sum("count").alias("_s"), n_rows().alias("_p")).join(tot, [unit, *group]))
    expr, frac = F.log1p(rate_per(F.col("_s"), F.col("_d"), scale)), F.col("_p") / F.col("_n")
    return (g.groupBy(*group, "feature").agg(F.sum(expr).alias("_e"), F.sum(frac).alias("_f")).join(units, group)
            .select(*group, "feature", "n_units", (F.col("_e") / F.col("n_units")).alias("expr"), (F.col("_f") / F.col("n_units")).alias("frac_expressing")))


def expr_detect(counts: DataFrame, ent: DataFrame, by, key: str = "entity_id", depth: str = "n_tx", scale: float = 1e4, genes=None) -> DataFrame:
    """Per group and feature: mean log1p rate and detection over all entities of the group, with size and median depth."""
    by = as_list(by)
    size = ent.groupBy(*by).agg(n_rows().alias("n_cells")).join(exact_percentiles(ent, by, {"median_depth": (depth, .5)}), by, "left")
    c = counts.where("count > 0")
    if genes is not None:
        c = c.where(F.col("feature").isin(list(genes)))
    g = (ent.select(key, depth, *by).join(c, key).groupBy(*by, "feature")
         .agg(F.sum(F.log1p(rate_per(F.col("count"), F.col(depth), scale))).alias("_e"), n_rows().alias("_p")))
    return g.join(size, by).select(*by, "feature", "n_cells", "median_depth", (F.col("_e") / F.col("n_cells")).alias("expr"), (F.col("_p") / F.col("n_cells")).alias("detect"))


def dotplot_stats(counts: DataFrame, ent: DataFrame, genes, by=("arm", "cell_type"), **kw) -> DataFrame:
    """Mean log1p rate and share expressing per group and listed gene; genes a group lacks give zero rows."""
    by = as_list(by)
    size = ent.groupBy(*by).agg(n_rows().alias("n"))
    grid = size.withColumn("feature", F.explode(F.array(*[F.lit(g) for g in genes])))
    e = expr_detect(counts, ent, by, genes=genes, **kw).select(*by, "feature", "expr", "detect")
    return grid.join(e, [*by, "feature"], "left").select(*by, "feature", "n", F.coalesce("expr", F.lit(0.0)).alias("mean_expr"), F.coalesce("detect", F.lit(0.0)).alias("frac_expr"))


# --- reference profiles and modules ------------------------------------------------------------------

def reference_profile(counts: DataFrame, obs: DataFrame, by: str = "cell_type", key: str = "entity_id", scale: float = 1e6) -> DataFrame:
    """Per type and feature: rate per ``scale`` of the type's summed counts, and detection rate."""
    n = obs.groupBy(by).agg(n_rows().alias("n_cells"))
    g = (obs.select(key, by).join(counts.where("count > 0"), key).groupBy(by, "feature").agg(F.sum("count").alias("total"), n_rows().alias("_det")))
    depth = g.groupBy(by).agg(F.sum("total").alias("_depth"))
    return g.join(depth, by).join(n, by).select(by, "feature", "n_cells", "total", rate_per(F.col("total"), F.col("_depth"), scale).alias("cpm"), (F.col("_det") / F.col("n_cells")).alias("detection"))


def lineage_scores(prof: DataFrame, lineages: dict[str, list[str]], by: str = "cell_type") -> DataFrame:
    """Per lineage and feature: unweighted mean over its types, largest value among all other types, specificity.

    The profile has one row per type and feature, so a feature's rows are few.
    """
    rows = F.array(*[F.struct(F.lit(n).alias("lineage"), F.array(*[F.lit(t) for t in ts]).alias("members")) for n, ts in lineages.items()])
    x = prof.withColumn("_l", F.explode(rows)).select(by, "feature", "cpm", "detection", "_l.*")
    own = F.array_contains("members", F.col(by))
    g = x.groupBy("lineage", "feature", F.size("members").alias("_k")).agg(
        F.sum(F.when(own, F.col("cpm"))).alias("_c"), F.sum(F.when(own, F.col("detection"))).alias("_d"), F.max(F.when(~own, F.col("cpm"))).alias("_o"))
    cpm, det, oth = F.coalesce(F.col("_c"), F.lit(0.0)) / F.col("_k"), F.coalesce(F.col("_d"), F.lit(0.0)) / F.col("_k"), F.coalesce("_o", F.lit(0.0))
    return g.select("lineage", F.col("feature"), det.alias("detection"), cpm.alias("cpm"), oth.alias("max_other_cpm"), (cpm / F.greatest(oth, F.lit(1e-9))).alias("specificity"))


def derive_modules(prof: DataFrame, lineages, exclude=(), det: float = 0.35, spec: float = 3.0, n: int = 30, universe: DataFrame | None = None) -> DataFrame:
    """Top ``n`` features per lineage by log2(specificity) x detection among those that pass both floors."""
    s = lineage_scores(prof, lineages)
    s = s.where((F.col("detection") >= det) & (F.col("specificity") >= spec) & (F.col("cpm") > 0) & ~F.col("feature").isin(list(exclude)))
    if universe is not None:
        s = s.join(universe.select("feature"), "feature", "left_semi")
    s = s.withColumn("score", F.log2(F.greatest("specificity", F.lit(1e-9))) * F.col("detection"))
    return top_n_per_group(s, "lineage", [F.desc("score"), "feature"], n)


def audit_markers(prof: DataFrame, lineages, lineage: str, genes, modules: DataFrame, det: float = 0.35) -> DataFrame:
    """A hand-written list against the detection floor and the derived module."""
    s = lineage_scores(prof, {lineage: lineages[lineage]}).where(F.col("feature").isin(list(genes)))
    mine = modules.where(F.col("lineage") == lineage).select("feature", F.lit(True).alias("_in"))
    return s.join(mine, "feature", "left").select("feature", "detection", "cpm", "specificity", (F.col("detection") >= det).alias("passes_stability"),
                                                  F.coalesce("_in", F.lit(False)).alias("in_reference_module"))


def centroid_matrix(prof: DataFrame, genes, by: str = "cell_type") -> DataFrame:
    """Type x feature wide table over a given feature list, absent values 0."""
    genes = list(genes)
    return prof.groupBy(by).pivot("feature", genes).agg(F.first("cpm")).fillna(0.0, genes)


def label_coherence(scores: DataFrame, markers: dict[str, list[str]], by: str = "cell_type", z: str = "z", detect: str = "detect",
                    weak_spec: float = 1.5, weak_det: float = 0.05, ns: str = "n_cells") -> DataFrame:
    """Per type: mean z of its own markers, the other type that scores highest on them, detection and flags.

    ``scores`` has one row per type and feature.
    """
    spark = scores.sparkSession
    mk = panel_table(spark, markers, "owner")
    g = scores.join(mk, "feature").groupBy("owner", by).agg(F.avg(z).alias("_z"), F.avg(detect).alias("_d"), F.max(ns).alias("_n"))
    own = F.col("owner") == F.col(by)
    size = F.create_map(*[F.lit(v) for k, fs in markers.items() for v in (k, len(fs))])
    c = g.groupBy("owner").agg(F.max(F.when(own, F.col("_z"))).alias("own_z"), F.max(F.when(~own, F.col("_z"))).alias("best_other_z"),
                               F.max_by(by, F.when(~own, F.struct("_z", by))).alias("most_confusable"),
                               F.max(F.when(own, F.col("_d"))).alias("mean_detection"), F.max(F.when(own, F.col("_n"))).alias("n_cells"))
    c = c.select(F.col("owner").alias(by), size[F.col("owner")].alias("n_markers"), "own_z", "best_other_z", (F.col("own_z") - F.col("best_other_z")).alias("specificity"),
                 "most_confusable", "mean_detection", "n_cells")
    ws, wd = F.col("specificity") < weak_spec, F.col("mean_detection") < weak_det
    return c.withColumns({"weak_specificity": ws, "weak_detection": wd, "flag": F.when(ws & wd, "ambiguous + sparse").when(ws, "ambiguous").when(wd, "sparse").otherwise("ok")})


def canonical_log2fc(counts: DataFrame, labels: DataFrame, panel: dict[str, list[str]], by=(), key: str = "entity_id", label: str = "cell_type", scale: float = 1e4,
                     min_markers: int = 2, min_cells: int = 5, level: str = "type") -> DataFrame:
    """Median over a type's markers of log2((own mean + 1) / (mean of the other types' means + 1)).

    Types need ``min_cells`` entities and ``min_markers`` measured markers. ``level='group'`` gives the median
    over types where at least two were scored.
    """
    by = as_list(by)
    depth = counts.groupBy(key).agg(F.sum("count").alias("_t"))
    kept = labels.where(F.col(label).isin(list(panel))).groupBy(*by, label).agg(n_rows().alias("_n")).where(F.col("_n") >= min_cells)
    measured = counts.select("feature").distinct()
    mk = panel_table(counts.sparkSession, panel, "owner").join(measured, "feature", "left_semi")
    genes = sorted({g for fs in panel.values() for g in fs})
    rate = counts.where(F.col("feature").isin(genes)).join(depth, key).select(key, "feature", rate_per(F.col("count"), F.col("_t"), scale).alias("_r"))
    s = labels.select(*by, key, label).join(rate, key).groupBy(*by, label, "feature").agg(F.sum("_r").alias("_s"))
    # every kept type has a mean for every marker, zero if no entity shows it
    grid = kept.withColumn("feature", F.explode(F.array(*[F.lit(g) for g in genes]))).join(measured, "feature", "left_semi")
    grid = grid.join(s, [*by, label, "feature"], "left")
    mean = grid.select(*by, label, "feature", (F.coalesce("_s", F.lit(0.0)) / F.col("_n")).alias("_m"))
    tot = mean.groupBy(*by, "feature").agg(F.sum("_m").alias("_all"), n_rows().alias("_k"))
    own = mean.join(mk.withColumnRenamed("owner", label), [label, "feature"]).join(tot, [*by, "feature"]).where("_k > 1")
    fc = own.withColumn("_fc", F.log2((F.col("_m") + 1) / ((F.col("_all") - F.col("_m")) / (F.col("_k") - 1) + 1)))
    # at most one value per marker of the panel
    t = fc.groupBy(*by, label).agg(F.median("_fc").alias("log2fc"), n_rows().alias("n_markers")).where(F.col("n_markers") >= min_markers)
    if level == "type":
        return t
    return t.groupBy(*by).agg(F.when(n_rows() >= 2, F.median("log2fc")).alias("canonical_marker_log2fc"), n_rows().alias("n_types_scored"))


def select_anchors(counts: DataFrame, labels: DataFrame, cap: int = 5000, floor: int = 50, n_top: int = 25, seed=0, key: str = "entity_id", label: str = "label") -> DataFrame:
    """Clean, balanced reference entities per class.

    Features most specific to a class (class mean of log1p minus overall mean) give each entity a marker score. In
    classes above ``floor`` entities, those at or above the 10th depth percentile and the median score are kept, or
    only the depth rule where that leaves fewer than ``floor``; at most ``cap`` are drawn by hash rank.
    """
    lg = counts.where("count > 0").select(key, "feature", F.log1p("count").alias("_l"), "count")
    n_class = labels.groupBy(label).agg(n_rows().alias("_n"))
    n_all = labels.agg(n_rows().alias("_every"))
    joined = lg.join(labels.select(key, label), key)
    per = joined.groupBy(label, "feature").agg(F.sum("_l").alias("_s"))
    overall = per.groupBy("feature").agg(F.sum("_s").alias("_all"))
    score = (per.join(overall, "feature").join(n_class, label).join(F.broadcast(n_all))
             .select(label, "feature", (F.col("_s") / F.col("_n") - F.col("_all") / F.col("_every")).alias("_spec")))
    top = top_n_per_group(score, label, [F.desc("_spec"), "feature"], n_top).select(label, "feature", F.lit(True).alias("_top"))
    ent = (joined.join(top, [label, "feature"], "left").groupBy(key, label)
           .agg(F.sum("count").alias("depth"), F.coalesce(F.sum(F.when(F.col("_top"), F.col("_l"))), F.lit(0.0)).alias("score")))
    ent = durable(ent)
    cuts = exact_percentiles(ent, label, {"_d10": ("depth", .1), "_m50": ("score", .5)})
    e = ent.join(cuts, label).join(n_class, label)
    deep = F.col("depth") >= F.col("_d10")
    both = deep & (F.col("score") >= F.col("_m50"))
    n_both = e.groupBy(label).agg(F.count_if(both).alias("_b"))
    e = e.join(n_both, label).where(F.when(F.col("_n") <= floor, F.lit(True)).when(F.col("_b") < floor, deep).otherwise(both))
    return sample_cap(e.select(key, label, "depth", "score"), label, cap, seed, key)


# --- similarity to class centroids -------------------------------------------------------------------

def lognorm(counts: DataFrame, key: str = "entity_id", scale: float = 1e4) -> DataFrame:
    """log1p of the per-entity rate, over the features present in ``counts``."""
    tot = counts.groupBy(key).agg(F.sum("count").alias("_t"))
    return counts.join(tot, key).select(key, "feature", F.log1p(F.col("count") / F.when(F.col("_t") == 0, 1.0).otherwise(F.col("_t")) * scale).alias("value"))


def class_centroids(long: DataFrame, labels: DataFrame, key: str = "entity_id", label: str = "label") -> DataFrame:
    """Mean profile per class over its entities; absent values are zeros."""
    n = labels.groupBy(label).agg(n_rows().alias("_n"))
    return (long.join(labels.select(key, label), key).groupBy(label, "feature").agg(F.sum("value").alias("_s"))
            .join(n, label).select(label, "feature", (F.col("_s") / F.col("_n")).alias("value")))


def score_centroids(long: DataFrame, cent: DataFrame, key: str = "entity_id", label: str = "label") -> DataFrame:
    """Cosine of every entity to every class centroid.

    The centroid of a feature is folded into one array per feature before the join, so each triple meets its feature
    once and adds to all classes in a partial sum; classes are few. An all-zero profile scores 0 everywhere.
    """
    nc = cent.groupBy(label).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_cn"))
    unit = cent.join(nc, label).where("_cn > 0").select("feature", label, (F.col("value") / F.col("_cn")).alias("w"))
    per = unit.groupBy("feature").agg(F.collect_list(F.struct(label, "w")).alias("_w"))
    norm = long.groupBy(key).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_qn"))
    dots = (long.join(per, "feature").select(key, "value", F.explode("_w").alias("_c"))
            .groupBy(key, F.col(f"_c.{label}").alias(label)).agg(F.sum(F.col("value") * F.col("_c.w")).alias("_d")))
    classes = unit.select(label).distinct().agg(F.collect_list(label).alias("_all"))
    grid = norm.join(F.broadcast(classes)).select(key, "_qn", F.explode("_all").alias(label))
    return grid.join(dots, [key, label], "left").select(key, label, F.coalesce(F.col("_d") / F.when(F.col("_qn") > 0, F.col("_qn")), F.lit(0.0)).alias("cosine"))


def transfer_labels(scores: DataFrame, t: float = 0.05, key: str = "entity_id", label: str = "label") -> DataFrame:
    """Softmax over class cosines at temperature ``t``: best and second label with their probabilities.

    Equal cosines go to the first label in order.
    """
    g = scores.groupBy(key).agg(F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("m"), F.col(label).alias("l")))).alias("_s"))
    top = F.col("_s")[0]["m"]
    z = F.aggregate("_s", F.lit(0.0), lambda a, s: a + F.exp((top - s["m"]) / max(t, 1e-6)))
    second = F.get("_s", F.lit(1))
    return g.select(key, F.col("_s")[0]["l"].alias("transferred_label"), (1.0 / z).alias("transfer_confidence"),
                    second["l"].alias("second_label"), (F.exp((top - second["m"]) / max(t, 1e-6)) / z).alias("second_confidence"))


def transfer_qc(annot: DataFrame, low: float = 0.4) -> DataFrame:
    c = F.col("transfer_confidence")
    return annot.agg(n_rows().alias("n_query"), F.count_if(c < low).alias("low_confidence_count"),
                     F.avg((c < low).cast("double")).alias("low_confidence_fraction"), F.avg(c).alias("mean_confidence"))


def reference_similarity(counts: DataFrame, cent: DataFrame, depth: DataFrame | None = None, key: str = "entity_id", label: str = "cell_type", scale: float = 1e6) -> DataFrame:
    """log1p rate profile against each lineage centroid: cosine table reduced to the best lineage."""
    d = depth if depth is not None else counts.groupBy(key).agg(F.sum("count").alias("n_tx"))
    x = counts.join(d, key).select(key, "feature", F.log1p(rate_per(F.col("count"), F.col("n_tx"), scale)).alias("value"))
    s = score_centroids(x, cent, key, label)
    return s.groupBy(key).agg(F.max("cosine").alias("cosine"),
                              F.min_by(label, F.struct((-F.col("cosine")).alias("m"), label)).alias("best"))


# --- marker support, thinning, neighbours ------------------------------------------------------------

def marker_support(counts: DataFrame, labels: DataFrame, lineages: dict[str, list[str]], key: str = "entity_id", label: str = "label", scale: float = 1e3) -> DataFrame:
    """Is the own lineage among the two best marker scores? The strict flag also wants a score above zero.

    Only features that were measured anywhere enter a lineage's mean. Equal scores (to 12 digits) rank in lineage order.
    """
    spark = counts.sparkSession
    tot = counts.groupBy(key).agg(F.sum("count").alias("_t"))
    order = list(lineages)
    mk = panel_table(spark, lineages, "lineage").join(counts.select("feature").distinct(), "feature", "left_semi")
    size = mk.groupBy("lineage").agg(n_rows().alias("_k"))
    s = (counts.join(F.broadcast(mk), "feature").join(tot, key).groupBy(key, "lineage")
         .agg(F.sum(F.log1p(F.col("count") / F.col("_t") * scale)).alias("_s")).join(F.broadcast(size), "lineage")
         .groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("lineage", F.round(F.col("_s") / F.col("_k"), 12)))).alias("_m")))
    d = labels.select(key, label).join(s, key, "left")
    score = lambda n: F.coalesce(F.try_element_at("_m", F.lit(n)), F.lit(0.0))
    d = d.withColumn("_a", F.array(*[F.struct(F.lit(n).alias("l"), F.lit(i).alias("i"), score(n).alias("s")) for i, n in enumerate(order)]))
    own = F.get(F.filter("_a", lambda e: e["l"] == F.col(label)), F.lit(0))
    d = d.withColumn("_o", own)
    ahead = F.size(F.filter("_a", lambda e: (e["s"] > F.col("_o.s")) | ((e["s"] == F.col("_o.s")) & (e["i"] < F.col("_o.i")))))
    lenient = F.col("_o").isNotNull() & (ahead <= 1)
    return d.select(key, label, F.coalesce(F.col("_o.s"), F.lit(0.0)).alias("own_score"), lenient.alias("marker_supported"),
                    F.coalesce(lenient & (F.col("_o.s") > 0), F.lit(False)).alias("marker_supported_strict"),
                    (F.array_max(F.transform("_a", lambda e: e["s"])) == 0).alias("no_marker_signal"))


def thin_counts(counts: DataFrame, target: DataFrame, seed, key: str = "entity_id") -> DataFrame:
    """Binomial thinning to a target depth: each molecule is kept with probability target / depth.

    ``target`` holds (key, target). A count is expanded molecule by molecule inside its own row, so nothing is
    shuffled for it.
    """
    tot = counts.groupBy(key).agg(F.sum("count").alias("_t"))
    j = counts.join(tot, key).join(target, key).withColumn("_p", F.least(F.lit(1.0), F.col("target") / F.greatest("_t", F.lit(1))))
    kept = F.size(F.filter(F.sequence(F.lit(1).cast("bigint"), F.col("count").cast("bigint")),
                           lambda i: hash_unit(seed, F.col(key), F.col("feature"), i) < F.col("_p")))
    return j.where("count > 0").select(key, "feature", kept.cast("bigint").alias("count")).where("count > 0")


def label_stability(full: DataFrame, thin: DataFrame, key: str = "entity_id", label: str = "label") -> DataFrame:
    """Share of labels kept after thinning, per original label."""
    return (full.select(key, F.col(label).alias("_f")).join(thin.select(key, F.col(label).alias("_t")), key)
            .groupBy(F.col("_f").alias(label)).agg(F.avg((F.col("_f") == F.col("_t")).cast("double")).alias("label_kept"), n_rows().alias("n")))


def knn_coherence(knn: DataFrame, labels: DataFrame, key: str = "id", label: str = "label") -> DataFrame:
    """Share of neighbours with the same label per type, against the type's frequency."""
    a = labels.select(F.col(key).alias("id"), F.col(label).alias("_a"))
    b = labels.select(F.col(key).alias("neighbor_id"), F.col(label).alias("_b"))
    per = (knn.join(a, "id").join(b, "neighbor_id").groupBy("id", "_a").agg(F.avg((F.col("_a") == F.col("_b")).cast("double")).alias("_s")))
    n = labels.agg(n_rows().alias("_every"))
    g = per.groupBy(F.col("_a").alias(label)).agg(F.avg("_s").alias("knn_same_label"))
    size = labels.groupBy(label).agg(n_rows().alias("n"))
    return (size.join(g, label, "left").join(F.broadcast(n))
            .select(label, "n", "knn_same_label", (F.col("n") / F.col("_every")).alias("baseline_type_freq"), (F.col("knn_same_label") / (F.col("n") / F.col("_every"))).alias("enrichment")))


def ref_marker_support(counts: DataFrame, labels: DataFrame, panel: dict[str, list[str]], key: str = "entity_id", label: str = "label") -> DataFrame:
    """Per marker: mean log-normalised value in its own class, the class with the highest mean, and the margin
    over the best other class."""
    cent = class_centroids(lognorm(counts, key).where(F.col("feature").isin(sorted({g for fs in panel.values() for g in fs}))), labels, key, label)
    classes = labels.select(label).distinct()
    mk = F.array(*[F.struct(F.lit(o).alias("owner"), F.lit(g).alias("feature")) for o, gs in panel.items() for g in gs])
    # every class has a mean for every marker, zero where nothing was seen
    grid = classes.select(label, F.inline(mk)).join(cent, [label, "feature"], "left").withColumn("_v", F.coalesce("value", F.lit(0.0)))
    own = F.col("owner") == F.col(label)
    g = grid.groupBy("owner", "feature").agg(
        F.max(F.when(own, F.col("_v"))).alias("ref_mean_own"), F.min_by(label, F.struct((-F.col("_v")).alias("m"), label)).alias("ref_top_class"),
        F.max(F.when(~own, F.col("_v"))).alias("_next"), F.max(F.col("value").isNotNull()).alias("in_reference"))
    seen = F.col("in_reference")
    return g.select("owner", "feature", "in_reference", F.when(seen, F.col("ref_mean_own")).alias("ref_mean_own"), F.when(seen, F.col("ref_top_class")).alias("ref_top_class"),
                    F.when(seen, F.col("ref_top_class") == F.col("owner")).alias("ref_own_is_top"), F.when(seen, F.col("ref_mean_own") - F.col("_next")).alias("ref_own_over_next"))
