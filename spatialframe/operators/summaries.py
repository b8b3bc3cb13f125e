"""Grouped summaries of entity and molecule tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import as_list, n_rows, exact_percentiles, rate_per
from .entities import classify_axis
from .windows import fixed_order



def inventory(before: DataFrame, after: DataFrame, by="cell_type") -> DataFrame:
    """Entities per type in the original and the refined segmentation, split by whole and partial."""
    by = as_list(by)
    a = before.groupBy(*by).agg(n_rows().alias("original"))
    b = after.groupBy(*by).agg(F.count_if(F.col("etype") == "cell").alias("complete"),
                               F.count_if(F.col("etype") == "partial").alias("partial"), n_rows().alias("total"))
    j = a.join(b, by, "full_outer").fillna(0, ["original", "complete", "partial", "total"])
    return j.withColumn("fold", F.when(F.col("original") > 0, F.col("total") / F.col("original")))


def composition(df: DataFrame, by, col: str, levels) -> DataFrame:
    """Share of each level of ``col`` per group, with zero rows for levels a group lacks."""
    by = as_list(by)
    n = df.groupBy(*by, col).agg(n_rows().alias("n"))
    tot = n.groupBy(*by).agg(F.sum("n").alias("total"))
    grid = tot.withColumn(col, F.explode(F.array(*[F.lit(v) for v in levels])))
    out = grid.join(n, [*by, col], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("fraction", F.col("n") / F.col("total")).drop("total")


# --- molecule states ---------------------------------------------------------------------------------

# state codes of a molecule (fixed values)
CLASSES = {0: "original cell", 1: "partial", 3: "unassigned", 5: "neighboring cell"}


def _class_name(col: str) -> Column:
    m = F.create_map(*[F.lit(v) for kv in CLASSES.items() for v in kv])
    return F.coalesce(F.try_element_at(m, F.col(col).cast("int")), F.col(col).cast("string"))


def phase_counts(mol: DataFrame, phases: list[str], head: str = "etype_at_") -> DataFrame:
    """Molecules per state at every phase, in one pass."""
    long = mol.select(F.explode(F.array(*[
        F.struct(F.lit(p).alias("phase"), F.col(head + p).cast("int").alias("etype")) for p in phases])).alias("s")).select("s.*")
    return long.groupBy("phase", "etype").agg(n_rows().alias("n")).withColumn("cls", _class_name("etype"))


def phase_transitions(mol: DataFrame, pairs, head: str = "etype_at_") -> DataFrame:
    """(from, to) counts for every given pair of phases, in one pass."""
    pairs = list(dict.fromkeys(tuple(p) for p in pairs))
    long = mol.select(F.explode(F.array(*[
        F.struct(F.lit(f"{a}->{b}").alias("transition"), F.col(head + a).cast("int").alias("_a"),
                 F.col(head + b).cast("int").alias("_b")) for a, b in pairs])).alias("s")).select("s.*")
    return (long.groupBy("transition", "_a", "_b").agg(n_rows().alias("n"))
            .select("transition", _class_name("_a").alias("src"), _class_name("_b").alias("dst"), "n"))


def fate_conditions(e_in: str = "etype_at_input", e_out: str = "etype_at_finalize", own_in: str = "entity_id",
                    own_out: str = "owner_out") -> dict[str, Column]:
    """Every fate quantity as a row condition; shared by the batch and the streaming job."""
    i, o = F.col(e_in), F.col(e_out)
    same = F.col(own_in).eqNullSafe(F.col(own_out))
    placed = o.isin(0, 1, 5)
    return {
        "total": F.lit(True), "in_orig_cell": i == 0, "in_unassigned": i == 3, "out_orig_cell": o == 0,
        "out_partial": o == 1, "out_neighboring": o == 5, "out_unassigned": o == 3,
        "redistributed": (i == 0) & placed & ~same, "kept_in_place": (i == 0) & placed & same,
        "recovered_from_unassigned": (i == 3) & placed, "unassigned_to_partial": (i == 3) & (o == 1),
        "unassigned_to_cell": (i == 3) & (o == 0), "origcell_to_partial": (i == 0) & (o == 1),
        "lost_to_unassigned": (i == 0) & (o == 3)}


def fate_rows(wide: DataFrame) -> DataFrame:
    names = list(fate_conditions())
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("quantity"), F.col(n).alias("n"),
                 F.when(F.col("total") > 0, 100.0 * F.col(n) / F.col("total")).alias("pct_of_total")) for n in names])))


def molecule_fate(mol: DataFrame, **cols) -> DataFrame:
    """Where molecules went between the first and the last phase."""
    return fate_rows(mol.agg(*[F.count_if(c).alias(n) for n, c in fate_conditions(**cols).items()]))


def count_matrix(mol: DataFrame, key: str = "entity_id", feature: str = "feature") -> DataFrame:
    """Entity x feature counts as triples."""
    return mol.groupBy(key, feature).agg(n_rows().alias("count"))


def centroids(mol: DataFrame, key: str = "entity_id") -> DataFrame:
    return mol.groupBy(key).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), n_rows().alias("n_tx"))


# --- entity summaries --------------------------------------------------------------------------------

def pool_weighted(df: DataFrame, by, stratum: str, value: str, weight: str, n_strata: int = 2) -> DataFrame:
    """Exact pooling of strata means by their sizes, only where all strata exist."""
    return (df.groupBy(*as_list(by))
            .agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias(value), F.sum(weight).alias(weight),
                 F.count_distinct(stratum).alias("_k"))
            .where(F.col("_k") == n_strata).drop("_k"))


def equal_weight_mean(df: DataFrame, by, unit: str, value: str, weight: str) -> DataFrame:
    return df.groupBy(*as_list(by)).agg(F.avg(value).alias(value), F.count_distinct(unit).alias("n_units"),
                                        F.sum(weight).alias(weight))


def depth_summary(df: DataFrame, by, col: str) -> DataFrame:
    by = as_list(by)
    q = exact_percentiles(df, by, {"median": (col, .5), "q25": (col, .25), "q75": (col, .75)})
    return df.groupBy(*by).agg(n_rows().alias("n"), F.sum(col).alias("total")).join(q, by, "left")


def composition_without(df: DataFrame, col: str, study: str, drop) -> DataFrame:
    """Counts and shares with and without one study, and the part of each level the study contributed."""
    keep = F.col(study) != F.lit(drop)
    g = df.groupBy(col).agg(n_rows().alias("n_full"), F.count_if(keep).alias("n_without"))
    tot = g.agg(F.sum("n_full").alias("_f"), F.sum("n_without").alias("_w"))
    return (g.join(F.broadcast(tot))
            .select(col, "n_full", "n_without", (F.col("n_full") / F.col("_f")).alias("frac_full"),
                    F.when(F.col("_w") > 0, F.col("n_without") / F.col("_w")).alias("frac_without"),
                    ((F.col("n_full") - F.col("n_without")) / F.col("n_full")).alias("contributed")))


def area_density(ent: DataFrame, arms: dict[str, Column], classes: dict[str, str], by="sample", tile: float = 100.0,
                 unit_per_mm: float = 1000.0) -> DataFrame:
    """Tissue area from occupied tiles, fixed per sample, and entities of a class per mm2 in every arm."""
    by = as_list(by)
    tiles = (ent.select(*by, F.floor(F.col("x") / tile).alias("_tx"), F.floor(F.col("y") / tile).alias("_ty"))
             .distinct().groupBy(*by).agg((n_rows() * (tile / unit_per_mm) ** 2).alias("area_mm2")))
    long = arm_rows(ent, arms)
    n = long.groupBy(*by, "arm").agg(*[F.count_if(F.col("cell_type") == c).alias(f"n_{k}") for k, c in classes.items()])
    return n.join(tiles, by).withColumns({f"{k}_per_mm2": F.col(f"n_{k}") / F.col("area_mm2") for k in classes})


def arm_rows(ent: DataFrame, arms: dict[str, Column]) -> DataFrame:
    """One row per entity and arm it belongs to; arms become a column instead of a loop."""
    return ent.withColumn("arm", F.explode(F.filter(
        F.array(*[F.when(c, F.lit(a)) for a, c in arms.items()]), lambda a: a.isNotNull())))


def axis_evaluable(ent: DataFrame, axes, by, n: int = 10) -> DataFrame:
    """Per axis and group: positives on both sides and whether both reach ``n``.

    ``axes`` is a list of (name, ligand column, ligand classes, receptor column, receptor classes).
    """
    by = as_list(by)
    sides = []
    for i, (_, lg, lc, rg, rc) in enumerate(axes):
        sides += [F.count_if((F.col(lg) > 0) & F.col("cell_type").isin(as_list(lc))).alias(f"a{i}"),
                  F.count_if((F.col(rg) > 0) & F.col("cell_type").isin(as_list(rc))).alias(f"t{i}")]
    wide = ent.groupBy(*by).agg(*sides)
    rows = F.array(*[F.struct(F.lit(name).alias("axis"), F.col(f"a{i}").alias("n_anchor_pos"), F.col(f"t{i}").alias("n_target_pos"))
                     for i, (name, *_) in enumerate(axes)])
    return wide.select(*by, F.inline(rows)).withColumn("evaluable", (F.col("n_anchor_pos") >= n) & (F.col("n_target_pos") >= n))


def axis_matrix(evaluable: DataFrame, sample: str = "sample", arm: str = "arm") -> DataFrame:
    """Axis x sample category, axes ranked by their median anchor count in the last arm."""
    p = lambda a, c: F.max(F.when(F.col(arm) == a, F.col(c)))
    wide = evaluable.groupBy("axis", sample).agg(
        p("pre", "evaluable").alias("pre"), p("post_whole", "evaluable").alias("post_whole"),
        p("post_all", "evaluable").alias("post_all"), p("pre", "n_anchor_pos").alias("anchor_pre"),
        p("post_whole", "n_anchor_pos").alias("anchor_whole"))
    order = exact_percentiles(evaluable.where(F.col(arm) == "post_all"), "axis", {"median_anchor": ("n_anchor_pos", .5)})
    return classify_axis(wide).join(order, "axis", "left").select("axis", sample, "category", "median_anchor")


def distance_summary(df: DataFrame, by, col: str) -> DataFrame:
    by = as_list(by)
    q = exact_percentiles(df, by, {"median": (col, .5), "q25": (col, .25), "q75": (col, .75)})
    return df.groupBy(*by).agg(F.count(col).alias("n"), F.avg(col).alias("mean")).join(q, by, "left")


def binned_trend(df: DataFrame, x: str, y: str, edges: list[float] | None = None, q: int | None = None, by=()) -> DataFrame:
    """Mean, standard error and n of ``y`` over bins of ``x``: fixed edges, or ``q`` quantile bins.

    Fixed bins are half-open with a closed last edge; quantile bins are closed on the right, with the lowest
    value included and repeated cut points dropped.
    """
    by = as_list(by)
    v = F.col(x)
    src = df.where(v.isNotNull() & F.col(y).isNotNull())
    if edges is not None:
        b = F.array(*[F.lit(float(e)) for e in edges])
        idx = (F.when((v < edges[0]) | (v > edges[-1]), None)
                .when(v == edges[-1], len(edges) - 2)
                .otherwise(F.size(F.filter(b, lambda e: e <= v)) - 1))
        src = src.withColumns({"_lo": F.get(b, idx), "_hi": F.get(b, idx + 1), "bin": idx})
    else:
        cuts = exact_percentiles(src, by, {f"c{i}": (x, i / q) for i in range(q + 1)})
        cuts = cuts.select(*by, F.array_distinct(F.array(*[f"c{i}" for i in range(q + 1)])).alias("_b"))
        src = src.join(F.broadcast(cuts)) if not by else src.join(cuts, by)
        idx = F.greatest(F.size(F.filter("_b", lambda e: e < v)) - 1, F.lit(0))
        src = src.withColumns({"_lo": F.get("_b", idx), "_hi": F.get("_b", idx + 1), "bin": idx})
    return (src.where("bin is not null").groupBy(*by, "bin")
            .agg(F.max("_lo").alias("lo"), F.max("_hi").alias("hi"), F.avg(y).alias("mean"),
                 (F.stddev_samp(y) / F.sqrt(n_rows())).alias("sem"), n_rows().alias("n")))


def grid_domains(ent: DataFrame, size: float = 25.0, floor: float = 0.25, by="sample") -> DataFrame:
    """Grid cells in which a type holds at least ``floor`` of the entities, with the cell centre."""
    by = as_list(by)
    b = ent.select(*by, "cell_type", F.floor(F.col("x") / size).alias("_bx"), F.floor(F.col("y") / size).alias("_by"))
    n = b.groupBy(*by, "_bx", "_by", "cell_type").agg(n_rows().alias("n"))
    tot = n.groupBy(*by, "_bx", "_by").agg(F.sum("n").alias("n_bin"))
    return (n.join(tot, [*by, "_bx", "_by"]).withColumn("fraction", F.col("n") / F.col("n_bin"))
            .where(F.col("fraction") >= floor)
            .select(*by, "cell_type", "n", "n_bin", "fraction",
                    (F.col("_bx") * size + size / 2).alias("cx"), (F.col("_by") * size + size / 2).alias("cy")))


def row_centre(df: DataFrame, by, col: str, out: str = "centred") -> DataFrame:
    """Subtract the group median."""
    by = as_list(by)
    return (df.join(exact_percentiles(df, by, {"_med": (col, .5)}), by, "left")
            .withColumn(out, F.col(col) - F.col("_med")).drop("_med"))


def pivot_wide(df: DataFrame, index, columns: str, value: str, levels, diff: tuple[str, str] | None = None) -> DataFrame:
    """Long -> wide over given levels; ``diff = (a, b)`` adds a minus b."""
    out = df.groupBy(*as_list(index)).pivot(columns, list(levels)).agg(F.avg(value))
    return out.withColumn(f"{diff[0]}_minus_{diff[1]}", F.col(diff[0]) - F.col(diff[1])) if diff else out


def zscore_by(df: DataFrame, by, col: str, zero: str = "null0", out: str = "z") -> DataFrame:
    """Standard score within a group (sample sd). A constant group gives 0 ('null0') or is divided by 1 ('one')."""
    by = as_list(by)
    st = df.groupBy(*by).agg(F.avg(col).alias("_m"), F.stddev_samp(col).alias("_s"))
    flat = F.col("_s").isNull() | (F.col("_s") == 0)
    z = F.when(flat, F.lit(0.0) if zero == "null0" else F.col(col) - F.col("_m")).otherwise((F.col(col) - F.col("_m")) / F.col("_s"))
    return df.join(st, by).withColumn(out, z).drop("_m", "_s")


def robust_limits(df: DataFrame, cols, p=(0.2, 99.8), pad: float = 0.03, by=()) -> DataFrame:
    """Percentile box with padding, one row per group."""
    by = as_list(by)
    specs = {}
    for c in as_list(cols):
        specs[f"{c}_lo"], specs[f"{c}_hi"] = (c, p[0] / 100), (c, p[1] / 100)
    q = exact_percentiles(df, by, specs)
    out = {}
    for c in as_list(cols):
        w = (F.col(f"{c}_hi") - F.col(f"{c}_lo")) * pad
        out[f"{c}_lo"], out[f"{c}_hi"] = F.col(f"{c}_lo") - w, F.col(f"{c}_hi") + w
    return q.withColumns(out)


def histogram(df: DataFrame, by, col: str, edges: list[float], log10: bool = False) -> DataFrame:
    """Density over fixed bins; a value on the last edge belongs to the last bin."""
    by = as_list(by)
    v = F.log10(F.when(F.col(col) > 0, F.col(col))) if log10 else F.col(col)
    e = F.array(*[F.lit(float(x)) for x in edges])
    idx = (F.when(v.isNull() | (v < edges[0]) | (v > edges[-1]), None).when(v == edges[-1], len(edges) - 2)
            .otherwise(F.size(F.filter(e, lambda x: x <= v)) - 1))
    n = df.select(*by, idx.alias("bin")).where("bin is not null").groupBy(*by, "bin").agg(n_rows().alias("n"))
    tot = n.groupBy(*by).agg(F.sum("n").alias("_t"))
    j = n.join(tot, by) if by else n.join(F.broadcast(tot))
    width = F.get(e, F.col("bin") + 1) - F.get(e, F.col("bin"))
    return j.select(*by, "bin", F.get(e, F.col("bin")).alias("lo"), "n", (F.col("n") / F.col("_t") / width).alias("density"))


def support_cut(df: DataFrame, by, col: str, p: float = 0.75, eligible: Column | None = None) -> DataFrame:
    """Eligible rows at or above a percentile of ``col`` among the eligible rows."""
    by = as_list(by)
    src = df if eligible is None else df.where(eligible)
    cut = exact_percentiles(src, by, {"cut": (col, p)})
    j = src.join(cut, by) if by else src.join(F.broadcast(cut))
    return j.where(F.col(col) >= F.col("cut"))


def kde_reflected(df: DataFrame, by, col: str, lo: float | None, hi: float | None, grid_lo: float, grid_hi: float,
                  grid: int = 400) -> DataFrame:
    """Gaussian density on a fixed grid, mass reflected at the bounds; Scott bandwidth sd * n^(-1/5).

    Equal values are merged first, each then adds to all grid points in a partial sum. Groups with fewer than
    five values or without spread are left out.
    """
    by = as_list(by)
    src = df.where(F.col(col).isNotNull() & ~F.isnan(col))
    st = (src.groupBy(*by).agg(n_rows().alias("_n"), F.stddev_samp(col).alias("_sd"))
          .where("_n >= 5 and _sd > 0").withColumn("_h", F.col("_sd") * F.pow(F.col("_n"), F.lit(-0.2))))
    vals = src.groupBy(*by, F.col(col).alias("_v")).agg(n_rows().alias("_w"))
    j = vals.join(st, by) if by else vals.join(F.broadcast(st))
    step = (grid_hi - grid_lo) / (grid - 1)
    g = F.lit(grid_lo) + F.col("i") * F.lit(step)
    bump = lambda at: F.exp(-0.5 * F.pow((at - F.col("_v")) / F.col("_h"), F.lit(2.0)))
    total = reduce(lambda a, b: a + b, [bump(g)] + [bump(2 * b - g) for b in (lo, hi) if b is not None])
    y = F.col("_w") * total / (F.col("_n") * F.col("_h") * F.sqrt(2 * F.pi()))
    return (j.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
            .groupBy(*by, "i").agg(F.sum(y).alias("density"))
            .withColumn("at", F.lit(grid_lo) + F.col("i") * F.lit(step)))
