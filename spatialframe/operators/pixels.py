"""Image channels as pixel tables: footprints, masks, distances, shifts and windows.

A pixel table has one row per (marker, row, col). Masks are plain sets of (row, col). Work on a mask is expressed
by offsets inside each row followed by an aggregate, so it grows with the mask and a fixed reach.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import as_list, exact_percentiles, level_percentiles, n_rows
from ..functions.durable import durable
from ..functions.tails import binom_two_sided, normal_sf
from .resample import bootstrap_ci
from .stats import bh_adjust
from .windows import top_n_per_group

RC = ["row", "col"]


def project_pixels(mol: DataFrame, um_per_px: float, h: int, w: int, keep=("entity_id",)) -> DataFrame:
    """Molecules -> distinct entity pixels; positions outside the image go to its border."""
    px = lambda c, n: F.greatest(F.least(F.floor(F.col(c) / um_per_px), F.lit(n - 1)), F.lit(0)).cast("int")
    return mol.select(*keep, px("y", h).alias("row"), px("x", w).alias("col")).distinct()


def pixel_join(foot: DataFrame, px: DataFrame) -> DataFrame:
    """Footprint pixels with every channel's value there."""
    return foot.join(px, RC)


def mask_distance(grid: DataFrame, mask: DataFrame, unit: float = 1.0) -> DataFrame:
    """Distance of every grid pixel to the nearest mask pixel, however far; NULL where the mask is empty.

    Exact in two passes. Along a column each mask pixel owns the rows up to the middle of the gap to the next one, so
    no pixel is searched. Along a row the nearest is the lowest of the parabolas of all mask columns; a task holds one
    image row at a time.
    """
    span = F.broadcast(grid.agg(F.min("row").alias("lo"), F.max("row").alias("hi")))  # one row
    down = Window.partitionBy("col").orderBy("row")
    own = mask.select(*RC).distinct().withColumns({"before": F.lag("row").over(down), "after": F.lead("row").over(down)}).join(span)
    first = F.greatest(F.floor((F.col("before") + F.col("row")) / 2) + 1, "lo")     # NULL neighbours are skipped
    last = F.least(F.floor((F.col("row") + F.col("after")) / 2), "hi")
    up = own.select("col", F.col("row").alias("at"), first.alias("first"), last.alias("last")).where("first <= last")
    up = up.select(F.explode(F.sequence("first", "last")).alias("row"), "col", "at")
    up = up.select(F.col("row").cast(grid.schema["row"].dataType), F.col("col").cast("long"), ((F.col("row") - F.col("at")) ** 2).cast("long").alias("g2"))
    out = grid.groupBy("row").cogroup(up.groupBy("row")).applyInArrow(_lowest_in_row, StructType([*grid.schema.fields, StructField("d2", LongType())]))
    return out.withColumn("dist", F.sqrt("d2") * unit).drop("d2")


def _lowest_in_row(row: pa.Table, columns: pa.Table) -> pa.Table:
    """For the pixels of one image row, the least squared distance given each column's own one (``g2``)."""
    if not columns.num_rows or not row.num_rows:
        return row.append_column("d2", pa.nulls(row.num_rows, pa.int64()))
    columns = columns.sort_by("col")
    at, g2 = columns["col"].to_numpy(), columns["g2"].to_numpy()
    place, top = at.tolist(), (at * at + g2).tolist()
    # parabolas that are lowest somewhere, and where each begins to be
    low, since = [0], [-math.inf]
    for i in range(1, len(place)):
        while (cross := (top[i] - top[low[-1]]) / (2 * (place[i] - place[low[-1]]))) <= since[-1]:
            low.pop(), since.pop()
        low.append(i), since.append(cross)
    unknown = row["col"].is_null().to_numpy()
    col = row["col"].fill_null(0).to_numpy().astype(np.int64)
    best = np.array(low)[np.searchsorted(since, col, side="right") - 1]
    return row.append_column("d2", pa.array((col - at[best]) ** 2 + g2[best], pa.int64(), mask=unknown))


CROSS = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]
SQUARE = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]


def dilate(mask: DataFrame, n: int = 1, shape: str = "cross", keep=(), bounds: Column | None = None) -> DataFrame:
    """Binary dilation, repeated ``n`` times, optionally within bounds after every step."""
    keep = as_list(keep)
    offs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in (CROSS if shape == "cross" else SQUARE)])
    out = mask.select(*keep, "row", "col")
    for _ in range(n):
        out = out.select(*keep, "row", "col", F.explode(offs).alias("o")).select(
            *keep, (F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col"))
        out = (out if bounds is None else out.where(bounds)).distinct()
    return out


def erode(mask: DataFrame, shape: str = "square", keep=()) -> DataFrame:
    """Pixels whose whole neighbourhood is in the mask; outside the image counts as empty."""
    keep = as_list(keep)
    ring = CROSS if shape == "cross" else SQUARE
    offs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ring])
    hit = mask.select(*keep, "row", "col", F.explode(offs).alias("o")).select(
        *keep, (F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col"))
    return hit.groupBy(*keep, "row", "col").agg(n_rows().alias("_k")).where(F.col("_k") == len(ring)).drop("_k")


# --- footprints and channels -------------------------------------------------------------------------

def footprint_stats(foot: DataFrame, dist: DataFrame, far: float = 2.0, key: str = "entity_id") -> DataFrame:
    """Distinct pixels per entity, pixels beyond ``far`` of the mask, mean and largest distance. Pixels without a distance count
    as pixels only."""
    j = foot.select(key, *RC).distinct().join(dist.select(*RC, "dist"), RC, "left")
    return j.groupBy(key).agg(n_rows().alias("n_px"), F.count_if(F.col("dist") > far).alias("n_px_far"), F.avg((F.col("dist") > far).cast("double")).alias("frac_px_far"),
                              F.avg("dist").alias("dist_mean"), F.max("dist").alias("dist_max"))


def calibrate_threshold(px: DataFrame, background: DataFrame) -> DataFrame:
    """Per marker over background pixels with signal: pedestal = most frequent value (ties: smallest), threshold = 99th
    percentile of the excess but at least 1, further quantiles and the realised positive share."""
    bg = px.where("value > 0").join(background.select(*RC), RC, "left_semi")
    # all of it follows from the counts per intensity level, which are few however many pixels there are
    hist = durable(bg.groupBy("marker", "value").agg(n_rows().alias("c")))
    ped = top_n_per_group(hist, "marker", [F.desc("c"), "value"], 1).select("marker", F.col("value").alias("pedestal"))
    ex = (hist.join(F.broadcast(ped), "marker").groupBy("marker", F.greatest(F.col("value") - F.col("pedestal"), F.lit(0)).alias("s"))
          .agg(F.sum("c").alias("c")))
    q = level_percentiles(ex, "marker", "s", "c", {"q95": .95, "q99": .99, "q999": .999})
    t = durable(q.join(ped, "marker").withColumn("thr", F.greatest("q99", F.lit(1.0))))
    pos = ex.join(F.broadcast(t.select("marker", "thr")), "marker").groupBy("marker").agg(
        (F.sum(F.when(F.col("s") > F.col("thr"), F.col("c")).otherwise(0)) / F.sum("c")).alias("background_pos"), F.sum("c").alias("n_background"))
    return t.join(pos, "marker")


def channel_stats(foot: DataFrame, px: DataFrame, thr: DataFrame, dist: DataFrame, far: float = 2.0, key: str = "entity_id", keep=()) -> DataFrame:
    """Per entity and marker: mean excess over the pedestal, positive share, and the share beyond and within ``far`` of
    the mask (NULL without such pixels). The threshold table has one row per channel. Pixels without a distance are in neither share."""
    k = [key, *as_list(keep)]
    f = foot.select(*k, *RC).distinct().join(dist.select(*RC, (F.col("dist") > far).alias("is_far")), RC, "left")
    j = pixel_join(f, px.join(F.broadcast(thr.select("marker", "pedestal", "thr")), "marker"))
    v = F.greatest(F.col("value") - F.col("pedestal"), F.lit(0)).cast("double")
    j = j.select(*k, "marker", "is_far", v.alias("v"), (v > F.col("thr")).cast("double").alias("p"))
    return j.groupBy(*k, "marker").agg(n_rows().alias("n_px"), F.avg("v").alias("int"), F.avg("p").alias("pos"),
                                       F.avg(F.when(F.col("is_far"), F.col("p"))).alias("pos_far"), F.avg(F.when(~F.col("is_far"), F.col("p"))).alias("pos_near"))


def channel_summary(px: DataFrame, roles: dict[str, str]) -> DataFrame:
    """Per channel: 99th percentile, maximum, extent and role."""
    role = F.create_map(*[F.lit(v) for kv in roles.items() for v in kv])
    p99 = level_percentiles(px.groupBy("marker", "value").agg(n_rows().alias("c")), "marker", "value", "c", {"p99": .99})
    g = px.groupBy("marker").agg(F.max("value").alias("max"), (F.max("row") - F.min("row") + 1).alias("height"), (F.max("col") - F.min("col") + 1).alias("width"), n_rows().alias("n_px"))
    return g.join(p99, "marker").withColumn("role", F.coalesce(F.try_element_at(role, F.col("marker")), F.lit("panel")))


def residual_mask(px: DataFrame, cuts: dict[str, float], dist: DataFrame, n_channels: int = 2, far: float = 2.0) -> DataFrame:
    """Tissue = at least ``n_channels`` of the listed channels above their cut; residual = tissue beyond ``far``."""
    cut = F.create_map(*[F.lit(v) for m, c in cuts.items() for v in (m, float(c))])
    t = (px.where(F.col("marker").isin(list(cuts))).groupBy(*RC)
         .agg((F.count_if(F.col("value") > F.element_at(cut, F.col("marker"))) >= n_channels).alias("tissue")))
    return t.join(dist, RC, "left").select(*RC, "tissue", F.coalesce(F.col("tissue") & (F.col("dist") > far), F.lit(False)).alias("residual"))


# --- shift null --------------------------------------------------------------------------------------

def shift_table(n: int, min_shift: int, h: int, w: int, seed) -> list[tuple[int, int, int]]:
    """(shift, dy, dx) with both steps at least ``min_shift`` away from zero around the torus; the parameters of a run."""
    draw = lambda i, axis, size: min_shift + int(hashlib.md5(f"{seed}|{i}|{axis}".encode()).hexdigest()[:8], 16) % (size - 2 * min_shift)
    return [(i, draw(i, "y", h), draw(i, "x", w)) for i in range(n)]


def shift_join(foot: DataFrame, px: DataFrame, shifts, h: int, w: int, origin: int = 1) -> DataFrame:
    """Footprint pixels moved by each shift around the torus, with the channel value they land on."""
    s = F.array(*[F.struct(F.lit(i).alias("shift"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for i, dy, dx in shifts])
    keep = [c for c in foot.columns if c not in RC]
    moved = foot.select(*keep, *RC, F.explode(s).alias("s")).select(
        *keep, F.col("s.shift").alias("shift"), (F.pmod(F.col("row") - origin + F.col("s.dy"), F.lit(h)) + origin).alias("row"),
        (F.pmod(F.col("col") - origin + F.col("s.dx"), F.lit(w)) + origin).alias("col"))
    return moved.join(px, RC)


def toroidal_null(foot: DataFrame, px: DataFrame, thr: DataFrame, dist: DataFrame, shifts, h: int, w: int, far: float = 2.0, label: str = "cell_type") -> DataFrame:
    """Positive rate per marker, shift and type when footprints are moved around the torus.

    The rate needs only how many entity pixels of a type lie on each pixel, so footprints are merged to (type, row,
    col) counts before they are shifted: the shifted table is bounded by image size x types x shifts.
    """
    f = (foot.join(dist.select(*RC, (F.col("dist") > far).alias("is_far")), RC, "left").groupBy(label, *RC)
         .agg(n_rows().alias("n"), F.count_if("is_far").alias("nf")))
    pos = px.join(F.broadcast(thr.select("marker", "pedestal", "thr")), "marker").where(F.greatest(F.col("value") - F.col("pedestal"), F.lit(0)) > F.col("thr")).select("marker", *RC)
    hit = shift_join(f, pos, shifts, h, w).groupBy("marker", "shift", label).agg(F.sum("n").alias("_p"), F.sum("nf").alias("_pf"))
    den = f.groupBy(label).agg(F.sum("n").alias("_n"), F.sum("nf").alias("_nf"))
    marks = thr.agg(F.collect_set("marker").alias("_ms"))  # one row: the channel list
    grid = (den.join(F.broadcast(marks)).withColumn("marker", F.explode("_ms")).drop("_ms")
            .withColumn("shift", F.explode(F.array(*[F.lit(i) for i, *_ in shifts]))))
    share = lambda a, b: F.coalesce(F.col(a), F.lit(0)) / F.greatest(b, F.lit(1))
    return grid.join(hit, ["marker", "shift", label], "left").select("marker", "shift", label, share("_p", "_n").alias("pos_frac"), share("_pf", "_nf").alias("pos_frac_far"))


def null_summary(null: DataFrame, by=("marker", "cell_type")) -> DataFrame:
    return null.groupBy(*as_list(by)).agg(F.avg("pos_frac").alias("null_mean"), F.stddev_samp("pos_frac").alias("null_sd"),
                                          F.avg("pos_frac_far").alias("null_mean_far"), F.stddev_samp("pos_frac_far").alias("null_sd_far"))


def specificity_matrix(stats: DataFrame, null: DataFrame, by=("entity_class", "cell_type"), canon: dict[str, str] | None = None, min_px: int = 8, min_n: int = 30) -> DataFrame:
    """Per class, type and marker: mean positivity against the shift null with entity-level error; z, p and q, and the
    row-centred enrichment (absolute enrichment mostly measures brightness)."""
    by = as_list(by)
    s = stats.where(F.col("n_px") >= min_px)
    g = s.groupBy(*by, "marker").agg(
        n_rows().alias("n"), F.avg("pos").alias("obs"), (F.stddev_samp("pos") / F.sqrt(n_rows())).alias("obs_se"), F.avg("pos_far").alias("obs_far"),
        (F.stddev_samp("pos_far") / F.sqrt(F.greatest(F.count("pos_far"), F.lit(1)))).alias("_sef")).where(F.col("n") >= min_n)
    j = g.join(null_summary(null), ["marker", "cell_type"])
    enrich = lambda a, b: F.log2((F.col(a) + 1e-4) / (F.col(b) + 1e-4))
    z = lambda a, b, se, sd: (F.col(a) - F.col(b)) / F.greatest(F.hypot(se, sd), F.lit(1e-12))
    j = j.withColumns({"log2_enrich": enrich("obs", "null_mean"), "z": z("obs", "null_mean", "obs_se", "null_sd"),
                       "log2_enrich_far": enrich("obs_far", "null_mean_far"), "z_far": z("obs_far", "null_mean_far", "_sef", "null_sd_far")}).drop("_sef")
    if canon:
        m = F.create_map(*[F.lit(v) for kv in canon.items() for v in kv])
        j = j.withColumn("is_canonical", F.coalesce(F.try_element_at(m, F.col("cell_type")) == F.col("marker"), F.lit(False)))
    j = durable(j)  # one row per class, type and marker
    j = j.join(exact_percentiles(j, by, {"_m": ("log2_enrich", .5)}), by, "left").withColumn("rel_log2", F.col("log2_enrich") - F.col("_m")).drop("_m")
    return bh_adjust(durable(j.withColumn("p_z", 2.0 * normal_sf(F.abs("z")))), "p_z", out="q_bh")


def marker_distribution(stats: DataFrame, null: DataFrame, thr: DataFrame, cls: str = "entity_class", n: int = 400, seed=0, min_px: int = 8) -> DataFrame:
    """Per marker and class: mean with bootstrap interval, medians, enrichment over the null, and the calibration."""
    s = durable(stats.where(F.col("n_px") >= min_px))
    by = ["marker", cls]
    g = s.groupBy(*by).agg(n_rows().alias("n"), F.avg("pos").alias("mean_pos"), F.avg("int").alias("mean_int"))
    q = exact_percentiles(s, by, {"median_pos": ("pos", .5), "median_int": ("int", .5)})
    ci = bootstrap_ci(s, by, "pos", "mean", n, seed, "entity_id").select(*by, "ci_lo", "ci_hi")
    nul = null_summary(null).groupBy("marker").agg(F.avg("null_mean").alias("null_pos"))
    return (g.join(q, by, "left").join(ci, by, "left").join(nul, "marker").join(thr.select("marker", "pedestal", "thr", "background_pos"), "marker")
            .withColumn("log2_enrich", F.log2((F.col("mean_pos") + 1e-4) / (F.col("null_pos") + 1e-4))))


def near_far(stats: DataFrame, canon: dict[str, str], cls: str = "entity_class", label: str = "cell_type", min_px: int = 8, min_n: int = 30) -> DataFrame:
    """Own-marker positivity within and beyond the spill-over reach, paired per entity: means, median and mean
    difference, sign test and retention."""
    m = F.create_map(*[F.lit(v) for kv in canon.items() for v in kv])
    s = stats.where((F.col("n_px") >= min_px) & (F.try_element_at(m, F.col(label)) == F.col("marker")) & F.col("pos_near").isNotNull() & F.col("pos_far").isNotNull())
    s = durable(s.withColumn("d", F.col("pos_far") - F.col("pos_near")))
    by = [label, "marker", cls]
    g = s.groupBy(*by).agg(n_rows().alias("n_paired"), F.avg("pos_near").alias("mean_within"), F.avg("pos_far").alias("mean_beyond"), F.avg("d").alias("mean_diff"),
                           F.count_if(F.col("d") != 0).alias("n_discordant"), F.count_if(F.col("d") > 0).alias("n_beyond_higher")).where(F.col("n_paired") >= min_n)
    return (g.join(exact_percentiles(s, by, {"paired_median_diff": ("d", .5)}), by, "left")
            .withColumns({"p_sign": binom_two_sided("n_beyond_higher", "n_discordant"), "retention": F.col("mean_beyond") / F.when(F.col("mean_within") != 0, F.col("mean_within"))}))


def retention_table(nf: DataFrame, a: str = "partial", b: str = "cell", cls: str = "entity_class", label: str = "cell_type") -> DataFrame:
    """Retention per type as columns for two classes, with their difference."""
    w = nf.groupBy(label).pivot(cls, [a, b]).agg(F.first("retention"))
    return w.withColumn(f"{a}_minus_{b}", F.col(a) - F.col(b))


# --- signed distance ---------------------------------------------------------------------------------

def signed_distance_bands(ent: DataFrame, inside: Column, target: Column, by, g: float = 25.0, lim: float = 300.0, support: int = 20, extent: DataFrame | None = None) -> DataFrame:
    """Share of entities of a class per band of signed distance to a domain's border (negative inside).

    The domain is the set of grid cells with an ``inside`` entity, closed by a 3 x 3 square. Cells farther than ``lim``
    fall outside all bands. Bands below ``support`` entities get NULL.
    """
    by = as_list(by)
    cap = int(lim / g)
    at = lambda c: F.floor(F.col(c) / g).cast("int")
    cells = ent.select(*by, at("x").alias("row"), at("y").alias("col"), inside.alias("_in"), target.alias("_t"))
    ext = (extent if extent is not None else ent.groupBy(*by).agg(F.max("x").alias("x_hi"), F.max("y").alias("y_hi"))).select(
        *by, (F.ceil(F.col("x_hi") / g) + 1).cast("int").alias("_nx"), (F.ceil(F.col("y_hi") / g) + 1).cast("int").alias("_ny"))
    within = lambda d: d.join(ext, by).where("row >= 0 and row < _nx and col >= 0 and col < _ny").drop("_nx", "_ny")
    seed = cells.where("_in").select(*by, *RC).distinct()
    closed = erode(within(dilate(seed, 1, "square", by)), "square", by)
    # the closest outside cell of an inside cell always touches the domain
    rim = within(dilate(closed, 1, "square", by)).join(closed, [*by, *RC], "left_anti")
    occupied = cells.groupBy(*by, *RC).agg(n_rows().alias("n_all"), F.count_if("_t").alias("n_t"))
    occupied = occupied.join(closed.withColumn("_m", F.lit(True)), [*by, *RC], "left").withColumn("_m", F.coalesce("_m", F.lit(False)))
    out = _group_distance(occupied.where("not _m"), closed, cap, by)
    inn = _group_distance(occupied.where("_m"), rim, cap, by).withColumn("dist", -F.col("dist"))
    d = out.unionByName(inn).where("dist is not null").withColumn("_s", F.col("dist") * g)
    d = d.where((F.col("_s") >= -lim) & (F.col("_s") <= lim)).withColumn("band", F.least(F.floor((F.col("_s") + lim) / g), F.lit(2 * cap - 1)).cast("int"))
    b = d.groupBy(*by, "band").agg(F.sum("n_all").alias("n"), F.sum("n_t").alias("n_target"))
    return b.select(*by, "band", (F.lit(-lim) + (F.col("band") + 0.5) * g).alias("mid"), "n", "n_target",
                    F.when(F.col("n") >= support, F.col("n_target") / F.col("n")).alias("share_of_entities"))


def _group_distance(grid: DataFrame, mask: DataFrame, cap: int, by) -> DataFrame:
    span = F.sequence(F.lit(-cap), F.lit(cap))
    up = (mask.select(*by, *RC, F.explode(span).alias("d")).groupBy(*by, (F.col("row") + F.col("d")).alias("row"), "col").agg(F.min(F.abs("d")).alias("g")))
    across = (up.select(*by, *RC, "g", F.explode(span).alias("d")).groupBy(*by, "row", (F.col("col") + F.col("d")).alias("col"))
              .agg(F.min(F.col("d") * F.col("d") + F.col("g") * F.col("g")).alias("d2")).where(F.col("d2") <= cap * cap))
    return grid.join(across, [*by, *RC], "left").withColumn("dist", F.sqrt("d2")).drop("d2")


# --- windows of interest -----------------------------------------------------------------------------

def _cover(df: DataFrame, w: int, stride: int, keep, box: DataFrame) -> DataFrame:
    """Rows repeated for each window (wr, wc) that covers their pixel; windows start inside ``box`` (one row)."""
    j = df.join(F.broadcast(box))
    first = lambda c, lo: F.greatest(F.ceil((F.col(c) - F.col(lo) - w + 1) / stride), F.lit(0)).cast("int")
    last = lambda c, lo, hi: F.least(F.floor((F.col(c) - F.col(lo)) / stride), F.ceil((F.col(hi) - w - F.col(lo)) / stride) - 1).cast("int")
    a, b = first("row", "r_lo"), last("row", "r_lo", "r_hi")
    c, d = first("col", "c_lo"), last("col", "c_lo", "c_hi")
    j = j.where((a <= b) & (c <= d) & (F.col("row") >= F.col("r_lo")) & (F.col("col") >= F.col("c_lo")))
    j = j.withColumn("wr", F.explode(F.sequence(a, b))).withColumn("wc", F.explode(F.sequence(c, d)))
    return j.select("wr", "wc", (F.col("r_lo") + F.col("wr") * stride).alias("r0"), (F.col("c_lo") + F.col("wc") * stride).alias("c0"), *keep)


def window_box(res: DataFrame) -> DataFrame:
    """Extent of the tissue pixels: one row."""
    return res.where("tissue").agg(F.min("row").alias("r_lo"), F.max("row").alias("r_hi"), F.min("col").alias("c_lo"), F.max("col").alias("c_hi"))


def scan_windows(res: DataFrame, points: DataFrame, w: int, stride: int, tissue: float = 0.5, residual: float = 0.15, supported: int = 8, types: int = 3, label: str = "cell_type") -> DataFrame:
    """Eligible windows: enough tissue, residual share, supported entities and distinct types."""
    box = window_box(res)
    px = _cover(res, w, stride, ["tissue", "residual"], box).groupBy("wr", "wc", "r0", "c0").agg(
        F.count_if("tissue").alias("_t"), F.count_if("residual").alias("_r"))
    px = px.where(F.col("_t") >= tissue * w * w).withColumns({"tissue_frac": F.col("_t") / F.lit(float(w * w)), "residual_frac": F.col("_r") / F.greatest("_t", F.lit(1))})
    pt = _cover(points, w, stride, [label], box).groupBy("wr", "wc").agg(n_rows().alias("n_supported"), F.array_sort(F.collect_set(label)).alias("_ty"))
    return (px.where(F.col("residual_frac") >= residual).join(pt, ["wr", "wc"]).withColumn("n_types", F.size("_ty"))
            .where((F.col("n_supported") >= supported) & (F.col("n_types") >= types))
            .select("wr", "wc", "r0", "c0", "tissue_frac", "residual_frac", "n_supported", "n_types", F.array_join("_ty", ",").alias("types")))


def capture_ratio(windows: DataFrame, res: DataFrame, px: DataFrame, foot: DataFrame, thr: DataFrame, canon: dict[str, str], w: int, grow: int = 2, min_pos: int = 20, label: str = "cell_type") -> DataFrame:
    """Per window: how much residual own-marker signal the footprints capture, relative to the area they cover, weighted
    over lineages by their residual positive pixels; lineages below ``min_pos`` such pixels are skipped. Residual are the
    pixels that ``res`` marks: here the distance to the mask alone decides, tissue or not.

    Windows are keyed by the cells of their own size that they touch, so the joins are equi-joins.
    """
    windows = durable(windows)
    tiles = windows.select("wr", "wc", "r0", "c0", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])).alias("o"))
    tiles = tiles.select("wr", "wc", "r0", "c0", (F.floor(F.col("r0") / w) + F.col("o.i")).alias("_tr"), (F.floor(F.col("c0") / w) + F.col("o.j")).alias("_tc"))
    inside = (F.col("row") >= F.col("r0")) & (F.col("row") < F.col("r0") + w) & (F.col("col") >= F.col("c0")) & (F.col("col") < F.col("c0") + w)

    def clip(d):
        return (d.withColumns({"_tr": F.floor(F.col("row") / w), "_tc": F.floor(F.col("col") / w)}).join(tiles, ["_tr", "_tc"]).where(inside).drop("_tr", "_tc"))

    key = ["wr", "wc"]
    r = durable(clip(res.where("residual").select(*RC)).select(*key, *RC))
    n_res = r.groupBy(*key).agg(n_rows().alias("n_res"))
    lin = F.create_map(*[F.lit(v) for t, m in canon.items() for v in (t, m)])
    f = clip(foot.where(F.col(label).isin(list(canon))).select(label, *RC).distinct()).select(*key, "r0", "c0", label, *RC)
    fm = durable(dilate(f, grow, "cross", [*key, "r0", "c0", label], inside).select(*key, label, *RC))
    present = fm.select(*key, label).distinct().withColumn("marker", F.try_element_at(lin, F.col(label)))
    pos = px.join(F.broadcast(thr.select("marker", "pedestal", "thr")), "marker").where(F.col("value") - F.col("pedestal") > F.col("thr")).select("marker", *RC)
    rp = durable(r.join(pos, RC).join(present, [*key, "marker"]))
    pr = rp.groupBy(*key, label).agg(n_rows().alias("pr"))
    cap = rp.join(fm, [*key, label, *RC], "left_semi").groupBy(*key, label).agg(n_rows().alias("cap"))
    area = fm.join(r, [*key, *RC], "left_semi").groupBy(*key, label).agg(n_rows().alias("area"))
    t = (pr.where(F.col("pr") >= min_pos).join(area, [*key, label]).join(cap, [*key, label], "left").join(n_res, key)
         .withColumns({"_c": F.coalesce("cap", F.lit(0)) / F.col("pr"), "_a": F.col("area") / F.col("n_res")}))
    wsum = F.sum("pr")
    return t.groupBy(*key).agg((F.sum(F.col("pr") * F.col("_c")) / wsum).alias("capture_frac"), (F.sum(F.col("pr") * F.col("_a")) / wsum).alias("area_frac"),
                               (F.sum(F.col("pr") * F.col("_c") / F.col("_a")) / wsum).alias("capture_ratio"))
