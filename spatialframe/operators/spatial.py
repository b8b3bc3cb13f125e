"""Neighbour joins and window counts on the plane.

Points are keyed by the square cell they lie in and matched to the 3 x 3 block around it, so every distance
join is an equi-join. Points at the same place are merged into one weighted site wherever only counts are
needed: many copies of one point then cost one row.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import as_list, n_rows
from ..functions.durable import durable
from .windows import top_n_per_group

HOT_CELL = 20_000  # points per cell above which the cell's work is split


def cell_of(df: DataFrame, size: float, x: str = "x", y: str = "y", out=("cx", "cy")) -> DataFrame:
    return df.withColumns({out[0]: F.floor(F.col(x) / float(size)), out[1]: F.floor(F.col(y) / float(size))})


def _offsets(pairs):
    return F.array(*[F.struct(F.lit(i).cast("bigint").alias("i"), F.lit(j).cast("bigint").alias("j")) for i, j in pairs])


BLOCK = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
HALF = [(0, 0), (1, 0), (-1, 1), (0, 1), (1, 1)]  # own cell and one of every two opposite neighbours


def _split_hot(left: DataFrame, right: DataFrame, keys, l_id: str, r_id: str, hot: int):
    """Cut the work of every crowded cell into k x k parts. The table of crowded cells is written, so that its size is known and
    Spark broadcasts it while it is small, before the points are shuffled."""
    heavy = durable(left.groupBy(*keys).agg(n_rows().alias("_c")).where(F.col("_c") > hot)
                    .select(*keys, F.ceil(F.col("_c") / hot).cast("int").alias("_k")))
    k = F.coalesce("_k", F.lit(1))
    span = F.sequence(F.lit(0).cast("bigint"), (k - 1).cast("bigint"))
    lefts = (left.join(heavy, keys, "left").withColumn("_sl", F.pmod(F.xxhash64(l_id), k))
             .withColumn("_sr", F.explode(span)).drop("_k"))
    rights = (right.join(heavy, keys, "left").withColumn("_sr", F.pmod(F.xxhash64(r_id), k))
              .withColumn("_sl", F.explode(span)).drop("_k"))
    return lefts, rights


def grid_join(a: DataFrame, b: DataFrame, r: float, by, cell: float | None = None, a_id: str = "id", b_id: str = "id",
              hot: int = HOT_CELL) -> DataFrame:
    """All (a, b) within ``r`` (closed). Columns come out as a_* and b_*, plus the group keys and dist2."""
    by = as_list(by)
    size = cell or r
    left = cell_of(a, size)
    left = left.select(*by, "cx", "cy", *[F.col(c).alias(f"a_{c}") for c in a.columns if c not in by])
    right = cell_of(b, size).withColumn("_o", F.explode(_offsets(BLOCK)))
    right = right.select(*by, (F.col("cx") + F.col("_o.i")).alias("cx"), (F.col("cy") + F.col("_o.j")).alias("cy"),
                         *[F.col(c).alias(f"b_{c}") for c in b.columns if c not in by])
    keys = [*by, "cx", "cy"]
    left, right = _split_hot(left, right, keys, f"a_{a_id}", f"b_{b_id}", hot)
    d2 = (F.col("a_x") - F.col("b_x")) * (F.col("a_x") - F.col("b_x")) + (F.col("a_y") - F.col("b_y")) * (F.col("a_y") - F.col("b_y"))
    return (left.join(right, [*keys, "_sl", "_sr"]).withColumn("dist2", d2)
            .where(F.col("dist2") <= float(r) * float(r)).drop("cx", "cy", "_sl", "_sr"))


def self_pairs(df: DataFrame, r: float, by, id: str = "id", hot: int = HOT_CELL) -> DataFrame:
    """Unordered pairs within ``r`` (closed), each once, with all columns as a_* and b_*. Only half of the
    neighbouring cells are visited."""
    by = as_list(by)
    pts = cell_of(df, r)
    keys = [*by, "cx", "cy"]
    left = pts.select(*keys, *[F.col(c).alias(f"a_{c}") for c in df.columns if c not in by])
    right = pts.withColumn("_o", F.explode(_offsets(HALF))).select(
        *by, (F.col("cx") - F.col("_o.i")).alias("cx"), (F.col("cy") - F.col("_o.j")).alias("cy"),
        ((F.col("_o.i") == 0) & (F.col("_o.j") == 0)).alias("_own"),
        *[F.col(c).alias(f"b_{c}") for c in df.columns if c not in by])
    left, right = _split_hot(left, right, keys, f"a_{id}", f"b_{id}", hot)
    d2 = (F.col("a_x") - F.col("b_x")) * (F.col("a_x") - F.col("b_x")) + (F.col("a_y") - F.col("b_y")) * (F.col("a_y") - F.col("b_y"))
    return (left.join(right, [*keys, "_sl", "_sr"])
            .where(~F.col("_own") | (F.col(f"a_{id}") < F.col(f"b_{id}")))
            .withColumn("dist2", d2).where(F.col("dist2") <= float(r) * float(r))
            .drop("cx", "cy", "_own", "_sl", "_sr"))


def radius_pairs(df: DataFrame, r: float, by, id: str = "entity_id", closed: bool = True) -> DataFrame:
    """(a, b, dist) with a < b for all pairs within ``r``."""
    by = as_list(by)
    p = self_pairs(df.select(*by, id, "x", "y"), r, by, id)
    if not closed:
        p = p.where(F.col("dist2") < float(r) * float(r))
    return p.select(*by, F.least(f"a_{id}", f"b_{id}").alias("a"), F.greatest(f"a_{id}", f"b_{id}").alias("b"),
                    F.sqrt("dist2").alias("dist"))


def weighted_sites(df: DataFrame, by, id: str = "entity_id", **counts) -> DataFrame:
    """Merge points at the same place: one row per (group, x, y) with an id, a size and conditional counts."""
    return df.groupBy(*as_list(by), "x", "y").agg(
        F.min(id).alias("id"), n_rows().alias("n"), *[F.count_if(c).alias(k) for k, c in counts.items()])


def radius_join(a: DataFrame, b: DataFrame, r: float, by, tile: float | None = None, id: str = "entity_id") -> DataFrame:
    """Number of (a, b) within ``r``, per tile of the left point or per group."""
    by = as_list(by)
    p = grid_join(weighted_sites(a, by, id), weighted_sites(b, by, id), r, by)
    keys = list(by)
    if tile is not None:
        p = p.withColumns({"tx": F.floor(F.col("a_x") / float(tile)), "ty": F.floor(F.col("a_y") / float(tile))})
        keys += ["tx", "ty"]
    return p.groupBy(*keys).agg(F.sum(F.col("a_n") * F.col("b_n")).alias("n_pairs"), F.sum("a_n").alias("_l")).drop("_l")


# --- nearest neighbour -------------------------------------------------------------------------------

FAN = 4  # a cell of one level has FAN x FAN cells of the level below


def _scale(tgt: DataFrame, by) -> tuple[float, int]:
    """Base cell and the number of levels that cover the widest group, from two one-row aggregates.

    The mean density gives a first cell. Where targets crowd, most of them sit in cells far fuller than the mean, so
    the cell shrinks until a target's own cell holds about three of them.
    """
    g = tgt.groupBy(*by).agg(n_rows().alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"),
                             F.min("y").alias("y0"), F.max("y").alias("y1"))
    w = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    row = g.agg(F.avg(F.sqrt(area / F.col("n"))).alias("step"), F.max(w).alias("w")).first()
    step = row["step"] or 0.0
    wide = row["w"] or 0.0
    cell = step * 1.5 if step > 0 else max(wide / 64.0, 1.0)
    occ = cell_of(tgt.select(*by, "x", "y").distinct(), cell).groupBy(*by, "cx", "cy").agg(n_rows().alias("n"))
    full = occ.agg((F.sum(F.col("n").cast("double") * F.col("n")) / F.sum("n")).alias("m")).first()["m"] or 1.0
    if full > 3.0:
        cell *= math.sqrt(3.0 / full)
    return cell, max(1, math.ceil(math.log(max(wide / cell, 1.0) + 1.0, FAN)))


def nearest(src: DataFrame, tgt: DataFrame, by, max_r: float | None = None, src_id: str = "entity_id", tgt_id: str = "entity_id",
            payload=(), exclude_self: bool = False, cell: float | None = None) -> DataFrame:
    """Nearest target of every source in its group: (group, source id, nearest_id, dist, payload).

    Ties go to the smallest target id; a source whose group has no target has no row. With ``max_r`` only
    targets within it count. Otherwise the 3 x 3 block settles every source whose best distance is at most one
    cell. The rest go down a pyramid of cells, keeping at each level the cells that may still hold the nearest
    target, so a source far from a crowded region never meets all of its points.
    """
    by, payload = as_list(by), as_list(payload)
    if not by:
        whole = lambda d: d.withColumn("__all", F.lit(1))
        return nearest(whole(src), whole(tgt), "__all", max_r, src_id, tgt_id, payload, exclude_self, cell).drop("__all")
    s = src.select(*by, F.col(src_id).alias("sid"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    cand = F.struct(F.col(tgt_id).alias("tid"), *payload)
    if exclude_self:
        two = top_n_per_group(tgt.select(*by, "x", "y", tgt_id, *payload), [*by, "x", "y"], tgt_id, 2)
        sites = two.groupBy(*by, "x", "y").agg(F.min(cand).alias("c1"), F.max(cand).alias("c2"))
    else:
        sites = tgt.groupBy(*by, "x", "y").agg(F.min(cand).alias("c1")).withColumn("c2", F.col("c1"))
    if max_r is not None:
        cell, levels = float(max_r), 0
    elif cell is None:
        cell, levels = _scale(tgt, by)
    else:
        levels = _scale(tgt, by)[1] + 2

    pick = (F.when(F.col("c1.tid") != F.col("sid"), F.col("c1")).when(F.col("c2.tid") != F.col("sid"), F.col("c2"))
            if exclude_self else F.col("c1"))

    def measured(df):
        d2 = (F.col("sx") - F.col("x")) * (F.col("sx") - F.col("x")) + (F.col("sy") - F.col("y")) * (F.col("sy") - F.col("y"))
        return df.withColumns({"d2": d2, "c": pick}).where("c is not null")

    keys = [*by, "cx", "cy"]
    placed = cell_of(sites, cell)
    around = placed.withColumn("_o", F.explode(_offsets(BLOCK))).select(
        *by, (F.col("cx") + F.col("_o.i")).alias("cx"), (F.col("cy") + F.col("_o.j")).alias("cy"), "x", "y", "c1", "c2")
    best = lambda df: df.groupBy(*by, "sid").agg(F.min(F.struct("d2", "c")).alias("m"))
    near = best(measured(cell_of(s, cell, "sx", "sy").join(around, keys)))

    def out(df):
        return df.select(*by, F.col("sid").alias(src_id), F.col("m.c.tid").alias("nearest_id"), F.sqrt("m.d2").alias("dist"),
                         *[F.col(f"m.c.{p}").alias(p) for p in payload])
    if levels == 0:
        return out(near.where(F.col("m.d2") <= cell * cell))

    state = durable(s.join(near, [*by, "sid"], "left"))
    settled = state.where(F.col("m.d2") <= cell * cell).select(*by, "sid", "m")
    open_src = (state.where(F.col("m").isNull() | (F.col("m.d2") > cell * cell))
                .select(*by, "sid", "sx", "sy", F.col("m.d2").alias("bound")))
    if open_src.isEmpty():
        return out(settled)

    # occupied cells of every level, with the two extreme points as stand-ins for an upper bound
    point = lambda c: F.struct(F.col(f"{c}.tid").alias("tid"), F.col("x").alias("x"), F.col("y").alias("y"))
    occ = [placed.groupBy(*keys).agg(F.min(point("c1")).alias("p1"), F.max(point("c2")).alias("p2"))]
    for _ in range(levels):
        occ.append(occ[-1].groupBy(*by, F.floor(F.col("cx") / FAN).alias("cx"), F.floor(F.col("cy") / FAN).alias("cy"))
                   .agg(F.min("p1").alias("p1"), F.max("p2").alias("p2")))

    def bounded(df, size):
        x0, y0 = F.col("cx") * size, F.col("cy") * size
        # cell borders are float products: widen by a hair so the lower bound stays a lower bound
        eps = F.lit(1e-9) * F.lit(size)
        dx = F.greatest(x0 - F.col("sx") - eps, F.col("sx") - (x0 + size) - eps, F.lit(0.0))
        dy = F.greatest(y0 - F.col("sy") - eps, F.col("sy") - (y0 + size) - eps, F.lit(0.0))
        up = lambda p: (F.pow(F.col(f"{p}.x") - F.col("sx"), F.lit(2.0)) + F.pow(F.col(f"{p}.y") - F.col("sy"), F.lit(2.0)))
        if exclude_self:
            ub = F.least(*[F.when(F.col(f"{p}.tid") != F.col("sid"), up(p)) for p in ("p1", "p2")])
        else:
            ub = F.least(up("p1"), up("p2"))
        df = df.withColumns({"lb": dx * dx + dy * dy, "ub": ub}).where("ub is not null")
        mine = W.partitionBy(*by, "sid")
        return (df.withColumn("bound", F.least("bound", F.min("ub").over(mine)))
                .where(F.col("lb") <= F.col("bound") * (1 + 1e-12)).drop("lb", "ub", "p1", "p2"))

    top = occ[levels]
    front = bounded(open_src.join(top, by), cell * FAN ** levels)
    for lv in range(levels - 1, -1, -1):
        kids = occ[lv].withColumns({"px": F.floor(F.col("cx") / FAN), "py": F.floor(F.col("cy") / FAN)})
        front = front.withColumnsRenamed({"cx": "px", "cy": "py"}).join(kids, [*by, "px", "py"]).drop("px", "py")
        front = bounded(front, cell * FAN ** lv)
    far = best(measured(front.join(placed, keys)))
    return out(settled.unionByName(far))


def nearest_other(src: DataFrame, tgt: DataFrame, by, payload=(), **kw) -> DataFrame:
    """Nearest target other than the source itself, with its payload."""
    return nearest(src, tgt, by, payload=payload, exclude_self=True, **kw)


def nearest_within(src: DataFrame, tgt: DataFrame, by, r: float, **kw) -> DataFrame:
    """Nearest target only where it is closer than ``r`` (strict)."""
    return nearest(src, tgt, by, max_r=r, **kw).where(F.col("dist") < float(r))


def niche_metric(src: DataFrame, tgt: DataFrame, by, r: float = 20.0) -> DataFrame:
    """Share of sources within ``r`` of a target and the median nearest distance; groups without either side
    keep their counts and get NULL."""
    from ..functions import exact_percentiles
    by = as_list(by)
    d = nearest(src, tgt, by)
    n = (src.groupBy(*by).agg(n_rows().alias("n_source"))
         .join(tgt.groupBy(*by).agg(n_rows().alias("n_target")), by, "full_outer").fillna(0, ["n_source", "n_target"]))
    return (n.join(d.groupBy(*by).agg((100.0 * F.avg((F.col("dist") <= r).cast("double"))).alias("pct_within")), by, "left")
            .join(exact_percentiles(d, by, {"median_dist": ("dist", .5)}, derived=True), by, "left"))


# --- sliding windows ---------------------------------------------------------------------------------

def window_join(points: DataFrame, w: float, stride: float, by=(), x: str = "x", y: str = "y", keep=(), bounds: DataFrame | None = None) -> DataFrame:
    """One row per point and window that covers it. Windows start at the group minimum and step by
    ``stride`` while they end before the group maximum; each point is expanded into its own few windows.

    ``bounds`` (group, x_lo, x_hi, y_lo, y_hi) fixes the scanned extent, else that of the points is used.
    """
    by = as_list(by)
    one = None if by else "__all"
    keys = by or [one]
    pts = points.withColumn(one, F.lit(1)) if one else points
    ext = (bounds.withColumn(one, F.lit(1)) if one else bounds) if bounds is not None else pts.groupBy(*keys).agg(
        F.min(x).alias("x_lo"), F.max(x).alias("x_hi"), F.min(y).alias("y_lo"), F.max(y).alias("y_hi"))
    j = pts.join(ext, keys)

    def starts(v, lo):
        first = F.greatest(F.floor((F.col(v) - F.col(lo) - w) / stride), F.lit(0).cast("bigint"))
        last = F.floor((F.col(v) - F.col(lo)) / stride) + 1
        return F.sequence(first, F.greatest(last, first))

    j = j.withColumn("wx", F.explode(starts(x, "x_lo"))).withColumn("wy", F.explode(starts(y, "y_lo")))
    j = j.withColumns({"x0": F.col("x_lo") + F.col("wx") * F.lit(float(stride)), "y0": F.col("y_lo") + F.col("wy") * F.lit(float(stride))})
    inside = ((F.col(x) >= F.col("x0")) & (F.col(x) < F.col("x0") + w) & (F.col(y) >= F.col("y0")) & (F.col(y) < F.col("y0") + w)
              & (F.col("x0") < F.col("x_hi") - w) & (F.col("y0") < F.col("y_hi") - w))
    return j.where(inside).select(*by, "wx", "wy", "x0", "y0", *as_list(keep))


def pick_region(windows: DataFrame, by, score, eligible=None) -> DataFrame:
    """The best eligible window per group; equal scores go to the lowest window index."""
    w = windows if eligible is None else windows.where(eligible)
    return top_n_per_group(w.withColumn("score", score), by, [F.desc("score"), "wx", "wy"], 1)


def region_extract(df: DataFrame, windows: DataFrame, w: float, by=(), x: str = "x", y: str = "y", name: str = "region") -> DataFrame:
    """Rows inside chosen windows with local coordinates. ``windows`` holds (group, name, x0, y0).

    A window is keyed by the cells of size ``w`` it touches (at most four), so the join is an equi-join
    however many windows are chosen.
    """
    by = as_list(by)
    touched = windows.select(*by, name, "x0", "y0", F.explode(_offsets([(0, 0), (1, 0), (0, 1), (1, 1)])).alias("_o"))
    touched = touched.select(*by, name, "x0", "y0", (F.floor(F.col("x0") / w) + F.col("_o.i")).alias("cx"), (F.floor(F.col("y0") / w) + F.col("_o.j")).alias("cy"))
    return (cell_of(df, w, x, y).join(touched, [*by, "cx", "cy"])
            .where((F.col(x) >= F.col("x0")) & (F.col(x) < F.col("x0") + w) & (F.col(y) >= F.col("y0")) & (F.col(y) < F.col("y0") + w))
            .withColumns({"local_x": F.col(x) - F.col("x0"), "local_y": F.col(y) - F.col("y0")}).drop("cx", "cy"))


# --- shapes ------------------------------------------------------------------------------------------

def _hull(points):
    """Convex hull of (x, y) tuples, counter-clockwise from the lowest x; small helper inside a task."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    chains = []
    for seq in (pts, pts[::-1]):
        c = []
        for p in seq:
            while len(c) >= 2 and turn(c[-2], c[-1], p) <= 0:
                c.pop()
            c.append(p)
        chains.append(c[:-1])
    return chains[0] + chains[1]


PART = 2_000  # points per hull part


def convex_footprint(mol: DataFrame, key: str = "entity_id") -> DataFrame:
    """Hull vertices per entity with at least three molecules; flat point sets are left out.

    Only the lowest and highest point of every x can be a corner. Those are cut into parts of about 2,000 points,
    each part is reduced to its own hull, and the hull of the parts' corners is the hull of all points: an entity
    with very many molecules never reaches one task whole.
    """
    import pandas as pd
    from pyspark.sql.types import ArrayType, DoubleType

    def corners(xs, ys):
        return pd.Series([[v for p in _hull(list(zip(x.tolist(), y.tolist()))) for v in p] for x, y in zip(xs, ys)])

    corners.__annotations__ = {"xs": pd.Series, "ys": pd.Series, "return": pd.Series}
    corners = F.pandas_udf(corners, ArrayType(DoubleType()))
    size = mol.groupBy(key).agg(n_rows().alias("n"), F.count_distinct("x").alias("_nx")).where("n >= 3")
    pts = (mol.groupBy(key, "x").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
           .join(size, key)
           .select(key, "n", "_nx", "x", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("y")))
    for per_part in (PART, PART * 60, None):
        part = F.lit(0).cast("bigint") if per_part is None else F.pmod(F.xxhash64("x"), F.ceil(2 * F.col("_nx") / per_part))
        hull = (pts.groupBy(key, part.alias("_p")).agg(F.first("n").alias("n"), F.first("_nx").alias("_nx"),
                                                       F.collect_list("x").alias("_xs"), F.collect_list("y").alias("_ys"))
                .withColumn("_c", corners("_xs", "_ys")))
        at = lambda i, k: F.get("_c", 2 * F.col(i) + k)
        pts = hull.where("size(_c) > 0").withColumn("vertex", F.explode(F.sequence(F.lit(0), (F.size("_c") / 2 - 1).cast("int"))))
        pts = pts.select(key, "n", "_nx", (F.size("_c") / 2).alias("_k"), "vertex", at("vertex", 0).alias("x"), at("vertex", 1).alias("y"))
    return pts.where("_k >= 3").select(key, "n", "vertex", "x", "y")


def polygon_area(hull: DataFrame, key: str = "entity_id") -> DataFrame:
    """Area of each hull from its ordered vertices."""
    w = W.partitionBy(key).orderBy("vertex")
    first = W.partitionBy(key).orderBy("vertex").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    nx, ny = F.coalesce(F.lead("x").over(w), F.first("x").over(first)), F.coalesce(F.lead("y").over(w), F.first("y").over(first))
    return (hull.withColumns({"nx": nx, "ny": ny}).groupBy(key)
            .agg((F.abs(F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y"))) / 2.0).alias("area"), n_rows().alias("n_vertices")))


def entity_diagnostics(mol: DataFrame, labels: DataFrame, key: str = "entity_id", min_tx: int = 3, hull_min: int = 6, fallback_min: int = 5,
                       depth: str = "y", by="sample") -> DataFrame:
    """Per entity: size, centroid, whether a solid hull exists (enough distinct points that do not share one
    plane), rank by depth axis and whether it is drawn."""
    from ..functions import prefix_sums
    by = as_list(by)
    pts = mol.select(key, "x", "y", "z").groupBy(key, "x", "y", "z").agg(n_rows().alias("m"))
    c = lambda a, b: F.covar_pop(a, b)
    g = pts.groupBy(key).agg(
        F.sum("m").alias("n_transcripts"), n_rows().alias("n_distinct"),
        *[(F.sum(F.col("m") * F.col(v)) / F.sum("m")).alias(f"centroid_{v}") for v in "xyz"],
        *[c(a, b).alias(f"c{a}{b}") for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")])
    xx, yy, zz, xy, xz, yz = [F.col(f"c{p}") for p in ("xx", "yy", "zz", "xy", "xz", "yz")]
    det = xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz)
    # full rank up to rounding, relative to the product of the variances
    solid = (F.col("n_distinct") >= hull_min) & (det > F.lit(1e-9) * xx * yy * zz)
    d = (g.where(F.col("n_transcripts") >= min_tx).join(labels, key)
         .withColumn("fallback", ~F.coalesce(solid, F.lit(False)))
         .withColumn("rendered", ~F.col("fallback") | (F.col("n_transcripts") >= fallback_min)))
    pos = f"centroid_{depth}"
    seats = prefix_sums(d.groupBy(*by, F.col(pos)).agg(n_rows().alias("_m")), by, pos, {"_above": "_m"}, descending=True)
    tie = W.partitionBy(*by, pos).orderBy(key)
    return (d.join(seats, [*by, pos]).withColumn("rank_3d", F.col("_above") + F.row_number().over(tie) - 1)
            .select(*by, key, "n_transcripts", "centroid_x", "centroid_y", "centroid_z", "fallback", "rendered", "rank_3d"))
