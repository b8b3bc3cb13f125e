"""Dense profiles: exact k nearest neighbours and a shared low-dimensional space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions import as_list, hash_hex, n_rows
from ..functions.durable import durable
from .windows import rank_within, top_n_per_group

MAX_PIVOTS = 1024
SHELF = 1 << 21  # numbers of the vectors on one shelf: one side of a distance block
SHELF_ROWS = 32_768
AT_ONCE = 1 << 22  # distances a task holds at once
EXACT_AT_ONCE = 1 << 22  # numbers of the differences a task holds at once


def _sq_dist(q: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.maximum((q * q).sum(1)[:, None] + (s * s).sum(1)[None, :] - 2.0 * q @ s.T, 0.0)


def _rows(vectors: pa.ListArray | pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.asarray(pc.list_flatten(vectors), np.float64).reshape(-1, dim)


def _shelves(size: np.ndarray, pivots: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells dealt to shelves of about ``rows`` points, near cells together: the first shelf of each cell and how many it takes.
    A cell of more points has shelves of its own."""
    first, parts = np.zeros(len(size), np.int64), np.maximum(1, -(-size // rows))
    todo = np.flatnonzero(size > 0).tolist()
    at, shelf, held = todo[0], 0, 0
    while todo:
        todo.remove(at)
        if held and (parts[at] > 1 or held + size[at] > rows):
            shelf, held = shelf + 1, 0
        first[at], held = shelf, held + size[at]
        if parts[at] > 1:
            shelf, held = shelf + int(parts[at]), 0
        if todo:
            at = todo[int(((pivots[todo] - pivots[at]) ** 2).sum(1).argmin())]
    return first, parts


def feature_knn(prof: DataFrame, k: int, id: str = "id", vec: str = "vector", seed=0) -> DataFrame:
    """The k nearest other points of every point (Euclidean), exact: (id, neighbor_id, dist, rank).

    Points are assigned to pivots. From each pivot's distance range and its k + 1 closest members every point gets
    an upper bound on its k-th distance, and needs only the cells the triangle inequality cannot rule out. Near cells share
    a shelf of bounded size, a larger cell takes several. A point travels once to each shelf that holds a cell it needs, not
    once to each cell; a pair of shelves is one task, which keeps k rows per point and a bounded number of distances at
    a time. Where nothing can be ruled out, all pairs are met. Equal distances are ordered by id.
    """
    kind = dict(prof.dtypes)[id]
    pts = prof.select(F.col(id).alias("id"), F.transform(vec, lambda v: v.cast("double")).alias("v"))
    n = pts.count()
    n_piv = int(min(MAX_PIVOTS, max(1, round(n ** 0.5 / 2))))
    # a bounded set of pivot vectors, chosen by hash
    picked = pts.withColumn("_h", hash_hex(seed, F.col("id"))).orderBy("_h", "id").limit(n_piv).select("v").collect()
    pivots = np.array([r["v"] for r in picked], dtype=np.float64).reshape(len(picked), -1)
    if n == 0:
        return prof.sparkSession.createDataFrame([], f"id {kind}, neighbor_id {kind}, dist double, rank int")
    dim = pivots.shape[1]

    def slices(b: pa.RecordBatch, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        step = max(1, AT_ONCE // max(width, dim))
        for at in range(0, b.num_rows, step):
            part = b.slice(at, step)
            yield part, _rows(part["v"], dim)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, v in slices(b, n_piv):
                d = np.sqrt(_sq_dist(v, pivots))
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([part["id"], part["v"], pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(v)), cell])], ["id", "v", "cell", "dp"])

    placed = durable(pts.mapInArrow(assign, f"id {kind}, v array<double>, cell int, dp double"))
    # per cell: size, largest radius and the k + 1 smallest radii - at most MAX_PIVOTS small rows
    stats = placed.groupBy("cell").agg(n_rows().alias("n"), F.max("dp").alias("far")).collect()
    close = (top_n_per_group(placed.select("cell", "dp", "id"), "cell", ["dp", "id"], k + 1)
             .groupBy("cell").agg(F.collect_list("dp").alias("d")).collect())
    size, far = np.zeros(n_piv, np.int64), np.full(n_piv, -np.inf)
    for r in stats:
        size[r["cell"]], far[r["cell"]] = r["n"], r["far"]
    owner = np.concatenate([np.full(len(r["d"]), r["cell"]) for r in close])
    radius = np.concatenate([np.asarray(r["d"]) for r in close])
    # squares of distances are rounded to the vectors' length, not to the distance
    slack = 1e-6 * (np.sqrt((pivots * pivots).sum(1).max()) + far.max())
    rows = max(256, min(SHELF_ROWS, SHELF // dim, max(2048, -(-n // 4))))
    first, parts = _shelves(size, pivots, rows)
    n_shelves = int((first + parts)[size > 0].max())
    on = np.zeros((n_piv, n_shelves), np.float32)
    for c in np.flatnonzero(size > 0):
        on[c, first[c]:first[c] + parts[c]] = 1.0

    def needed(d: np.ndarray, bound: np.ndarray) -> np.ndarray:
        return (d - far[None, :] <= bound[:, None] * (1 + 1e-9) + slack) & (size[None, :] > 0)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, v in slices(b, len(radius)):
                d = np.sqrt(_sq_dist(v, pivots))
                bound = np.full(len(v), np.inf)
                if len(radius) > k:  # position k, because the point itself is counted once
                    bound = np.partition(d[:, owner] + radius[None, :], k, axis=1)[:, k]
                row, to = np.nonzero(needed(d, bound).astype(np.float32) @ on > 0)
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(v)))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part["id"], part["v"], part["cell"], pa.array(bound), pa.ListArray.from_arrays(pa.array(ends), pa.array(to.astype(np.int32)))],
                                                 ["id", "v", "cell", "bound", "visits"])

    dealt = prof.sparkSession.createDataFrame([(int(c), int(first[c]), int(parts[c])) for c in np.flatnonzero(size > 0)], "cell int, _first int, _parts int")
    asked = placed.select("id", "v", "cell").mapInArrow(visit, f"id {kind}, v array<double>, cell int, bound double, visits array<int>")
    asked = durable(asked.join(F.broadcast(dealt), "cell").select(
        "id", "v", "cell", "bound", "visits", (F.col("_first") + F.pmod(F.xxhash64("id"), F.col("_parts"))).cast("int").alias("shelf")))
    q = asked.select("id", "v", "cell", "bound", F.col("shelf").alias("qs"), F.explode("visits").alias("ss"))
    pairs = durable(asked.select(F.col("shelf").alias("qs"), F.explode("visits").alias("ss")).distinct())  # shelves x shelves rows
    own = lambda *cols: [F.col(c).alias(c) for c in cols]  # columns of their own, as both sides of the cogroup come from one table
    s = asked.select(*own("id", "v", "cell"), F.col("shelf").alias("ss")).join(F.broadcast(pairs), "ss")

    def block(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        if a.num_rows and b.num_rows:
            a, b = a.sort_by("cell"), b.sort_by("cell")
            qa, sb = _rows(a["v"], dim), _rows(b["v"], dim)
            bound, cells = a["bound"].to_numpy(), b["cell"].to_numpy()
            code = np.unique(np.concatenate([a["id"].to_numpy(), b["id"].to_numpy()]), return_inverse=True)[1]
            qi, si = code[:a.num_rows], code[a.num_rows:]
            step = max(1, AT_ONCE // max(len(sb), n_piv))
            for at in range(0, len(qa), step):
                x = qa[at:at + step]
                need = needed(np.sqrt(_sq_dist(x, pivots)), bound[at:at + step]).any(0)[cells]
                col = np.flatnonzero(need)
                if not len(col):
                    continue
                y, yi = (sb, si) if need.all() else (sb[col], si[col])
                d = _sq_dist(x, y)
                d[qi[at:at + step, None] == yi[None, :]] = np.inf
                # the k-th of some columns bounds the k-th of all; a shortlist with room for rounding, then exact differences decide
                some = d[:, ::max(1, min(8, d.shape[1] // (8 * k)))]
                cut = np.partition(some, k - 1, axis=1)[:, k - 1] if some.shape[1] >= k else np.full(len(x), np.inf)
                room = 1e-12 * ((x * x).sum(1) + (y * y).sum(1).max())
                r, c = np.nonzero((d <= (cut * (1 + 1e-9) + room)[:, None]) & np.isfinite(d))
                del d, some
                exact = np.empty(len(r))
                for i in range(0, len(r), max(1, EXACT_AT_ONCE // dim)):
                    j = slice(i, i + max(1, EXACT_AT_ONCE // dim))
                    exact[j] = ((x[r[j]] - y[c[j]]) ** 2).sum(1)
                order = np.lexsort((yi[c], exact, r))
                r, c, exact = r[order], c[order], exact[order]
                keep = np.arange(len(r)) - np.searchsorted(r, r) < k
                out.append((at + r[keep], col[c[keep]], exact[keep]))
        row, col, d2 = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table([a["id"].take(pa.array(row)), b["id"].take(pa.array(col)), pa.array(d2)], ["id", "neighbor_id", "d2"])

    best = q.groupBy("qs", "ss").cogroup(s.groupBy("qs", "ss")).applyInArrow(block, f"id {kind}, neighbor_id {kind}, d2 double")
    best = top_n_per_group(best, "id", ["d2", "neighbor_id"], k)
    return rank_within(best, "id", ["d2", "neighbor_id"]).select("id", "neighbor_id", F.sqrt("d2").alias("dist"), "rank")


def shared_embedding(prof: DataFrame, k: int = 30, id: str = "id", vec: str = "vector", arm: str = "arm", lognorm: bool = True) -> DataFrame:
    """Project all arms into one principal-component space fitted on all rows, each arm with the same weight.

    Profiles are log-normalised (optional), scaled with mean and sd (sd below 1e-6 counts as 1) and clipped to +-10.
    Each task sums its second moments per arm; only the matrix of dimensions meets the driver. Each component's sign
    makes its largest loading positive. A NULL vector stays out of the fit and has NULL scores.
    """
    v = F.transform(vec, lambda x: x.cast("double"))
    if lognorm:
        tot = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
        v = F.transform(v, lambda x: F.log1p(x / F.when(tot == 0, 1.0).otherwise(tot) * 1e4))
    base = prof.select(F.col(id).alias("id"), F.col(arm).alias("arm"), v.alias("v"))
    per_arm = base.select("arm", F.posexplode("v").alias("i", "x")).groupBy("arm", "i").agg(F.avg("x").alias("m"), F.var_pop("x").alias("s2"))
    # one mean and sd per dimension
    st = per_arm.groupBy("i").agg(F.avg("m").alias("m"), F.sqrt(F.avg("s2") + F.var_pop("m")).alias("s")).orderBy("i").collect()
    if not st:
        return base.select("id", "arm", F.lit(None).cast("array<double>").alias("pcs"))
    mean = np.array([r["m"] for r in st])
    sd = np.array([r["s"] if r["s"] >= 1e-6 else 1.0 for r in st])
    d = len(st)

    def unit(vectors: pa.ListArray) -> np.ndarray:
        return np.clip((vectors.flatten().to_numpy().reshape(-1, d) - mean) / sd, -10.0, 10.0)

    def moments(batches):
        sums: dict = {}
        for b in batches:
            arms = np.array(b["arm"].to_pylist(), object)
            x = unit(b["v"])
            for a in set(arms.tolist()):
                y = x[np.array([z == a for z in arms], bool)]
                sums[a] = sums.get(a, 0.0) + np.concatenate([[len(y)], y.sum(0), (y.T @ y).ravel()])
        for a, t in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([a], kind), pa.array([t.tolist()], pa.list_(pa.float64()))], ["arm", "t"])

    kind = to_arrow_type(base.schema["arm"].dataType)
    parts = base.where("v is not null").select("arm", "v").mapInArrow(moments, StructType([base.schema["arm"], StructField("t", ArrayType(DoubleType()))]))
    whole = parts.select("arm", F.element_at("t", 1).alias("n"), F.posexplode("t").alias("i", "t")).groupBy("arm", "i").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    t = np.array([r["t"] for r in whole.groupBy("i").agg(F.avg(F.col("t") / F.col("n")).alias("t")).orderBy("i").collect()])
    center = t[1:d + 1]
    load = np.linalg.eigh(t[d + 1:].reshape(d, d) - np.outer(center, center))[1][:, ::-1][:, :k]
    load = load * np.sign(load[np.abs(load).argmax(0), np.arange(load.shape[1])])

    def project(batches):
        for b in batches:
            known = b["v"].is_valid().to_numpy(zero_copy_only=False)
            scores = iter((unit(b["v"].drop_null()) @ load).tolist())
            pcs = pa.array([next(scores) if y else None for y in known], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b["id"], b["arm"], pcs], ["id", "arm", "pcs"])
    return base.mapInArrow(project, StructType([base.schema["id"], base.schema["arm"], StructField("pcs", ArrayType(DoubleType()))]))


WIDE_BLOCK = 1 << 21  # numbers of one slice of rows


def _new_directions(y: np.ndarray, basis: np.ndarray, floor: float) -> np.ndarray:
    """Orthonormal columns spanning ``y`` outside of ``basis``; directions shorter than ``floor`` are left out."""
    for _ in range(2):
        y = y - basis @ (basis.T @ y)
    u, size, _ = np.linalg.svd(y, full_matrices=False)
    u = u[:, size > floor]
    return np.linalg.qr(u - basis @ (basis.T @ u))[0]


def wide_embedding(prof: DataFrame, k: int = 30, id: str = "id", vec: str = "vector", arm: str = "arm", lognorm: bool = True,
                   extra: int = 10, tol: float = 1e-8, max_blocks: int = 6, seed: int = 0) -> DataFrame:
    """``shared_embedding`` for profiles of thousands of dimensions: (id, arm, pcs), the same scores, without a matrix of dimensions x dimensions.

    A random basis of ``k + extra`` columns is multiplied by the covariance in one pass over the rows per round: a row y adds w y (y' X), with w
    giving each arm the same weight. The driver holds at most ``max_blocks`` such bases of d rows, takes the best vectors of all products so far
    and asks for the next product along their residuals, until the largest residual of the first ``k`` is below ``tol`` times the largest
    eigenvalue. A basis that is full is cut back to its best ``2 (k + extra)`` vectors, whose products are known. Each task emits one row per
    dimension. Scaling, clipping and signs are those of ``shared_embedding``; vectors of equal eigenvalue are any basis of their space.

    A vector that is NULL or holds a NULL or a NaN stays out of the fit and has NULL scores; a NULL arm is an arm. With fewer than ``k`` dimensions
    there is one score per dimension. Vectors of different lengths stop the job.
    """
    v = F.transform(vec, lambda x: x.cast("double"))
    v = F.when(~F.exists(v, lambda x: x.isNull() | F.isnan(x)), v)
    if lognorm:
        tot = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
        v = F.transform(v, lambda x: F.log1p(x / F.when(tot == 0, 1.0).otherwise(tot) * 1e4))
    base = durable(prof.select(F.col(id).alias("id"), F.col(arm).alias("arm"), v.alias("v")))
    known = base.where("v is not null")
    per_arm = known.select("arm", F.posexplode("v").alias("i", "x")).groupBy("arm", "i").agg(
        F.avg("x").alias("m"), F.var_pop("x").alias("s2"), n_rows().alias("n"))
    st = per_arm.groupBy("i").agg(F.avg("m").alias("m"), F.sqrt(F.avg("s2") + F.var_pop("m")).alias("s"), n_rows().alias("arms"), F.sum("n").alias("n")).orderBy("i").collect()
    if not st:
        return base.select("id", "arm", F.lit(None).cast("array<double>").alias("pcs"))
    if len({(r["arms"], r["n"]) for r in st}) > 1:
        raise ValueError("vectors of different lengths")
    mean = np.array([r["m"] for r in st])
    sd = np.array([r["s"] if r["s"] >= 1e-6 else 1.0 for r in st])
    d, arms = len(st), st[0]["arms"]
    weight = known.groupBy("arm").agg((1.0 / (n_rows() * arms)).alias("w"))
    fit = known.join(weight, known["arm"].eqNullSafe(weight["arm"])).select("v", "w")

    def slices(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        step = max(1, WIDE_BLOCK // d)
        for at in range(0, b.num_rows, step):
            part = b.slice(at, step)
            flat = part["v"].drop_null().flatten().to_numpy()
            yield part, np.clip((flat.reshape(-1, d) - mean) / sd, -10.0, 10.0)

    def times_covariance(x: np.ndarray) -> np.ndarray:
        width = x.shape[1]
        names = [f"c{j}" for j in range(width + 1)]

        def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((d, width + 1))
            for b in batches:
                for part, y in slices(b):
                    w = part["w"].to_numpy()[:, None]
                    total += y.T @ np.hstack([w * (y @ x), w])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), *(pa.array(c) for c in total.T)], ["i", *names])

        sums = (fit.mapInArrow(products, "i int, " + ", ".join(f"{c} double" for c in names)).groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).orderBy("i"))
        t = np.array([list(r)[1:] for r in sums.collect()])
        return t[:, :width] - np.outer(t[:, width], t[:, width] @ x)

    width = min(d, k + extra)
    x = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, width)))[0]
    basis, image = np.zeros((d, 0)), np.zeros((d, 0))
    while True:
        basis, image = np.hstack([basis, x]), np.hstack([image, times_covariance(x)])
        small = basis.T @ image
        value, turn = np.linalg.eigh((small + small.T) / 2)
        value, turn = value[::-1], turn[:, ::-1]
        left = image @ turn[:, :width] - basis @ turn[:, :width] * value[:width]
        top = max(value[0], np.finfo(float).tiny)
        if basis.shape[1] == d or np.linalg.norm(left[:, :k], axis=0).max() <= tol * top:
            break
        if basis.shape[1] + width > max_blocks * width:
            basis, image = basis @ turn[:, :2 * width], image @ turn[:, :2 * width]
        x = _new_directions(left, basis, 1e-14 * top)[:, :d - basis.shape[1]]
    load = basis @ turn[:, :k]
    load = load * np.sign(load[np.abs(load).argmax(0), np.arange(load.shape[1])])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, y in slices(b):
                scores = iter((y @ load).tolist())
                pcs = pa.array([next(scores) if z else None for z in part["v"].is_valid().to_pylist()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part["id"], part["arm"], pcs], ["id", "arm", "pcs"])
    return base.mapInArrow(project, StructType([base.schema["id"], base.schema["arm"], StructField("pcs", ArrayType(DoubleType()))]))
