"""Near-duplicate embeddings by cover trees and dual traversal.

Unit vectors are compared by chord distance: a cosine of ``cosine`` or more is a distance of ``tau`` or less. A node of a cover tree has a
centre, a covering radius and children on a net of half that radius. Two nodes are dropped when their centres are further apart than
both radii and ``tau``; when even their far ends are within ``tau``, all their pairs are links and are counted at once; otherwise their
children meet. Single vectors are compared by their cosine in double precision. So the links found are exactly those at or above
the threshold.

The upper levels are made by Spark: each label (with each number of dimensions) is a cell, and a cell of more than ``CELL`` vectors is
split at centres of a bounded sample of it, farthest first, until cells are small or so tight that all their pairs are links.
A vector visits another cell only if it is within that cell's radius and ``tau`` of its centre. The lower levels are trees inside a task,
of bounded cells and bounded slices of visitors. Tasks return link counts and a spanning forest, never the list of pairs.

Equal vectors of one label are merged and weighted first. A null label, and a vector that is null, empty, zero or holds null or non-finite
components, links with nothing. Rows without a vec_id are counted but name no component. In many dimensions without clusters,
few pairs of cells can be dropped and the work nears that of all pairs: this is a limit of any covering radius.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from spatialframe.functions.components import component_roots
from spatialframe.functions.durable import Scratch

CELL, SLICE, SAMPLE, FAN = 4096, 8192, 512, 64
FARTHEST = 64                  # farthest members of a cell that are tried as its centres too
EPS = 1e-7                     # above the rounding of a chord distance
TILE = 1024


def chord(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ y.T)))


class CoverTree:
    """Nested nets with halving radii over the rows of ``x``."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.centre, self.radius, self.children, self.members = [], [], [], []
        self.root = self._add(np.arange(len(x)))
        todo = [self.root]
        while todo:
            node = todo.pop()
            idx = self.members[node]
            if len(idx) == 1:
                continue
            if self.radius[node] <= EPS:                   # rounding apart, one point
                parts = [idx[i:i + 1] for i in range(len(idx))]
            else:
                parts, half = [], self.radius[node] / 2
                while len(idx):
                    near = chord(x[idx[:1]], x[idx])[0] <= half
                    near[0] = True
                    parts.append(idx[near])
                    idx = idx[~near]
            self.children[node] = [self._add(p) for p in parts]
            todo += self.children[node]
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)
        self.single = np.array([not c for c in self.children])

    def _add(self, idx: np.ndarray) -> int:
        self.centre.append(int(idx[0]))
        self.radius.append(float(chord(self.x[idx[:1]], self.x[idx]).max()) if len(idx) > 1 else 0.0)
        self.children.append([])
        self.members.append(idx)
        return len(self.members) - 1

    def below(self, node: int) -> list[int]:
        return self.children[node] or [node]


class Links:
    """Weighted link counts of the points of two sets and the smallest point each is connected to."""

    def __init__(self, weights: np.ndarray):
        self.w, self.count, self.up = weights, np.zeros(len(weights), np.int64), list(range(len(weights)))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)

    def all_pairs(self, p: np.ndarray, q: np.ndarray) -> None:
        self.count[p] += self.w[q].sum()
        self.count[q] += self.w[p].sum()
        for i in (*p, *q):
            self.join(int(i), int(p[0]))

    def matrix(self, p: np.ndarray, q: np.ndarray, linked: np.ndarray) -> None:
        """``linked[i, j]``: point p[i] links with q[j]."""
        self.count[p] += linked @ self.w[q]
        self.count[q] += linked.T @ self.w[p]
        while True:
            open_ = linked & (np.array([self.root(int(i)) for i in p])[:, None] != np.array([self.root(int(j)) for j in q])[None, :])
            rows = np.flatnonzero(open_.any(axis=1))
            if not len(rows):
                return
            for i, j in zip(rows, open_[rows].argmax(axis=1)):
                self.join(int(p[i]), int(q[j]))


def dual(one: CoverTree, two: CoverTree, links: Links, shift: int, cosine: float) -> None:
    """Find all links between the points of two trees (or within one, if they are the same). Points of ``two`` are numbered from ``shift``."""
    tau = float(np.sqrt(2 - 2 * cosine))
    same = one is two
    todo = [([one.root], [two.root], same)]
    while todo:
        left, right, own = todo.pop()
        if own and len(left) == 1:
            if not one.single[left[0]]:
                todo.append((one.children[left[0]], one.children[left[0]], True))
            continue
        if own:
            todo += [([n], [n], True) for n in left if not one.single[n]]
        left, right = np.array(left), np.array(right)
        for a in range(0, len(left), TILE):
            for b in range(a if own else 0, len(right), TILE):
                p, q = left[a:a + TILE], right[b:b + TILE]
                cos = one.x[one.centre[p]] @ two.x[two.centre[q]].T
                d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cos))
                reach = one.radius[p][:, None] + two.radius[q][None, :]
                near = d <= reach + tau + EPS
                if own and a == b:
                    near &= np.tri(len(p), len(q), -1, dtype=bool).T
                leaves = one.single[p][:, None] & two.single[q][None, :]
                linked = near & leaves & (cos >= cosine)
                if linked.any():
                    r, c = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
                    links.matrix(one.centre[p[r]], shift + two.centre[q[c]], linked[np.ix_(r, c)])
                for i, j in zip(*np.nonzero(near & ~leaves)):
                    m, n = int(p[i]), int(q[j])
                    if d[i, j] + reach[i, j] <= tau - EPS:
                        links.all_pairs(one.members[m], shift + two.members[n])
                    else:
                        todo.append((one.below(m), two.below(n), False))


def _found(nodes: np.ndarray, links: Links) -> pd.DataFrame:
    hit = np.flatnonzero(links.count)
    return pd.DataFrame({"node": nodes[hit], "links": links.count[hit], "root": [int(nodes[links.root(int(i))]) for i in hit]}).astype("int64")


def _stack(vecs) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vecs])


@F.pandas_udf(ArrayType(DoubleType()))
def unit_vector(vectors: pd.Series) -> pd.Series:
    """Unit vector in double precision, scaled by the largest component first so that no square overflows; null if unusable."""
    def one(v):
        x = np.array([np.nan if c is None else c for c in v] if v is not None and v.dtype == object else v if v is not None else [], np.float64)
        if not len(x) or not np.isfinite(x).all() or not x.any():
            return None
        x = x / np.abs(x).max()
        return x / np.sqrt(x @ x)
    return pd.Series([one(v) for v in vectors], dtype=object)


def link_vectors(rows: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                 cell: int = CELL, piece: int = SLICE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row."""
    scratch = Scratch(rows.sparkSession)
    tau = float(np.sqrt(2 - 2 * cosine))
    base = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
                       F.when(F.col(label_col).isNotNull(), unit_vector(F.transform(vec_col, lambda x: x.cast("double")))).alias("unit"))
    # equal vectors of a label are one node with a weight
    nodes = (base.where("unit is not null").groupBy("label", "unit").agg(F.count(F.lit(1)).alias("w"), F.min("vec_id").alias("least"))
             .withColumn("node", F.monotonically_increasing_id()).withColumn("tribe", F.concat_ws("|", F.size("unit"), "label")))
    nodes = scratch.keep(nodes, "nodes")                   # written, so a node keeps its number

    cells = scratch.keep(nodes.select("node", "tribe", "unit", "w", F.col("tribe").alias("cell"), F.lit(None).cast("double").alias("d")), "cells")
    while True:
        # cells that are still large and not so tight that all their pairs are links
        large = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("radius")).where((F.col("n") > cell) & (F.col("radius").isNull() | (F.col("radius") > tau / 2 - EPS)))
        large = scratch.keep(large.select("cell", "n"), "large")
        if large.isEmpty():
            break
        inside = cells.join(large, "cell")
        by = lambda *order: F.row_number().over(W.partitionBy("cell").orderBy(*order))
        drawn = inside.withColumn("r", by(F.xxhash64("node"), "node")).where(F.col("r") <= SAMPLE).select("cell", "n", "unit")
        if "centre" in inside.columns:
            # the cell's centre and its farthest members: more than tau / 2 apart, so both can't stay in one cell and every cell gets smaller
            far = inside.withColumn("r", by(F.col("d").desc(), "node")).where(F.col("r") <= FARTHEST)
            drawn = drawn.unionByName(far.select("cell", "n", "unit")).unionByName(far.where("r = 1").select("cell", "n", F.col("centre").alias("unit")))

        def centres(pdf: pd.DataFrame) -> pd.DataFrame:
            x, n = _stack(pdf["unit"]), int(pdf["n"].iloc[0])
            want = min(FAN, len(x), max(2, 2 * -(-n // cell)))
            chosen, d = [0], chord(x[:1], x)[0]
            while len(chosen) < want and d.max() > 0:
                chosen.append(int(d.argmax()))
                d = np.minimum(d, chord(x[chosen[-1:]], x)[0])
            return pd.DataFrame({"cell": pdf["cell"].iloc[0], "n": n, "k": range(len(chosen)), "centre": list(x[chosen])})
        picked = drawn.groupBy("cell").applyInPandas(centres, "cell string, n long, k int, centre array<double>")
        picked = scratch.keep(picked, "centres")
        slices = (F.ceil(F.col("n") / piece)).cast("long")
        ours = inside.withColumn("slice", F.pmod(F.xxhash64("node"), slices)).drop("n")
        theirs = picked.select("cell", "k", "centre", F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)).alias("slice"))

        def assign(pdf: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
            at = at.sort_values("k")
            d = chord(_stack(pdf["unit"]), _stack(at["centre"]))
            to = d.argmin(axis=1)
            pdf["d"] = d[np.arange(len(pdf)), to]
            pdf["centre"] = [at["centre"].iloc[i] for i in to]
            pdf["cell"] = [f"{c}/{k}" for c, k in zip(pdf["cell"], to)]
            return pdf[["node", "tribe", "unit", "w", "cell", "d", "centre"]]
        split = ours.groupBy("cell", "slice").cogroup(theirs.groupBy("cell", "slice")).applyInPandas(assign, "node long, tribe string, unit array<double>, w long, cell string, d double, centre array<double>")
        rest = cells.join(large.select("cell"), "cell", "left_anti")
        if "centre" not in rest.columns:
            rest = rest.withColumn("centre", F.lit(None).cast("array<double>"))
        cells = scratch.keep(split.unionByName(rest), "cells")
    scratch.drop("large", "centres")

    per_cell = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("all"), F.min("node").alias("first"))
    packed = cells.join(per_cell, "cell")

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        tree, links = CoverTree(_stack(pdf["unit"])), Links(pdf["w"].to_numpy(np.int64))
        dual(tree, tree, links, 0, cosine)
        return _found(pdf["node"].to_numpy(np.int64), links)
    schema = "node long, links long, root long"
    small = packed.where(F.col("n") <= cell).where("n > 1").select("cell", "node", "unit", "w").groupBy("cell").applyInPandas(within, schema)
    tight = packed.where(F.col("n") > cell).select("node", (F.col("all") - F.col("w")).alias("links"), F.col("first").alias("root"))
    found = small.unionByName(tight)

    if "centre" in cells.columns:
        # vectors that visit other cells of their tribe; of two cells the later one visits the earlier
        borders = cells.where("centre is not null").groupBy("tribe", "cell").agg(F.first("centre").alias("centre"), F.max("d").alias("radius"), F.count(F.lit(1)).alias("n"))
        borders = scratch.keep(borders, "borders")
        spread = borders.groupBy("tribe").agg(F.ceil(F.sum("n") / piece).cast("long").alias("slices"))
        ours = cells.where("centre is not null").join(spread, "tribe").withColumn("slice", F.pmod(F.xxhash64("node"), F.col("slices")))
        theirs = borders.join(spread, "tribe").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))

        def visit(pdf: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
            at = at.sort_values("cell")
            d = chord(_stack(pdf["unit"]), _stack(at["centre"])) if len(pdf) and len(at) else np.empty((len(pdf), len(at)))
            near = (d <= at["radius"].to_numpy()[None, :] + tau + EPS) & (at["cell"].to_numpy()[None, :] < pdf["cell"].to_numpy()[:, None])
            i, j = np.nonzero(near)
            return pd.DataFrame({"cell": at["cell"].to_numpy()[j], "n": at["n"].to_numpy()[j], "node": pdf["node"].to_numpy()[i], "unit": pdf["unit"].to_numpy()[i], "w": pdf["w"].to_numpy()[i]})
        visits = ours.select("tribe", "slice", "cell", "node", "unit", "w").groupBy("tribe", "slice").cogroup(theirs.select("tribe", "slice", "cell", "centre", "radius", "n").groupBy("tribe", "slice")).applyInPandas(
            visit, "cell string, n long, node long, unit array<double>, w long")
        visits = scratch.keep(visits, "visits")
        # a task meets one slice of a cell's members and one slice of its visitors
        count = visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / piece).cast("long").alias("v"), F.ceil(F.max("n") / piece).cast("long").alias("m"))
        every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
        guests = visits.join(count, "cell").withColumn("vs", F.pmod(F.xxhash64("node"), F.col("v"))).withColumn("ms", every("m"))
        hosts = cells.select("cell", "node", "unit", "w").join(count, "cell").withColumn("ms", F.pmod(F.xxhash64("node"), F.col("m"))).withColumn("vs", every("v"))

        def across(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if a.empty or b.empty:
                return pd.DataFrame({"node": [], "links": [], "root": []}).astype("int64")
            a, b = a.sort_values("node"), b.sort_values("node")
            one, two = CoverTree(_stack(a["unit"])), CoverTree(_stack(b["unit"]))
            links = Links(np.concatenate([a["w"], b["w"]]).astype(np.int64))
            dual(one, two, links, len(a), cosine)
            return _found(np.concatenate([a["node"], b["node"]]).astype(np.int64), links)
        keys = ["cell", "ms", "vs"]
        found = found.unionByName(hosts.select(*keys, "node", "unit", "w").groupBy(*keys).cogroup(guests.select(*keys, "node", "unit", "w").groupBy(*keys)).applyInPandas(across, schema))
    found = scratch.keep(found, "found")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = component_roots(found.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch)
    named = nodes.join(counts, "node", "left").join(roots, "node", "left").select("label", "unit", "w", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = scratch.keep(named.join(smallest, "root").select(F.col("label").alias("__l"), F.col("unit").alias("__u"), (F.col("links") + F.col("w") - 1).alias("n_links"), "component_id"), "named")
    scratch.close("named")
    out = base.join(named, (F.col("label") == F.col("__l")) & (F.col("unit") == F.col("__u")), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
                      (F.col("vec_id") == F.coalesce("component_id", "vec_id")).alias("kept"))
