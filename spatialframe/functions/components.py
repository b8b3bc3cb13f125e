"""Connected components by contraction: no step gathers the neighbours of a node in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .durable import Scratch


def component_roots(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of an edge list of longs; ``root`` is the smallest node of its component. The result is a table of
    ``scratch`` named ``roots``.

    Each round gives every node its smallest neighbour (a combined aggregate) unless it is smaller itself, follows these parents to
    their end by doubling, and puts the ends in place of the nodes. Every component with an edge at least halves, so the number
    of rounds grows with the logarithm of the nodes. The joins have one row per node on one side: a hub's edges on the other are split
    by adaptive execution.
    """
    edges = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    edges = scratch.keep(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    roots = None
    while True:
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = scratch.keep(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("root")), "up")
        while True:
            above = up.select(F.col("node").alias("root"), F.col("root").alias("above"))
            nxt = scratch.keep(up.join(above, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), "next")
            moved = not nxt.where("moved").isEmpty()
            up = scratch.keep(nxt.select("node", "root"), "up") if moved else nxt.select("node", "root")
            if not moved:
                break
        if roots is None:
            roots = scratch.keep(up, "roots")
        else:
            step = up.select(F.col("node").alias("root"), F.col("root").alias("above"))
            roots = scratch.keep(roots.join(step, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "roots")
        ends = lambda side: up.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
        moved_edges = edges.join(ends("a"), "a").join(ends("b"), "b").where("a_root <> b_root")
        edges = scratch.keep(moved_edges.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct(), "edges")
    if roots is None:
        roots = scratch.keep(edges.select(F.col("a").alias("node"), F.col("b").alias("root")), "roots")
    scratch.drop("edges", "up", "next")
    return roots
