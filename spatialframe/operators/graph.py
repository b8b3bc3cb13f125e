"""Radius graphs: components and mixed-graph topology."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from ..functions import as_list, n_rows
from ..functions.durable import Scratch, durable
from .spatial import self_pairs, weighted_sites
from .windows import top_n_per_group


def _batch_stars(e: DataFrame, by: list[str]) -> DataFrame:
    """(group, node, root) for the ends of the edges of every Arrow batch by itself: ``root`` is the smallest node that edges of the batch connect
    with the node, itself included. Equal components of a smaller graph: a node in several batches has a row for each."""
    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            group = np.zeros(b.num_rows, np.int64)
            for c in by:
                kinds = pc.dictionary_encode(b[c], null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                group = np.unique(group * (b.num_rows + 1) + kinds, return_inverse=True)[1]
            _, ends = np.unique(np.concatenate([b[c].to_numpy(zero_copy_only=False) for c in ("u", "v")]), return_inverse=True)
            # in one group, the order of the keys is that of the nodes
            _, first, at = np.unique(np.tile(group, 2) * len(ends) + ends, return_index=True, return_inverse=True)
            a, z, low = at[:b.num_rows], at[b.num_rows:], np.arange(len(first))
            while (low[a] != low[z]).any():
                least, la, lz = np.minimum(low[a], low[z]), low[a], low[z]
                np.minimum.at(low, la, least)
                np.minimum.at(low, lz, least)
                while (low[low] != low).any():
                    low = low[low]
            whole = pa.concat_arrays([b["u"], b["v"]])
            yield pa.RecordBatch.from_arrays([*(b[c].take(pa.array(first % b.num_rows)) for c in by), whole.take(pa.array(first)), whole.take(pa.array(first[low]))],
                                             [*by, "node", "root"])

    kind = e.schema["u"].dataType
    return e.mapInArrow(stars, StructType([*(e.schema[c] for c in by), StructField("node", kind), StructField("root", kind)]))


def connected_components(edges: DataFrame, nodes: DataFrame, by=(), node: str = "node", src: str = "src", dst: str = "dst",
                         max_rounds: int = 60, near=()) -> DataFrame:
    """Smallest node of its component for every node.

    Edges are first put in the order of ``near``, columns made from the smaller end ``v`` that bring neighbours together (else ``v`` itself), and
    each batch of them is reduced to stars on its own. What is left is a graph of the roots of nodes that have more than one; where the order
    doesn't help, it is as large as the input.

    On it, alternating large-star and small-star steps: each links a node's neighbours to the smallest one. Minima are
    plain aggregates joined back, so no neighbour list is ever gathered. Every round is written to the shared
    folder and the table of the round before deleted; the loop ends when every linked node points at one node that itself has no link.
    """
    by = as_list(by)
    e = (edges.where(F.col(src) != F.col(dst))
         .select(*by, F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct())
    tables = Scratch(edges.sparkSession)
    e = tables.keep(e, "edges")
    order = [*by, *near, "v", "u"]
    stars = tables.keep(_batch_stars(e.repartitionByRange(*order).sortWithinPartitions(*order), by), "stars")
    roots = tables.keep(stars.groupBy(*by, "node").agg(F.min("root").alias("low"), F.max("root").alias("high")), "roots")
    several = stars.join(roots.where("low < high").select(*by, "node", "low"), [*by, "node"]).where("low < root")
    e = tables.keep(several.select(*by, F.col("root").alias("u"), F.col("low").alias("v")).distinct(), "edges")
    tables.drop("stars")

    def stars_only(d) -> bool:
        ends = (d.select(*by, F.col("u").alias("w"), F.lit(1).alias("out"), F.lit(0).alias("into"))
                .unionByName(d.select(*by, F.col("v").alias("w"), F.lit(0).alias("out"), F.lit(1).alias("into"))))
        per = ends.groupBy(*by, "w").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
        return per.where("out > 1 or (out = 1 and into = 1)").isEmpty()

    settled = stars_only(e)
    rounds = 0
    while not settled:
        if rounds == max_rounds:
            raise RuntimeError(f"components not settled after {max_rounds} rounds")
        rounds += 1
        both = e.select(*by, "u", "v").unionByName(e.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*by, "u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(low, [*by, "u"]).select(*by, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy(*by, "u").agg(F.min("v").alias("m"))
        small = (large.join(low2, [*by, "u"]).where("v <> m").select(*by, F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low2.select(*by, "u", F.col("m").alias("v"))).distinct())
        e = tables.keep(small, "edges")
        settled = stars_only(e)
    ends = (roots.select(*by, F.col("node").alias(node), F.col("low").alias("u")).join(e, [*by, "u"], "left")
            .select(*by, node, F.coalesce("v", "u").alias("component")))
    return nodes.select(*by, node).join(ends, [*by, node], "left").withColumn("component", F.coalesce("component", node))


def clump_of(r: float, x: str = "x", y: str = "y"):
    """Id of a cell so small that all points in it are within ``r`` of each other: one graph node per cell."""
    s = r * 0.7071  # just under 1/sqrt(2)
    return F.shiftleft(F.floor(F.col(x) / s), 32) + F.floor(F.col(y) / s) + F.lit(2 ** 31)


def clump_tile(clump: str) -> list:
    """Column and row of the tile of 64 x 64 clumps a clump lies in."""
    return [F.shiftright(clump, 38), F.shiftright(F.col(clump).bitwiseAND(F.lit(2 ** 32 - 1)), 6)]


def axis_sites(nodes: DataFrame, r: float, by, is_lig: str = "is_lig", id: str = "entity_id") -> DataFrame:
    lig = F.col(is_lig)
    return weighted_sites(nodes, by, id, n_lig=lig, n_rec=~lig).withColumn("clump", clump_of(r))


def clump_edges(pairs: DataFrame, by) -> DataFrame:
    """Edge and mixed-edge counts between (and within) clumps, from weighted site pairs."""
    return pairs.groupBy(*as_list(by), "a_clump", "b_clump").agg(
        F.sum((F.col("a_n_lig") + F.col("a_n_rec")) * (F.col("b_n_lig") + F.col("b_n_rec"))).alias("n_edges"),
        F.sum(F.col("a_n_lig") * F.col("b_n_rec") + F.col("a_n_rec") * F.col("b_n_lig")).alias("n_mixed"))


def clump_labels(sites: DataFrame, edges: DataFrame, by) -> DataFrame:
    """Clumps with their component and node counts."""
    by = as_list(by)
    clumps = sites.groupBy(*by, "clump").agg(F.sum("n_lig").alias("n_lig"), F.sum("n_rec").alias("n_rec"))
    comp = connected_components(edges, clumps, by, "clump", "a_clump", "b_clump", near=clump_tile("v"))
    return clumps.join(comp, [*by, "clump"])


def topology(sites: DataFrame, pairs: DataFrame, by) -> DataFrame:
    """Nodes, edges, mixed edges, components and mixed components per group."""
    by = as_list(by)
    edges = durable(clump_edges(pairs, by))
    n = F.col("n_lig") + F.col("n_rec")
    inner = sites.groupBy(*by).agg(
        F.sum(n).alias("n_nodes"), F.sum((n * (n - 1) / 2).cast("bigint")).alias("_e"), F.sum(F.col("n_lig") * F.col("n_rec")).alias("_m"))
    outer = edges.groupBy(*by).agg(F.sum("n_edges").alias("_eo"), F.sum("n_mixed").alias("_mo"))
    comp = clump_labels(sites, edges, by).groupBy(*by, "component").agg(
        F.sum(n).alias("size"), (F.sum("n_lig") > 0).alias("_l"), (F.sum("n_rec") > 0).alias("_r"))
    mixed = F.col("_l") & F.col("_r")
    per = comp.groupBy(*by).agg(
        n_rows().alias("n_comp"), F.count_if(mixed).alias("n_mixed_comp"),
        (F.coalesce(F.sum(F.when(mixed, F.col("size"))), F.lit(0)) / F.sum("size")).alias("frac_in_mixed"),
        F.coalesce(F.max(F.when(mixed, F.col("size"))), F.lit(0)).alias("largest_mixed"), F.max("size").alias("largest_comp"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return inner.join(outer, by, "left").join(per, by).select(
        *by, "n_nodes", (F.col("_e") + zero("_eo")).alias("n_edges"), (F.col("_m") + zero("_mo")).alias("n_mixed_edges"),
        "n_comp", "n_mixed_comp", "frac_in_mixed", "largest_mixed", "largest_comp")


def axis_nodes(ent: DataFrame, axis) -> DataFrame:
    """Ligand-positive and receptor-positive entities of an axis, with ``is_lig``."""
    lg, lc, rg, rc = axis
    lig = (F.col(lg) > 0) & F.col("cell_type").isin(as_list(lc))
    rec = (F.col(rg) > 0) & F.col("cell_type").isin(as_list(rc))
    return ent.where(lig | rec).withColumn("is_lig", lig)


def graph_topology(nodes: DataFrame, r: float, by, floor: int = 5, id: str = "entity_id") -> DataFrame:
    """Topology of the radius graph per group; a group with fewer than ``floor`` nodes on a side keeps a
    'too_sparse' row and takes no further part."""
    by = as_list(by)
    sites = durable(axis_sites(nodes, r, by, id=id))
    size = sites.groupBy(*by).agg(F.sum("n_lig").alias("n_lig"), F.sum("n_rec").alias("n_rec"))
    size = size.withColumn("status", F.when((F.col("n_lig") < floor) | (F.col("n_rec") < floor), "too_sparse").otherwise("ok"))
    sites = sites.join(size.where("status = 'ok'").select(*by), by, "left_semi")
    return size.join(topology(sites, self_pairs(sites, r, by), by), by, "left")


def contribution_split(ent: DataFrame, axis, r: float, by, id: str = "entity_id") -> DataFrame:
    """Of the mixed edges, how many touch a partial entity; node counts by whole and partial."""
    by = as_list(by)
    nodes = axis_nodes(ent, axis)
    lig, part = F.col("is_lig"), F.col("etype") == "partial"
    sites = weighted_sites(nodes, by, id, lw=lig & ~part, lp=lig & part, rw=~lig & ~part, rp=~lig & part)
    p = self_pairs(sites, r, by)
    s = lambda d, *c: sum((F.col(f"{d}_{x}") for x in c[1:]), F.col(f"{d}_{c[0]}"))
    all_ = s("a", "lw", "lp") * s("b", "rw", "rp") + s("a", "rw", "rp") * s("b", "lw", "lp")
    whole = F.col("a_lw") * F.col("b_rw") + F.col("a_rw") * F.col("b_lw")
    across = p.groupBy(*by).agg(F.sum(all_).alias("_m"), F.sum(all_ - whole).alias("_p"))
    own = sites.groupBy(*by).agg(
        F.sum("lw").alias("lig_whole"), F.sum("lp").alias("lig_partial"), F.sum("rw").alias("rec_whole"), F.sum("rp").alias("rec_partial"),
        F.sum((F.col("lw") + F.col("lp")) * (F.col("rw") + F.col("rp"))).alias("_om"),
        F.sum((F.col("lw") + F.col("lp")) * (F.col("rw") + F.col("rp")) - F.col("lw") * F.col("rw")).alias("_op"))
    j = own.join(across, by, "left")
    return j.select(*by, "lig_whole", "lig_partial", "rec_whole", "rec_partial",
                    (F.col("_om") + F.coalesce("_m", F.lit(0))).alias("n_mixed_edges"),
                    (F.col("_op") + F.coalesce("_p", F.lit(0))).alias("mixed_edges_with_partial")).withColumn(
        "frac_mixed_needing_partial", F.when(F.col("n_mixed_edges") > 0, F.col("mixed_edges_with_partial") / F.col("n_mixed_edges")))


def largest_domain(nodes: DataFrame, r: float, by, id: str = "entity_id") -> DataFrame:
    """Centre and size of the largest mixed component per group (ties: lowest component id)."""
    by = as_list(by)
    sites = durable(axis_sites(nodes, r, by, id=id))
    edges = durable(clump_edges(self_pairs(sites, r, by), by))
    comp = clump_labels(sites, edges, by).select(*by, "clump", "component")
    g = (sites.join(comp, [*by, "clump"]).groupBy(*by, "component")
         .agg(F.sum("n").alias("size"), F.sum("n_lig").alias("n_lig"), F.sum("n_rec").alias("n_rec"),
              (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("cx"), (F.sum(F.col("y") * F.col("n")) / F.sum("n")).alias("cy"),
              F.min("id").alias("first_id"))
         .where("n_lig > 0 and n_rec > 0"))
    return top_n_per_group(g, by, [F.desc("size"), "first_id"], 1).drop("component")
