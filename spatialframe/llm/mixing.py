"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length. Each source takes all its documents as many whole times as its target allows; what is left
of the budget is met by one more copy of some documents: beyond ``KNAPSACK`` words a share of every length first, then single documents from the longest
down, and bounded-knapsack dynamic programming on what remains, which comes as near as any choice can. The documents of a length are picked in the order of a
seeded hash of id and text, whatever their number.

Null, empty and blank texts have size 0 and are never taken. A null source is a source of its own and comes last. Rows that repeat
a doc_id are counted and picked row by row. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from spatialframe.functions.durable import Scratch

from .words import WORD, packed, seeded, unpacked

CAP = 3                 # copies of a document, and multiple of a source, at most
KNAPSACK = 1 << 16      # words that the dynamic programme fits exactly
WHOLE_GROUP = 4096      # rows of one source and length that are ranked in one window; more are cut into hash buckets


def words_in(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights=(5, 2, 1), cap: int = CAP) -> DataFrame:
    """(source, words) to (source, words, target). Weights repeat over the sources in code point order, null last. Sources are
    ordered by words per weight; those whose cap lies below their share of what is left are capped, and the rest share what the
    capped ones leave. One row per source, so the windows hold one row per source too."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    lcm = math.lcm(*weights)
    big = lambda c: c.cast("decimal(38,0)")
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    t = totals.withColumn("__w", w).withColumn("__ratio", F.col("words") * (F.lit(lcm) / F.col("__w")).cast("long"))
    order = W.orderBy("__ratio", F.col("source").asc_nulls_last())
    t = t.withColumns({"__all": F.sum("words").over(W.partitionBy()), "__before": F.sum("words").over(order.rowsBetween(W.unboundedPreceding, -1)),
                       "__rest": F.sum("__w").over(order.rowsBetween(0, W.unboundedFollowing))})
    left = big(F.col("__all")) - cap * big(F.coalesce("__before", F.lit(0)))
    t = t.withColumn("__full", cap * big(F.col("words")) * F.col("__rest") <= left * F.col("__w"))
    t = t.withColumns({"__s": F.sum(F.when(F.col("__full"), F.col("words")).otherwise(0)).over(W.partitionBy()),
                       "__v": F.sum(F.when(F.col("__full"), 0).otherwise(F.col("__w"))).over(W.partitionBy())})
    shared = ((F.col("__all") - cap * F.col("__s")) * F.col("__w")).cast("double") / F.col("__v")
    return t.select("source", "words", F.when(F.col("__full"), (cap * F.col("words")).cast("double")).otherwise(shared).alias("target"))


def fit_counts(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length (ascending) to take so that their words come as near to ``budget`` as the steps find."""
    sizes, counts = sizes.astype(object), counts.astype(object)
    total = sum(sizes * counts)
    if budget <= 0 or total <= 0:
        return np.zeros(len(sizes), np.int64)
    if budget >= total:
        return counts.astype(np.int64)
    take = np.array([int(c) * budget // total if budget > KNAPSACK else 0 for c in counts], object)
    left = int(budget - sum(take * sizes))
    for i in range(len(sizes) - 1, -1, -1):
        if left <= KNAPSACK:
            break
        k = min(counts[i] - take[i], (left - KNAPSACK // 2) // sizes[i]) if sizes[i] else 0
        if k > 0:
            take[i] += k
            left -= int(k * sizes[i])
    spare = [i for i in range(len(sizes)) if sizes[i] and take[i] < counts[i]]
    if 0 < left <= KNAPSACK and spare:
        most = left + int(sizes[spare[0]])                     # the nearest sum above lies within the shortest document
        mask, reach, steps = (1 << (most + 1)) - 1, 1, []
        for i in spare:
            room, k = min(counts[i] - take[i], most // sizes[i]), 1
            while room > 0 and not reach >> left & 1:
                k = min(k, room)
                steps.append((i, k, reach))
                reach |= reach << int(k * sizes[i]) & mask
                room -= k
                k *= 2
        at, over = (reach & (1 << (left + 1)) - 1).bit_length() - 1, reach >> (left + 1)
        if over and (over & -over).bit_length() < left - at:
            at = left + (over & -over).bit_length()
        for i, k, before in reversed(steps):
            if not before >> at & 1:
                take[i] += k
                at -= int(k * sizes[i])
    return take.astype(np.int64)


def mix_sources(docs: DataFrame, weights=(5, 2, 1), cap: int = CAP, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row (doc_id, size, source_size, target, taken) per document; ``taken`` is its size times its copies in the mix."""
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words_in(text_col).alias("size"), F.xxhash64(text_col).alias("key"))
    scratch = Scratch(docs.sparkSession)
    return _mix(scratch.keep(sized, "sizes"), weights, cap, seed).select("doc_id", "size", "source_size", "target", "taken")     # texts are read once


def _mix(sized: DataFrame, weights, cap: int, seed: str) -> DataFrame:
    hist = sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    targets = source_targets(hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words")), weights, cap)
    base = F.when(F.col("words") > 0, F.least(F.floor(F.col("target") / F.col("words")), F.lit(cap))).otherwise(0).cast("long")
    rows = (hist.withColumnRenamed("source", "__s").join(targets, F.col("__s").eqNullSafe(F.col("source"))).drop("__s")
            .withColumn("base", base))

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size").reset_index(drop=True)
        words, target, times = int(pdf["words"][0]), float(pdf["target"][0]), int(pdf["base"][0])
        budget = 0 if times >= cap else round(target - times * words)
        pdf["more"] = fit_counts(pdf["size"].to_numpy(), pdf["n"].to_numpy(), budget)
        return pdf

    # a group has one row per length of its source, not per document
    plans = rows.groupBy("source").applyInPandas(plan, "size long, n long, source string, words long, target double, base long, more long").withColumnRenamed("source", "__s").withColumnRenamed("size", "__z")
    met = sized.withColumn("__own", F.col("source")).join(plans.drop("source"), F.col("source").eqNullSafe(F.col("__s")) & (F.col("size") == F.col("__z")))
    met = met.withColumn("__h", seeded(seed, F.col("doc_id"), F.col("key"))).withColumn("__top", F.shiftrightunsigned("__h", 52)).withColumn("__b", F.when(F.col("n") > WHOLE_GROUP, F.col("__top")).otherwise(0))
    part = [F.col("source"), F.col("size"), F.col("__b")]
    cut = met.where("more > 0 and more < n")
    # rows before each hash bucket of a large group; small groups have one bucket
    filled = cut.where(F.col("n") > WHOLE_GROUP).groupBy(*part).agg(F.count(F.lit(1)).alias("__c"))
    before = F.coalesce(F.sum("__c").over(W.partitionBy("source", "size").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    filled = filled.select(F.col("source").alias("__fs"), F.col("size").alias("__fz"), F.col("__b").alias("__fb"), before.alias("__o"))
    placed = (cut.join(filled, F.col("source").eqNullSafe(F.col("__fs")) & (F.col("size") == F.col("__fz")) & (F.col("__b") == F.col("__fb")), "left")
              .withColumn("__r", F.row_number().over(W.partitionBy(*part).orderBy("__top", "__h", "doc_id", "key")) + F.coalesce("__o", F.lit(0)))
              .withColumn("copies", F.col("base") + (F.col("__r") <= F.col("more")).cast("long")))
    whole = met.where("more = 0 or more >= n").withColumn("copies", F.col("base") + (F.col("more") > 0).cast("long"))
    cols = ["doc_id", F.col("__own").alias("source"), "key", "size", F.col("words").alias("source_size"), "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"]
    return whole.select(*cols).unionByName(placed.select(*cols))


def take_mix(docs: DataFrame, weights=(5, 2, 1), cap: int = CAP, seed: str = "mix") -> DataFrame:
    """The mix itself: every document as many times as it is taken, with its columns and ``copy`` (1, 2, ...; a column of that name is
    replaced). Rows equal in doc_id, source and text are told apart by nothing and share the copies of all of them."""
    scratch = Scratch(docs.sparkSession)
    sized = scratch.keep(docs.select("doc_id", "source", words_in("text").alias("size"), F.xxhash64("text").alias("key")), "sizes")
    plan = _mix(sized, weights, cap, seed).where("taken > 0").groupBy("doc_id", "source", "key").agg(F.max("copies").alias("__n"))
    plan = scratch.keep(plan.select(F.col("doc_id").alias("i"), F.col("source").alias("s"), F.col("key").alias("k"), F.col("__n").alias("n")), "plan")
    scratch.close("plan")
    rows = packed(docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "copy"]), doc=F.col("doc_id"), origin=F.col("source"), key=F.xxhash64("text"))
    met = rows.join(plan, F.col("doc").eqNullSafe(F.col("i")) & F.col("origin").eqNullSafe(F.col("s")) & (F.col("key") == F.col("k")))
    return unpacked(met.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))), F.col("copy"))
