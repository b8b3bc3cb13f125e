"""Near-duplicates of documents by ProbMinHash, banding and verification.

A text is the weighted set of its five-word shingles (a shorter one is a single shingle of all its words); a shingle that occurs n times weighs
1 + ln n. Two texts are linked when the probability Jaccard index of their weights is ``similarity`` or more: the sum over shared shingles i of 1 / sum
over all j of max(x_j / x_i, y_j / y_i). For sets without repetitions this is the plain Jaccard index, and it ignores the scale of the weights.

ProbMinHash estimates that index: every shingle is a Poisson process with its weight as rate, whose arrivals fall on random registers; a register
keeps the shingle that arrives first, and a text is done as soon as no further arrival can come before the last of its registers. Signatures are banded,
and texts that share a band are verified with the exact index. Classes are the connected components.

Equal texts are merged first. Within a bucket no full list of pairs is made: all are compared with the one that meets most others, and components are
formed. Only texts of buckets that still hold several components go on: of these, all pairs of different components that share
a rare enough shingle to be similar at all (prefix filtering, which is exact) are compared. So no link between texts that share a band is lost.

Texts without a word (null, empty, blank) have no shingles and stay alone. Rows without an id have no class and are kept. An id that has several texts
has a class for each of them, and rows that repeat an id and its text are one document. The smallest id of a class stands for it, ties going to the smaller MD5 of the text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spatialframe.functions.components import component_roots
from spatialframe.functions.durable import Scratch

from .ranking import global_index
from .words import WordHash, bloom_of, in_bloom, lists, map_arrow, map_texts, mix, packed, signed, split_words, unpacked, window_hashes, without

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5            # a pair at 0.8 is missed once in 14,000, whatever its repetitions
REGISTERS = BANDS * ROWS
SLACK = 1e-9                   # for sums of fractions that make exactly the similarity
GATHER = 100_000               # shingles sketched together


def shingles_of(h: np.ndarray) -> np.ndarray:
    """Shingle hashes of a text in order, from its word hashes."""
    return window_hashes(h, min(SHINGLE, len(h))) if len(h) else np.empty(0, np.uint64)


def weights_of(shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, sorted as longs, and their weights."""
    kinds, n = np.unique(signed(shingle), return_counts=True)
    return kinds, 1 + np.log(n)


def probability_jaccard(s: np.ndarray, x: np.ndarray, t: np.ndarray, y: np.ndarray) -> float:
    """Exact index of two weighted sets (sorted shingles, weights). In order of the ratios y / x, the sum of maxima of a shared shingle is what lies
    before it by x and what lies after it by y."""
    _, i, j = np.intersect1d(s, t, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    a, b = x[i], y[j]
    order = np.argsort(b / a, kind="stable")
    a, b = a[order], b[order]
    low = x.sum() - a.sum() + np.cumsum(a)                     # x alone (ratio 0) and the shared ones up to this ratio
    high = y.sum() - b.sum() + np.concatenate([np.cumsum(b[::-1])[::-1][1:], [0.0]])
    return float((1 / (low / a + high / b)).sum())


def prob_minhash(shingle: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Signatures (n x REGISTERS) of ``n`` texts from their shingles, repeats included, and the text each belongs to."""
    order = np.lexsort((shingle, owner))
    s, d = shingle[order], owner[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    first = np.flatnonzero(new)
    rate = 1 + np.log(np.diff(np.append(first, len(s))))
    s, d = s[first], d[first].astype(np.int64)
    time = np.zeros(len(s))
    arrival, kept = np.full(n * REGISTERS, np.inf), np.zeros(n * REGISTERS, np.uint64)
    turn = 0
    while len(s):
        turn += 1
        r = mix(s + np.uint64(turn * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log(((r >> np.uint64(11)).astype(np.float64) + 1) * 2.0 ** -53) / rate
        at = d * REGISTERS + (mix(r ^ np.uint64(0xA5A5A5A55A5A5A5A)) % np.uint64(REGISTERS)).astype(np.int64)
        before = arrival[at]
        early = time < before
        np.minimum.at(arrival, at[early], time[early])
        won = early & (time == arrival[at])
        kept[at[won]] = s[won]
        last = arrival.reshape(n, REGISTERS).max(axis=1)
        live = time < last[d]              # a later arrival can still win a register
        s, d, time, rate = s[live], d[live], time[live], rate[live]
    return kept.reshape(n, REGISTERS)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per text and band."""
    rows = signature.reshape(len(signature), BANDS, ROWS)
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signature), 1))
    for j in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, j])
    return key


def _sketches(docs: DataFrame) -> DataFrame:
    """(doc, copy, bands) of every whole text; a text without words has no bands."""
    words = WordHash()

    def run(b):
        bands, counts, held, owner, size = [], [], [], [], 0

        def flush():
            if owner:
                sig = prob_minhash(np.concatenate(held), np.repeat(np.arange(len(owner)), owner), len(owner))
                bands.append(signed(band_keys(sig)).ravel())
        for t in b.column(2).to_pylist():
            s = shingles_of(words.of(split_words(t)))
            counts.append(BANDS if len(s) else 0)
            if len(s):
                held.append(s)
                owner.append(len(s))
                size += len(s)
            if size >= GATHER:
                flush()
                held, owner, size = [], [], 0
        flush()
        flat = np.concatenate(bands) if bands else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists(flat, counts, pa.int64())], ["doc", "copy", "bands"])
    return map_texts(docs, run, "doc long, copy string, bands array<long>")


def _texts_of(base: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of ``nodes`` (node, copy, least). Only their own texts are shuffled: a Bloom filter of fixed size leaves out most others where they are
    read, and the join that follows leaves out the rest."""
    bloom = bloom_of(nodes.select(F.xxhash64("least", "copy").alias("h")), "h")

    @F.pandas_udf("boolean")
    def wanted(h: pd.Series) -> pd.Series:
        return pd.Series(in_bloom(bloom, h.to_numpy().view(np.uint64)))
    own = base.where(wanted(F.xxhash64("doc", "copy")))
    return own.join(nodes, (own["copy"] == nodes["copy"]) & (F.col("doc") == F.col("least"))).select("node", "text")


def _sets(texts: DataFrame) -> DataFrame:
    """(node, shingles, weights adding up to 1) of texts (node, text)."""
    words = WordHash()

    def run(b):
        out, mass = [np.empty(0, np.int64)], [np.empty(0)]
        for t in b.column(1).to_pylist():
            s, w = weights_of(shingles_of(words.of(split_words(t))))
            out.append(s)
            mass.append(w / w.sum())
        sizes = [len(x) for x in out[1:]]
        yield pa.RecordBatch.from_arrays([b.column(0), lists(np.concatenate(out), sizes, pa.int64()), lists(np.concatenate(mass), sizes, pa.float64())], ["node", "shingles", "weights"])
    return map_texts(texts.select("node", "text"), run, "node long, shingles array<long>, weights array<double>")


def _linked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose index reaches the similarity."""
    left, right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("s"), F.col("weights").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("t"), F.col("weights").alias("y"))

    def run(b):
        cells = [[v.values.to_numpy() for v in b.column(c)] for c in range(2, 6)]
        keep = pa.array([probability_jaccard(*c) >= similarity - SLACK for c in zip(*cells)], pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])
    return map_arrow(pairs.join(left, "a").join(right, "b").select("a", "b", "s", "x", "t", "y"), run, "a long, b long")


def _prefix_rows(known: DataFrame, similarity: float) -> DataFrame:
    """(node, root, s, rest, n_rest, heavy) of the shingles that a text of (node, root, known: (n, s, w) from the rarest on, alone: share of its weight that no
    other text has) must share one of: those with at least the similarity left from them on. ``rest`` is the weight that is left, ``n_rest`` the number of
    shingles that have it, ``heavy`` the largest weight among them."""
    def run(b):
        out = [[np.empty(0, kind)] for kind in (np.int64, np.int64, np.int64, np.float64, np.int64, np.float64)]
        for node, root, cells, alone in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist()):
            s, w = cells.values.field(1).to_numpy(), cells.values.field(2).to_numpy()
            rest = 1 - alone - np.cumsum(w) + w
            n = int((rest >= similarity - SLACK).sum())                  # they fall from one to the next
            heavy = np.maximum.accumulate(w[::-1])[::-1]
            for column, values in zip(out, (np.full(n, node), np.full(n, root), s[:n], rest[:n], len(s) - np.arange(n), heavy[:n])):
                column.append(values)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["node", "root", "s", "rest", "n_rest", "heavy"])
    return map_arrow(known.select("node", "root", "known", "alone"), run, "node long, root long, s long, rest double, n_rest long, heavy double")


def _share_prefix(texts: DataFrame, sets: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of different components that may still be similar. Let a and b be the shares of two texts' weights that lie in common shingles: their
    index is at most 1 / (1/a + 1/b - 1). So both must share at least the similarity, which gives the prefix of each text; and where a
    shingle is the first that two texts share, what they have left from it on must still suffice: they share no more shingles than the shorter rest has, of
    no more than the heaviest weight each. So a large group isn't compared pair by pair. In each shingle's group, texts of the component that is most frequent there are never paired with each other."""
    rows = sets.join(texts, "node").select("node", "root", F.explode(F.arrays_zip(F.col("shingles").alias("s"), F.col("weights").alias("w"))).alias("e")).select("node", "root", "e.s", "e.w")
    often = rows.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    ranked = rows.join(often.where("n > 1"), "s").groupBy("node", "root").agg(F.sort_array(F.collect_list(F.struct("n", "s", "w"))).alias("known"), F.sum("w").alias("shared"))
    # a shingle that no other text has comes first and can't be shared: it only uses up weight
    prefix = scratch.keep(_prefix_rows(ranked.withColumn("alone", 1 - F.col("shared")), similarity), "prefix")
    per = prefix.groupBy("s", "root").agg(F.count(F.lit(1)).alias("c"))
    top = per.groupBy("s").agg(F.max(F.struct("c", "root")).alias("t"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("s", F.col("t.root").alias("top"))
    here = prefix.join(top, "s")
    few = here.where("root <> top").select("s", F.col("node").alias("p"), F.col("root").alias("p_root"), F.col("rest").alias("p_rest"), F.col("n_rest").alias("p_n"), F.col("heavy").alias("p_heavy"))
    most = F.least("n_rest", "p_n")
    a, b = F.least(F.col("rest"), most * F.col("heavy")), F.least(F.col("p_rest"), most * F.col("p_heavy"))
    pairs = here.join(few, "s").where((F.col("root") != F.col("p_root")) & (1 / a + 1 / b - 1 <= 1 / similarity + SLACK))
    return pairs.select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")).distinct()


def near_duplicates(docs: DataFrame, scratch: Scratch, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_md5, class_id, kept) of every document with an id, one row per id and text; a table of ``scratch`` named ``classes``."""
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.md5(text_col).alias("copy"), F.col(text_col).alias("text")).where("doc is not null")
    sketch = scratch.keep(_sketches(base), "sketch")

    # one node per text: they are numbered by the smallest id that has the text
    texts = sketch.where("size(bands) > 0").groupBy("copy").agg(F.min("doc").alias("least"))
    nodes = scratch.keep(global_index(texts, ["least", "copy"], scratch, "texts", "node"), "nodes")
    rows = sketch.join(nodes, "copy").where("doc = least").select("node", F.explode("bands").alias("bucket"))
    full = rows.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("bucket")
    buckets = scratch.keep(rows.join(full, "bucket").distinct(), "buckets")
    meeting = scratch.keep(buckets.select("node").distinct().join(nodes, "node"), "meeting")
    sets = scratch.keep(_sets(_texts_of(base, meeting)).dropDuplicates(["node"]), "sets")
    scratch.drop("texts", "meeting")

    # every text of a bucket against the one that meets most others in all its buckets: of near copies, the least changed
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    meets = buckets.join(sizes, "bucket").groupBy("node").agg(F.sum("n").alias("meets"))
    pivot = buckets.join(meets, "node").groupBy("bucket").agg(F.max(F.struct("meets", "node")).alias("p")).select("bucket", F.col("p.node").alias("p"))
    pairs = buckets.join(pivot, "bucket").where("p <> node").select(F.least("p", "node").alias("a"), F.greatest("p", "node").alias("b")).distinct()
    links = scratch.keep(_linked(pairs, sets, similarity), "links")
    roots = component_roots(links, scratch)
    # texts of buckets that still hold several components
    reached = roots.withColumnRenamed("node", "of")
    now = buckets.join(reached, F.col("node") == F.col("of"), "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    mixed = now.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("bucket")
    left = scratch.keep(now.join(mixed, "bucket").groupBy("node").agg(F.min("root").alias("root")), "left")
    if not left.isEmpty():
        more = _linked(_share_prefix(left, sets, similarity, scratch), sets, similarity)
        stars = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = component_roots(more.unionByName(stars), scratch)
    scratch.drop("left", "links", "sets", "buckets", "prefix")
    # the class of a text is the smallest id of its root's text; texts without words have none but their own
    ends = nodes.select(F.col("node").alias("root"), F.col("least").alias("class_id"))
    placed = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(ends, "root")
    found = sketch.select("doc", "copy").distinct().join(placed, "copy", "left")
    kept = F.coalesce((F.col("node") == F.col("root")) & (F.col("doc") == F.col("least")), F.lit(True))
    classes = scratch.keep(found.select(F.col("doc").alias("doc_id"), F.col("copy").alias("text_md5"), F.coalesce("class_id", "doc").alias("class_id"), kept.alias("kept")), "classes")
    scratch.drop("roots", "nodes", "sketch")
    return classes


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, that with its smallest id, with all columns; rows without an id are kept."""
    scratch = Scratch(docs.sparkSession)
    gone = near_duplicates(docs, scratch, similarity).where("not kept").select(F.col("doc_id").alias("doc"), F.col("text_md5").alias("copy"))
    scratch.close("classes")
    rows = packed(docs, doc=F.col("doc_id").cast("long"), copy=F.md5("text"))
    return unpacked(without(rows, gone, ["doc", "copy"]))
