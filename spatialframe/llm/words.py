"""Words, hashes of word windows and small table helpers that several operators share.

A word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

WORD = r"[^\x20\x09-\x0D]+"


def split_words(text: str | None) -> list[bytes]:
    """Words of a whole text as UTF-8; ``bytes.split`` cuts at exactly the six characters named above."""
    return text.encode("utf-8", "replace").split() if text else []


class WordHash(dict):
    """64-bit hash per word, remembered for frequent words; emptied at ``limit`` entries, so its memory is bounded."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base`` modulo 2**64, kept for the next text."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(1024, 2 * n), base, np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(steps)
    return have[:n]


def running(values: np.ndarray, base: int) -> np.ndarray:
    """Sums of values over powers of the odd ``base``: ``run_hash`` reads the hash of any run off two of them."""
    return np.concatenate([[np.uint64(0)], np.add.accumulate(values * powers(pow(base, -1, 1 << 64), len(values)))])


def run_hash(sums: np.ndarray, start, stop, base: int) -> np.ndarray:
    """Polynomial hash of the values from ``start`` up to ``stop``."""
    return mix((sums[stop] - sums[start]) * powers(base, len(sums))[start])


def window_hashes(h: np.ndarray, k: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of every run of ``k`` consecutive word hashes, at a cost that doesn't grow with ``k``."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    sums = running(h, base)
    return mix((sums[k:] - sums[:n]) * powers(base, n))


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return h.astype(np.uint64).view(np.int64)


def lists(values: np.ndarray, lengths, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from its flat values and the length of each list."""
    offsets = np.concatenate([[0], np.cumsum(np.asarray(lengths, np.int64))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


BATCH = 4 << 20                # bytes of an Arrow batch that holds whole texts


def small_batches(df: DataFrame) -> DataFrame:
    """From now on the session sends Python batches of at most ``BATCH`` bytes (one longer row is a batch of its own): 10,000 whole texts at once, Spark's
    usual bound, lie several times in the memory of an executor and once more in its worker. A bound that the user has set stays."""
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if key not in conf.getAll:
        conf.set(key, f"{BATCH}b")
    return df


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(batch) -> iterable of batches`` over Arrow batches; an object with ``__call__`` can hold state between them."""
    def run(batches):
        for b in batches:
            yield from fn(b)
        pa.default_memory_pool().release_unused()               # workers are reused: what a task freed goes back
    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, texts: pa.Array, limit: int = 1 << 20):
    """The batch in runs of rows whose texts have about ``limit`` bytes (one longer text is a run of its own). Nothing is copied, so what a
    function makes of a run at once does not grow with the batch."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    before = (np.cumsum(size) - size) // limit
    edges = [0, *(np.flatnonzero(before[1:] != before[:-1]) + 1).tolist(), len(size)]
    for a, z in zip(edges, edges[1:]):
        if z > a:
            yield batch.slice(a, z - a)


def map_texts(df: DataFrame, fn, schema: str, text: str = "text") -> DataFrame:
    """As ``map_arrow``, the batches cut by ``slices`` of the column ``text``."""
    def run(batches):
        for b in batches:
            for part in slices(b, b.column(b.schema.get_field_index(text))):
                yield from fn(part)
        pa.default_memory_pool().release_unused()
    return small_batches(df).mapInArrow(run, schema)


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text modulo ``folds``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def seeded(*parts) -> Column:
    """A 64-bit hash to draw by: the same for any partitioning or retry."""
    return F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def draw_labelled(labels: DataFrame, id_col: str, label_col: str, where: Column, n: int, seed: str) -> DataFrame:
    """Up to ``n`` labelled ids in seeded order, each with one label (the larger one if rows disagree). Null labels and
    ids are left out. ``n`` bounds the result, so it may be broadcast."""
    one = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & where)
           .groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).alias("__y")))
    return one.orderBy(seeded(seed, F.col("__id")), "__id").limit(n)


BLOOM_BITS = 1 << 24


def bloom_of(values: DataFrame, col: str) -> np.ndarray:
    """Bloom filter of a column of 64-bit hashes, two bits per value, as 64-bit words. It has the same 2 MB whatever the number of
    values: a full one lets more rows through to the exact join that follows, and changes no result."""
    at = lambda shift: F.shiftrightunsigned(F.col(col), shift).bitwiseAND(F.lit(BLOOM_BITS - 1))
    bits = values.select(F.explode(F.array(at(0), at(32))).alias("b"))
    words = bits.groupBy((F.col("b") / 64).cast("long").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("v"))
    pdf = words.toPandas()
    out = np.zeros(BLOOM_BITS // 64, np.uint64)
    out[pdf["w"].to_numpy(np.int64)] = pdf["v"].to_numpy(np.int64).view(np.uint64)
    return out


def in_bloom(bloom: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the 64-bit hashes may be in the filter."""
    def bit(x: np.ndarray, shift: int) -> np.ndarray:
        b = (x >> np.uint64(shift)) & np.uint64(BLOOM_BITS - 1)
        return (np.take(bloom, (b >> np.uint64(6)).astype(np.int64)) >> (b & np.uint64(63)) & np.uint64(1)).astype(bool)
    found = bit(h, 0)
    some = np.flatnonzero(found)
    found[some] = bit(h[some], 32)
    return found


def packed(docs: DataFrame, **keys: Column) -> DataFrame:
    """All columns as one struct ``row`` beside the keys, so that a join meets no column name of the documents; ``unpacked`` undoes it."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(k) for k, c in keys.items()])


def unpacked(rows: DataFrame, *more: Column) -> DataFrame:
    return rows.select("row.*", *more)


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` whose keys are not in ``gone`` (a written table of the keys; nulls are equal). A Bloom filter of fixed size, sent to all tasks as a table of one
    row, passes most others where they are read: only rows that it finds are shuffled to the join that decides."""
    bits = rows.sparkSession.createDataFrame([(signed(bloom_of(gone.select(F.xxhash64(*keys).alias("h")), "h")).tolist(),)], "__bits array<long>")

    def bit(shift: int) -> Column:
        at = F.shiftrightunsigned(F.xxhash64(*keys), shift).bitwiseAND(F.lit(BLOOM_BITS - 1))
        return F.getbit(F.get("__bits", F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1
    found = bit(0) & bit(32)
    drop = gone.select(*[F.col(k).alias(f"__{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return rows.join(F.broadcast(bits), found, "left_anti").unionAll(rows.join(F.broadcast(bits), found, "left_semi").join(drop, same, "left_anti"))
