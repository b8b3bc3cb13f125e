"""Target-distribution importance resampling: documents drawn in proportion to how much likelier their features are in a target corpus.

Words are runs of digits, a-z and characters beyond ASCII, after A-Z alone are lower-cased. The features of a text are its runs of one to three words,
joined by one space, repeats counted; a feature falls into the bucket of its crc32. The gain of a bucket is the floored thousandfold log ratio of
its share in the target to its share in the source, both smoothed by one. A document's weight is the sum of its gains, and a
seeded Gumbel draw on top makes the highest scores a sample without replacement in proportion to the weights.

The buckets of a batch are found in *length-bucketed CRC matrices*: its distinct features are grouped by their length in bytes into two-dimensional
arrays, the CRCs of a whole array are updated column by column, and the buckets are scattered back to all places of the features. Texts are cut into pieces
of ``PIECE`` bytes at word borders, the two words before a piece carried along, so memory does not grow with the longest text. A feature
longer than ``LONG`` bytes makes no array of its own and is summed by zlib, which gives the same value.

Null, empty and wordless texts have no features, weight 0, and are not drawn where ``min_words`` is positive. Repeated rows are documents of
their own. Ties of a score go to the smaller doc_id (null last), then to fewer features; equal rows are interchangeable. An empty target
or source leaves the smoothed shares; an empty table gives no row. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from spatialframe.functions.durable import Scratch

from .ranking import global_index
from .words import map_arrow

BUCKETS, GRAM = 10_000, 3
PIECE, GATHER, LONG, MATRIX = 1 << 20, 100_000, 4096, 1 << 22
#: Every byte of a word stays, A-Z become a-z, all other ASCII characters part words.
FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & np.uint32(1), np.uint32(0xEDB88320) ^ (table >> np.uint32(1)), table >> np.uint32(1))
    return table


CRC = _crc_table()


def crc_by_length(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of the byte strings at ``start`` of ``data``: those of one length form an array, read column by column."""
    out = np.zeros(len(start), np.uint32)
    order = np.argsort(length, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else ():
        n = int(length[group[0]])
        if n > LONG:
            out[group] = [zlib.crc32(data[s:s + n].tobytes()) for s in start[group]]
            continue
        rows = max(1, MATRIX // max(1, n))
        for at in range(0, len(group), rows):
            some = group[at:at + rows]
            matrix = data[np.arange(n)[:, None] + start[some]]              # column by column: place in the feature, feature
            crc = np.full(len(some), 0xFFFFFFFF, np.uint32)
            for column in matrix:
                crc = CRC[(crc ^ column) & np.uint32(255)] ^ (crc >> np.uint32(8))
            out[some] = ~crc
    return out


def pieces(text: bytes | None):
    """The words of a text, at most about ``PIECE`` bytes of it at once."""
    data = text or b""
    at = 0
    while at < len(data):
        stop = at + PIECE
        piece = data[at:stop].translate(FOLDED)
        if stop < len(data):
            cut = piece.rfind(b" ", 1)
            while cut < 0 and stop < len(data):             # one word longer than a piece
                more = data[stop:stop + PIECE].translate(FOLDED)
                end = more.find(b" ")
                piece, stop = piece + (more if end < 0 else more[:end]), stop + (len(more) if end < 0 else end)
                if end >= 0:
                    cut = len(piece)
            if 0 <= cut < len(piece):
                piece, stop = piece[:cut], at + cut
        words = piece.split()
        if words:
            yield words
        at = stop


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self) + 1
        return i


def _buckets_of(ids: np.ndarray, place: np.ndarray, words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the words with these ids (0: none) in a row: bucket of every feature that ends at a new word (``place`` words of its text before it; -1: a
    carried word), and the index of that word."""
    last = np.flatnonzero(place >= 0)
    ends, runs = [], []
    for k in range(GRAM):
        own = last[place[last] >= k]
        ends.append(own)
        runs.append(np.stack([ids[own - j] if j <= k else np.zeros(len(own), np.int64) for j in range(GRAM - 1, -1, -1)], axis=1))
    end, run = np.concatenate(ends), np.concatenate(runs)
    radix = len(words) + 1
    code = (run[:, 0] * radix + run[:, 1]) * radix + run[:, 2]
    kinds, back = np.unique(code, return_inverse=True)
    parts = np.stack([kinds // (radix * radix), kinds // radix % radix, kinds % radix], axis=1)
    # the distinct features one after the other: word, space, word, space, word
    size = np.array([0] + [len(w) for w in words], np.int64)
    flat = np.frombuffer(b" ".join([b""] + words) + b" ", np.uint8)          # every word with the space before it
    first = np.concatenate([[0], np.cumsum(size[1:] + 1)[:-1]]) if len(words) else np.zeros(0, np.int64)
    first = np.concatenate([[0], first])
    used = parts.ravel()
    lengths = np.where(used > 0, size[used] + 1, 0)
    total = np.cumsum(lengths)
    here = np.arange(total[-1] if len(total) else 0) - np.repeat(total - lengths, lengths) + np.repeat(first[used], lengths)
    data = flat[here]
    whole = lengths.reshape(-1, GRAM).sum(axis=1)
    start = np.cumsum(whole) - whole
    return (crc_by_length(data, start + 1, whole - 1) % np.uint32(buckets)).astype(np.int64)[back], end


def features(texts, buckets: int = BUCKETS):
    """(text, bucket) of every feature of the texts as arrays, some ten thousand words at a time, and the number of words per text in the end."""
    ids, place, owner, known = [], [], [], _Ids()
    counts: list[int] = []

    def flush():
        b, end = _buckets_of(np.array(ids, np.int64), np.array(place, np.int64), list(known), buckets)
        return np.array(owner, np.int64)[end], b
    for i, text in enumerate(texts):
        before: list[bytes] = []
        n = 0
        for words in pieces(text):
            for a in range(0, len(words), GATHER):
                some = words[a:a + GATHER]
                ids.extend(map(known.__getitem__, before + some))
                place.extend([-1] * len(before) + list(range(n, n + len(some))))
                owner.extend([i] * (len(before) + len(some)))
                n += len(some)
                before = (before + some)[-(GRAM - 1):]
                if len(ids) >= GATHER:
                    yield flush()
                    ids, place, owner, known = [], [], [], _Ids()
        counts.append(n)
    if ids:
        yield flush()
    yield np.array(counts, np.int64), None


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts by bucket; a task counts its texts first and sends one row per bucket."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, found in features((t.as_py() for t in b.column(0)), buckets):
                if found is not None:
                    total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", "n"])
    rows = texts.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "bucket long, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln of the ratio of the shares) per bucket, from the two tables (bucket, n); ``buckets`` rows reach the driver."""
    both = source.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(
        target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"))).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).toPandas()
    s, t = np.zeros(buckets), np.zeros(buckets)
    at = both["bucket"].to_numpy(np.int64)
    s[at], t[at] = both["s"], both["t"]
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weigh(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) per document, in a map over whole texts."""
    def run(b):
        n, size, weight = b.num_rows, np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
        for owner, found in features((t.as_py() for t in b.column(1)), len(gains)):
            if found is None:
                words = owner
            else:
                size += np.bincount(owner, minlength=n)
                weight += np.bincount(owner, gains[found], minlength=n).astype(np.int64)       # sums of whole numbers below 2**53: exact
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words), pa.array(size), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary")), run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(1000 times a Gumbel draw): the same for a document wherever it stands."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): of the N documents with at least ``min_words`` words the floor(percent N / 100) highest scores are
    drawn and ranked from 1; the others have no rank. Texts are read twice: once to count features, once to weigh."""
    scratch = Scratch(docs.sparkSession)
    gains = bucket_gains(bucket_counts(docs, buckets=buckets), bucket_counts(target, buckets=buckets), buckets)
    scored = scratch.keep(weigh(docs, gains).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "scored")
    fit = F.col("n_words") >= min_words
    n = scored.agg(F.count(F.when(fit, 1)).alias("n")).first()["n"]
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "n_features"]
    ranked = global_index(scored.where(fit), order, scratch, "ranked")
    rank = F.when(F.col("index") < percent * n // 100, F.col("index") + 1)
    drawn = ranked.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
    scratch.close("scored", "ranked")
    return drawn.unionByName(scored.where(~fit).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))


#: The crc32 of a string in DuckDB: its bytes, read from the hexadecimal form, against a table made by the rule.
CRC_SQL = """crc_table as materialized (select list(c order by i) k from (select i, list_reduce([i] || range(8)::bigint[], lambda c, j: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end) c
    from (select unnest(range(256))::bigint i)))"""


def crc_sql(text: str) -> str:
    """DuckDB expression for the unsigned crc32 of ``text`` within a query that joins ``crc_table``."""
    byte = f"list_transform(range(1, strlen({text}) + 1), lambda i: ('0x' || substr(hex(encode({text})), (2 * i - 1)::bigint, 2))::bigint)"
    return f"xor(4294967295, list_reduce([4294967295::bigint] || {byte}, lambda c, b: xor(c >> 8, k[xor(c, b) % 256 + 1])))"


ORACLE_SQL = f"""with {CRC_SQL},
texts as (select row_number() over () rid, 0 side, doc_id, text from documents union all select -row_number() over (), 1, item_id, text from benchmark),
words as (select rid, side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from texts),
features as (select rid, side, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) f from words),
buckets as materialized (select f, {crc_sql('f')} % {BUCKETS} b from (select distinct f from features), crc_table),
counted as materialized (select rid, side, b, count(*) n from features join buckets using (f) group by all),
sides as (select b, sum(case when side = 0 then n else 0 end)::double s, sum(case when side = 1 then n else 0 end)::double t from counted group by b),
gains as (select b, floor(1000 * ln((t + 1) * ((select sum(s) from sides) + {BUCKETS}) / ((s + 1) * ((select sum(t) from sides) + {BUCKETS})))) g from sides),
weights as (select rid, sum(n)::bigint n_features, sum(n * g)::bigint weight from counted join gains using (b) where side = 0 group by rid),
scored as (select doc_id, len(w) >= 20 fit, coalesce(n_features, 0) n_features, coalesce(weight, 0) weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || coalesce(doc_id::varchar, ''))[1:8])::bigint + 0.5::double) / 4294967296.0::double)))::bigint score
    from words left join weights using (rid) where side = 0),
placed as (select *, row_number() over (partition by fit order by score desc, doc_id nulls last, n_features) r, count(*) over (partition by fit) n from scored)
select doc_id, n_features, weight, score, case when fit and r <= 5 * n // 100 then r end rank from placed"""
