"""Substring dedup by repeated-phrase automata.

Each word covered by a window of ``WINDOW`` consecutive words whose sequence also starts in a document with a smaller id is removed.

Texts with equal words are one text: the row with the smallest id (then hash) stands for them, and the others, whose windows all start there,
lose all their words where an id is larger. Only one of them is counted, streamed and judged.

1. *Confirm.* Every window names an anchor: of its runs of ``ANCHOR`` words, the one with the smallest hash. Equal windows name equal
   anchors at equal places, so a recurring window has a recurring anchor, and anchors are a twentieth of all windows. Anchors are
   counted over all documents; those of two documents or more recur.
2. *Locate.* The recurring anchors, as sequences of word codes, are compiled into sharded Aho-Corasick automata. A shard holds the anchors
   that began in the same documents; each document is streamed through the shards of the anchors it shares, whatever its length. Which documents these are
   is decided by joins of anchors and ids, before any text is moved.
3. *Judge.* A located anchor with the windows that name it is a span. Of equal spans all but those of the smallest id are covered.
   Where different spans share an anchor, the windows of one document of each kind are compared one by one. Spans and windows are compared by
   64-bit hashes within an anchor, texts by the SHA-256 of their words.

Null texts have no words; texts shorter than a window lose nothing. A null doc_id counts as larger than any other. Repeated rows
of one document do not count against each other. Extra columns are left alone.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from spatialframe.functions.durable import Scratch

from .words import WordHash, lists, map_arrow, map_texts, packed, run_hash, running, signed, split_words, window_hashes

WINDOW, ANCHOR = 50, 16
NO_ID = (1 << 63) - 1
SHARD = 20_000                 # anchors of an automaton
SLICE = 1 << 23                # characters streamed through one automaton in one group
SPAN_BASE = 0xD6E8FEB86659FD93
#: Half of a word's hash, its letter in an automaton.
LETTER = np.uint64(0xFFFFFFFF)
#: Hashes of frequent words, shared by the groups of a task.
WORDS = WordHash()


def anchors_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the word hashes of a text: hash of the run at each place, place of the anchor of each window, and the first window of each
    span of windows with one anchor."""
    if len(h) < WINDOW:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    runs = window_hashes(h, ANCHOR)
    key = runs & ~LETTER | np.arange(len(runs), dtype=np.uint64)         # the leftmost of equal ones wins
    width, need = 1, WINDOW - ANCHOR + 1
    while 2 * width <= need:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < need:
        key = np.minimum(key[:len(key) - (need - width)], key[need - width:])
    place = (key & LETTER).astype(np.int64)
    return runs, place, np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))


def _marks(docs: DataFrame) -> DataFrame:
    """(doc, key, n_words, sha, anchors) of every text: the digest of its words and each of its anchors once. The only pass that splits all texts."""
    words = WordHash()

    def run(b):
        ns, shas, hits, counts = [], [], [np.empty(0, np.int64)], []
        for t in b.column(2).to_pylist():
            ws = split_words(t)
            if len(ws) >= WINDOW:
                runs, place, first = anchors_of(words.of(ws))
                hits.append(signed(np.unique(runs[place[first]])))
            counts.append(len(hits[-1]) if len(ws) >= WINDOW else 0)
            ns.append(len(ws))
            shas.append(hashlib.sha256(b" ".join(ws)).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ns, pa.int64()), pa.array(shas, pa.string()), lists(np.concatenate(hits), counts, pa.int64())],
                                         ["doc", "key", "n_words", "sha", "anchors"])
    return map_texts(docs.select("doc", "key", "text"), run, "doc long, key long, n_words long, sha string, anchors array<long>")


def _phrases(first: DataFrame) -> DataFrame:
    """Word codes of the anchors that begin in these documents."""
    words = WordHash()

    def run(b):
        for shard, own, t in zip(*(b.column(c).to_pylist() for c in range(3))):
            h = words.of(split_words(t))
            runs = window_hashes(h, ANCHOR)
            hit, place = np.unique(runs, return_index=True)
            place = place[np.isin(hit, np.array(own, np.int64).view(np.uint64))]
            letters = (h & LETTER)[place[:, None] + np.arange(ANCHOR)]
            yield pa.RecordBatch.from_arrays([pa.array([shard] * len(place), pa.int64()), pa.array(signed(runs[place])), lists(letters.ravel().astype(np.int64), [ANCHOR] * len(place), pa.int64())],
                                             ["shard", "anchor", "letters"])
    return map_arrow(first.select("shard", "own", "text"), run, "shard long, anchor long, letters array<long>")


def _locate(docs: pa.Table, phrases: pa.Table) -> pa.Table:
    """Stream the texts of a slice through the automaton of its shard: one row per span, with the hashes of its windows."""
    known = phrases["anchor"].to_numpy()
    letters = phrases["letters"].combine_chunks().flatten().to_numpy().reshape(-1, ANCHOR)
    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for i, word in enumerate(letters.tolist()):
        machine.add_word(tuple(word), i)
    if len(known):
        machine.make_automaton()
    words, none = WORDS, np.empty(0, np.int64)
    out = {"anchor": [none], "span": [none], "doc": [none], "key": [none], "start": [none], "windows": [none]}
    lengths = [none]
    for doc, key, text in zip(docs["doc"].to_pylist(), docs["key"].to_pylist(), docs["text"].to_pylist()) if len(known) else ():
        h = words.of(split_words(text))
        found = np.array(list(machine.iter(tuple((h & LETTER).tolist()))), np.int64).reshape(-1, 2)
        found[:, 0] -= ANCHOR - 1
        runs, place, first = anchors_of(h)
        runs = signed(runs)
        found = found[runs[found[:, 0]] == known[found[:, 1]]]               # the whole hash decides
        here = np.zeros(len(runs), bool)
        here[found[:, 0]] = True
        spans = here[place[first]]
        a, z = first[spans], np.append(first[1:], len(place))[spans]
        if not len(a):
            continue
        full = window_hashes(h, WINDOW)
        out["anchor"].append(runs[place[a]])
        out["span"].append(signed(run_hash(running(full, SPAN_BASE), a, z, SPAN_BASE) + (z - a).astype(np.uint64)))
        out["doc"].append(np.full(len(a), doc, np.int64))
        out["key"].append(np.full(len(a), key, np.int64))
        out["start"].append(a)
        inside = np.zeros(len(full) + 1, np.int64)
        inside[a] += 1
        inside[z] -= 1
        out["windows"].append(signed(full[np.cumsum(inside[:-1]) > 0]))
        lengths.append(z - a)
    flat, length = {c: np.concatenate(v) for c, v in out.items()}, np.concatenate(lengths)
    # of equal spans in this slice, those of a larger id are covered already: they leave as merged runs, one row per document
    order = np.lexsort((flat["doc"], flat["span"], flat["anchor"]))
    new = np.ones(len(order), bool)
    new[1:] = (flat["anchor"][order][1:] != flat["anchor"][order][:-1]) | (flat["span"][order][1:] != flat["span"][order][:-1])
    least = np.empty(len(order), np.int64)
    least[order] = flat["doc"][order][new][np.cumsum(new) - 1] if len(order) else none
    open_ = flat["doc"] == least
    gone = np.flatnonzero(~open_)
    gone = gone[np.lexsort((flat["start"][gone], flat["key"][gone], flat["doc"][gone]))]
    docs_, keys_, starts, stops = [], [], [], []
    for d, k, x, y in zip(flat["doc"][gone].tolist(), flat["key"][gone].tolist(), flat["start"][gone].tolist(), (flat["start"] + length + WINDOW - 1)[gone].tolist()):
        if not docs_ or (docs_[-1], keys_[-1]) != (d, k):
            docs_.append(d), keys_.append(k), starts.append([x]), stops.append([y])
        elif x <= stops[-1][-1]:
            stops[-1][-1] = max(stops[-1][-1], y)
        else:
            starts[-1].append(x), stops[-1].append(y)
    n, kind = len(docs_), pa.list_(pa.int64())
    rows = [pa.array(np.concatenate([flat[c][open_], np.zeros(n, np.int64)]), pa.int64(), mask=np.repeat([False, True], [int(open_.sum()), n]))
            for c in ("anchor", "span")]
    rows += [pa.array(np.concatenate([flat["doc"][open_], np.array(docs_, np.int64)])), pa.array(np.concatenate([flat["key"][open_], np.array(keys_, np.int64)]))]
    rows.append(pa.array(np.concatenate([flat["start"][open_], np.zeros(n, np.int64)])))
    windows = lists(flat["windows"][np.repeat(open_, length)], length[open_], pa.int64())
    rows.append(pa.chunked_array([windows, pa.array([None] * n, kind)]).combine_chunks())
    rows += [pa.chunked_array([pa.array([None] * len(windows), kind), pa.array(x, kind)]).combine_chunks() for x in (starts, stops)]
    return pa.table(rows, names=["anchor", "span", "doc", "key", "start", "windows", "starts", "stops"])


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, key, text): the id (the largest for null) and a hash of the text name a row; rows equal in both are cut alike."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))


def find_repeats(base: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of ``keyed`` documents: (doc, key, n_words, sha, r_doc, r_key, copy) of every row, with the row that stands for its words and whether that
    has a smaller id; the texts (doc, key, text) of those that share an anchor; and the runs of words to remove (doc, key, runs of (start, stop))."""
    marks = scratch.keep(_marks(base), "marks")
    same = marks.where(F.col("n_words") >= WINDOW).groupBy("sha").agg(F.min(F.struct("doc", "key")).alias("r"), F.count(F.lit(1)).alias("n")).where("n > 1")
    same = scratch.keep(same.select("sha", F.col("r.doc").alias("r_doc"), F.col("r.key").alias("r_key")), "same")
    rows = marks.join(same, "sha", "left").withColumn("copy", F.coalesce(F.col("doc") > F.col("r_doc"), F.lit(False)))
    rows = rows.withColumns({"r_doc": F.coalesce("r_doc", "doc"), "r_key": F.coalesce("r_key", "key")})
    heads = rows.where("doc = r_doc and key = r_key").select("doc", "key", "anchors")
    counted = heads.select("doc", F.explode("anchors").alias("anchor")).groupBy("anchor").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    recurring = scratch.keep(counted.select("anchor", "first"), "recurring")

    # a shard holds the anchors whose first document falls to it; a text goes to the shards of the anchors it has
    shards = max(1, -(-recurring.count() // SHARD))
    shard = lambda doc: F.pmod(F.xxhash64(doc), F.lit(shards))
    routes = (heads.select("doc", "key", F.explode("anchors").alias("anchor")).join(recurring, "anchor").groupBy("doc", "key")
              .agg(F.collect_set(shard(F.col("first"))).alias("shards"), F.collect_set(F.when(F.col("first") == F.col("doc"), F.col("anchor"))).alias("own")))
    routes = scratch.keep(routes, "routes")
    found = base.join(routes, ["doc", "key"])
    routed = scratch.keep(found.groupBy("doc", "key").agg(*[F.first(c).alias(c) for c in ("text", "shards", "own")]), "routed")
    phrases = _phrases(routed.where("size(own) > 0").withColumn("shard", shard(F.col("doc")))).dropDuplicates(["anchor"])
    streams = routed.select("doc", "key", "text", F.explode("shards").alias("shard"))
    slices = scratch.keep(streams.groupBy("shard").agg(F.ceil(F.sum(F.length("text")) / SLICE).cast("long").alias("slices")), "slices")
    streams = streams.join(slices, "shard").withColumn("slice", F.pmod(F.xxhash64("doc", "key"), F.col("slices"))).drop("slices")
    phrases = phrases.join(slices, "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"), "anchor", "letters")
    spans = streams.groupBy("shard", "slice").cogroup(phrases.groupBy("shard", "slice")).applyInArrow(
        _locate, "anchor long, span long, doc long, key long, start long, windows array<long>, starts array<long>, stops array<long>")
    spans = scratch.keep(spans, "spans")
    scratch.drop("recurring", "routes", "slices")

    run = lambda start, stop: F.struct(start.cast("long").alias("start"), stop.cast("long").alias("stop"))
    covered = spans.where("anchor is null").select("doc", "key", F.zip_with("starts", "stops", run).alias("runs"))
    covered = scratch.keep(covered, "covered")
    opened = spans.where("anchor is not null").select("anchor", "span", "doc", "key", "start", "windows")
    kinds = opened.groupBy("anchor", "span").agg(F.min("doc").alias("least"))
    several = kinds.groupBy("anchor").agg((F.count(F.lit(1)) > 1).alias("several"))
    placed = opened.join(kinds.join(several, "anchor"), ["anchor", "span"])
    whole = run(F.col("start"), F.col("start") + F.size("windows") + WINDOW - 1)
    placed = scratch.keep(placed.where("doc > least or several").select("doc", "key", "anchor", "start", F.when(F.col("doc") > F.col("least"), F.array(whole)).alias("runs"),
                                                                      F.when(F.col("doc") == F.col("least"), F.col("windows")).alias("windows")), "placed")
    scratch.drop("spans")
    single = placed.where("windows is not null").select("doc", "key", "anchor", "start", F.posexplode("windows").alias("at", "window"))
    least = single.groupBy("anchor", "window").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most")
    start = F.col("start") + F.col("at")
    again = single.join(least, ["anchor", "window"]).where("doc > least").select("doc", "key", F.array(run(start, start + WINDOW)).alias("runs"))
    every = placed.where("runs is not null").select("doc", "key", "runs").unionByName(again).unionByName(covered)
    runs = every.groupBy("doc", "key").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    runs = scratch.keep(runs, "runs")
    scratch.drop("placed", "covered")
    return rows.drop("anchors"), routed.select("doc", "key", "text"), runs


def _kept(words: list[bytes], runs) -> list[bytes]:
    edge = np.zeros(len(words) + 1, np.int64)
    for r in runs:
        edge[r["start"]] += 1
        edge[r["stop"]] -= 1
    return [w for w, gone in zip(words, np.cumsum(edge[:-1]) > 0) if not gone]


def remove_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) per document."""
    scratch = Scratch(docs.sparkSession)
    rows, texts, runs = find_repeats(keyed(docs), scratch)

    def run(b):
        ns, shas = [], []
        for t, r in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            words = split_words(t)
            kept = _kept(words, r)
            ns.append(len(words) - len(kept))
            shas.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ns, pa.int64()), pa.array(shas, pa.string())], ["r_doc", "r_key", "cut", "cut_sha"])
    cut = map_texts(texts.join(runs, ["doc", "key"]).select("doc", "key", "text", "runs"), run, "r_doc long, r_key long, cut long, cut_sha string")
    cut = scratch.keep(cut, "cut")
    scratch.close("marks", "same", "cut")
    removed, sha = F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("cut", F.lit(0).cast("long"))), F.when(F.col("copy"), hashlib.sha256(b"").hexdigest()).otherwise(F.coalesce("cut_sha", "sha"))
    return rows.join(cut, ["r_doc", "r_key"], "left").select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "n_words", removed.alias("n_removed"), sha.alias("kept_sha256"))


@F.pandas_udf(StringType())
def _cut_text(text: pd.Series, runs: pd.Series) -> pd.Series:
    return pd.Series([t if r is None else b" ".join(_kept(split_words(t), r)).decode("utf-8") for t, r in zip(text, runs)], dtype=object)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents without their repeated passages, columns unchanged (``n_chars`` follows the text). Cut texts have their words joined
    by one space; a document that loses all its words goes."""
    scratch = Scratch(docs.sparkSession)
    found, _, runs = find_repeats(keyed(docs), scratch)
    runs = runs.select(F.col("doc").alias("r_doc"), F.col("key").alias("r_key"), "runs")
    fates = found.join(runs, ["r_doc", "r_key"], "left").where("copy or runs is not null").select("doc", "key", "copy", "runs").dropDuplicates(["doc", "key"])
    fates = scratch.keep(fates, "fates")
    scratch.close("fates")
    rows = packed(docs, doc=F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), key=F.xxhash64("text"))
    rows = rows.join(fates, ["doc", "key"], "left").where("not coalesce(copy, false)").withColumn("cut", _cut_text(F.col("row.text"), F.col("runs"))).where("runs is null or cut <> ''")
    new = {"text": F.col("cut")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("runs").isNull(), F.col("row.n_chars")).otherwise(F.length("cut")).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


ORACLE_SQL = f"""with d as (select doc_id, coalesce(doc_id, {NO_ID}) id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w, row_number() over () rid from documents),
win as (select rid, id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') s from (select rid, id, w, unnest(range(1, len(w) - {WINDOW - 2})) i from d where len(w) >= {WINDOW})),
dup as (select a.rid, a.i from win a join (select s, min(id) f from win group by s having min(id) < max(id)) b on a.s = b.s where a.id > b.f),
gone as (select distinct rid, unnest(range(i, i + {WINDOW})) p from dup),
words as (select rid, unnest(w) x, unnest(range(1, len(w) + 1)) p from d),
kept as (select k.rid, string_agg(k.x, ' ' order by k.p) t, count(*) n from words k anti join gone g on k.rid = g.rid and k.p = g.p group by k.rid)
select d.doc_id, len(d.w)::bigint n_words, (len(d.w) - coalesce(k.n, 0))::bigint n_removed, sha256(coalesce(k.t, '')) kept_sha256 from d left join kept k on d.rid = k.rid"""
