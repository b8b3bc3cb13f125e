"""Benchmark decontamination by template canonicalisation.

Words lose outer punctuation and case; numbers, names and units become typed placeholders, so that a question with other values has
the same template. Windows of template tokens are joined by hash with those of the benchmark; matches on one diagonal (place in the
text less place in the item) must fill the slots consistently: equal item values have equal text values and different ones differ.
A document is contaminated by an item when consistent matches on one diagonal cover ``cover`` of its tokens, or all of a shorter one. Windows with the item's own values that cover as much need no
consistency: a conflict elsewhere on their diagonal is an edited copy.

Each window has a second form, its own words without case, so a copy with the item's values is found in capitals or lower case too.

A name is a capitalised word inside a sentence. Words without letter or digit are skipped. A one-letter word is a unit only
after a number. The first word of an item matches as a literal or as a name. A window with fewer than ``LITERALS`` tokens that are no
placeholder matches by its own values only; by template, then, coverage is wanted of the tokens in the other windows. An item of any
length counts, so one of a single word contaminates every text with that word. Null and empty texts hold no windows; repeated rows give repeated evidence for one
document only; a null doc_id is carried as null. Either table may be empty.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from spatialframe.functions.durable import durable

from .words import bloom_of, in_bloom, lists, map_arrow, map_texts, mix, packed, signed, split_words, unpacked, window_hashes, without

WINDOW, LITERALS, COVER = 8, 4, 13
#: Units that a value may carry.
UNITS = frozenset("""kg g mg lb lbs oz ton tons tonne tonnes km m cm mm mile miles foot feet ft inch inches yard yards l ml litre litres liter liters gallon gallons
s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years mph kmh km/h m/s hz khz mhz ghz w kw kwh v a j kj cal kcal
usd eur gbp dollar dollars euro euros pound pounds cent cents percent degree degrees celsius fahrenheit kelvin""".encode().split())
OUTER = b"".join(bytes([c]) for c in range(128) if not chr(c).isalnum())
NUMBER, UNIT, NAME = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b"<number>", b"<unit>", b"<name>"))
SKIP, IS_NUMBER, IS_UNIT, CAPITAL, ENDS, LETTER_UNIT = 1, 2, 4, 8, 16, 32


class Lexicon(dict):
    """Place of each word in two arrays: hash of its bare form, and flags. Emptied between texts once it is large."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit, self.codes, self.flags = limit, np.empty(1024, np.uint64), np.empty(1024, np.uint8)

    def __missing__(self, word: bytes) -> int:
        at = len(self)
        if at == len(self.codes):
            self.codes, self.flags = np.concatenate([self.codes, np.empty_like(self.codes)]), np.concatenate([self.flags, np.empty_like(self.flags)])
        bare = word.strip(OUTER)
        if bare.isalpha():                                   # ASCII letters only
            low, flag = bare.lower(), 0 if bare[0] > 90 else CAPITAL
        else:
            text = bare.decode("utf-8", "replace")
            low, flag = text.lower().encode(), SKIP if not bare else IS_NUMBER if re.search(rb"[0-9]", bare) else CAPITAL if text[0].isupper() else 0
        if low in UNITS:
            flag = IS_UNIT if len(low) > 1 else flag | LETTER_UNIT
        if word.rstrip(b"\"')]}").endswith((b".", b"!", b"?", b":")):
            flag |= ENDS
        self.codes[at], self.flags[at] = xxhash.xxh3_64_intdigest(low), flag
        self[word] = at
        return at

    def template(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
        """Template codes, value hashes, which tokens are slots, and whether the first is a capitalised literal."""
        if len(self) > self.limit:
            self.clear()
        words = split_words(text)
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        values, flags = self.codes[at], self.flags[at]
        inside = np.zeros(len(words), bool)
        inside[1:] = flags[:-1] & ENDS == 0
        live = flags & SKIP == 0
        values, flags, inside = values[live], flags[live], inside[live]
        measured = np.zeros(len(flags), bool)
        measured[1:] = flags[:-1] & (IS_NUMBER | ENDS) == IS_NUMBER
        number, unit, name = flags & IS_NUMBER > 0, (flags & IS_UNIT > 0) | (flags & LETTER_UNIT > 0) & measured, (flags & CAPITAL > 0) & inside
        slots = number | unit | name
        codes = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, values)))
        return codes, values, slots, bool(len(flags) and flags[0] & CAPITAL and not slots[0])


#: OPENING: the first word of an item as a name; OPENING_OWN: as a name that must be the item's own.
VERBATIM, TEMPLATE, OPENING, OPENING_OWN = 0, 1, 2, 3


def _windows(codes: np.ndarray, values: np.ndarray, slots: np.ndarray, k: int, bloom: np.ndarray | None = None) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(form, start, hash) of the windows of ``k`` tokens that may be in the filter: all by their values, and by their template those
    with a slot and enough literals."""
    n = len(codes) - k + 1
    if n <= 0:
        return []
    own, template = window_hashes(values, k), window_hashes(codes, k)
    literal = np.concatenate([[0], np.cumsum(~slots)])
    here = literal[k:] - literal[:n]
    out = []
    for form, h, at in ((VERBATIM, own, np.arange(n)), (TEMPLATE, template, np.flatnonzero((here < k) & (here >= LITERALS)))):
        at = at if bloom is None else at[in_bloom(bloom, h[at])]
        if len(at):
            out.append((form, at, h[at]))
    return out


def _rows(at, h, codes, k):
    """Both hashes of each window."""
    second = np.zeros(len(at), np.uint64)
    for j in range(k):
        second = mix(second * np.uint64(31) + codes[at + j] + np.uint64(j))
    return signed(h), signed(second)


SCHEMA = "h long, h2 long, at int, k int, form int, v array<long>"


def item_windows(bench: DataFrame) -> DataFrame:
    """Windows of every item; an item shorter than a window is one window of its own length. ``strong``: enough literals;
    ``n_strong``: tokens in such windows."""
    lex = Lexicon()

    def run(b):
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            codes, values, slots, opens = lex.template(t)
            k = min(WINDOW, len(codes))
            if k == 0:
                continue
            literals = np.convolve(~slots, np.ones(k, int), "valid")
            strong = literals >= LITERALS
            n_strong = int((np.convolve(strong, np.ones(k, int)) > 0).sum())
            found = [(form, at, h, codes if form else values, slots) for form, at, h in _windows(codes, values, slots, k)]
            if opens and strong[0]:
                named, held = codes.copy(), slots.copy()
                named[0], held[0] = NAME, True
                found.append((OPENING if literals[0] > LITERALS else OPENING_OWN, np.zeros(1, np.int64), window_hashes(named[:k], k), named, held))
            for form, at, h, by, held in found:
                n, place = len(at), at[:, None] + np.arange(k)
                v = np.where(held[place], signed(values)[place], 0)           # 0 for a literal
                h1, h2 = _rows(at, h, by, k)
                yield pa.RecordBatch.from_arrays([pa.array([i] * n, pa.int64()), pa.array([len(codes)] * n, pa.int32()), pa.array([n_strong] * n, pa.int32()), pa.array(strong[at]), pa.array(h1), pa.array(h2),
                                                  pa.array(at.astype(np.int32)), pa.array([k] * n, pa.int32()), pa.array([form] * n, pa.int32()), lists(v.ravel(), [k] * n, pa.int64())],
                                                 ["item_id", "n_tokens", "n_strong", "strong", "h", "h2", "at", "k", "form", "v"])
    return map_arrow(bench.select(F.col("item_id").cast("long"), "text"), run, "item_id long, n_tokens int, n_strong int, strong boolean, " + SCHEMA)


def text_windows(docs: DataFrame, lengths: list[int], bloom: np.ndarray) -> DataFrame:
    """Windows of every whole text that may be in the benchmark; key: doc_id and a hash of the text."""
    lex = Lexicon()

    def run(b):
        for i, key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            codes, values, slots, _ = lex.template(t)
            for k in lengths:
                for form, at, h in _windows(codes, values, slots, k, bloom):
                    n, place = len(at), at[:, None] + np.arange(k)
                    h1, h2 = _rows(at, h, codes if form else values, k)
                    yield pa.RecordBatch.from_arrays([pa.array([i] * n, pa.int64()), pa.array([key] * n, pa.int64()), pa.array(h1), pa.array(h2), pa.array(at.astype(np.int32)), pa.array([k] * n, pa.int32()),
                                                      pa.array([form] * n, pa.int32()), lists(signed(values)[place].ravel(), [k] * n, pa.int64())], ["doc_id", "key", "h", "h2", "at", "k", "form", "v"])
    return map_texts(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), "text"), run, "doc_id long, key long, " + SCHEMA)


def find_leaks(docs: DataFrame, bench: DataFrame, cover: int = COVER) -> DataFrame:
    """One row (doc_id, key, item_id, n_tokens, n_covered, exact) per document and item that contaminates it. ``exact``: all slots
    that count have the item's own values; where slots conflict, only windows with its own values count."""
    items = item_windows(bench)
    bloom = bloom_of(items, "h")
    lengths = sorted({r["k"] for r in items.select("k").distinct().collect()})      # at most eight values
    found = text_windows(docs, lengths, bloom).withColumnsRenamed({"at": "t_at", "v": "t_v"}).drop("form")
    hits = (found.join(items, ["h", "h2", "k"]).where((F.col("form") != OPENING_OWN) | (F.element_at("v", 1) == F.element_at("t_v", 1)))
            .select("doc_id", "key", "item_id", "n_tokens", "n_strong", "strong", "k", "at", (F.col("t_at") - F.col("at")).alias("shift"), "form", "v", "t_v"))
    # a diagonal holds each place of an item once, so a group is no longer than its item
    diagonal = ["doc_id", "key", "item_id", "n_tokens", "n_strong", "shift"]
    one = hits.groupBy(*diagonal, "at", "k", "strong").agg(F.max_by("v", "form").alias("v"), F.first("t_v").alias("t_v"), (F.min("form") == VERBATIM).alias("own"))
    slots = F.filter(F.arrays_zip("v", "t_v"), lambda p: p["v"] != 0)
    places = F.expr("sequence(at, at + k - 1)")
    lines = one.groupBy(*diagonal).agg(F.flatten(F.collect_list(slots)).alias("p"), F.flatten(F.collect_list(places)).alias("covered"), F.flatten(F.collect_list(F.when(F.col("strong"), places))).alias("firm"),
                                       F.flatten(F.collect_list(F.when(F.col("own"), places))).alias("same"))
    pairs, items_, texts = F.size(F.array_distinct("p")), F.size(F.array_distinct(F.transform("p", lambda p: p["v"]))), F.size(F.array_distinct(F.transform("p", lambda p: p["t_v"])))
    enough = lambda n, of: (F.col(of) > 0) & (n >= F.least(F.lit(cover), F.col(of)))
    distinct = lambda c: F.size(F.array_distinct(c))
    lines = lines.withColumn("fits", (pairs == items_) & (pairs == texts))
    lines = (lines.where(enough(distinct("same"), "n_tokens") | F.col("fits") & (enough(distinct("covered"), "n_tokens") | enough(distinct("firm"), "n_strong")))
             .withColumn("n_covered", F.when(F.col("fits"), distinct("covered")).otherwise(distinct("same")))
             .withColumn("exact", ~F.col("fits") | F.forall("p", lambda p: p["v"] == p["t_v"])))
    return lines.groupBy("doc_id", "key", "item_id", "n_tokens").agg(F.max("n_covered").alias("n_covered"), F.max("exact").alias("exact"))


def drop_leaks(docs: DataFrame, bench: DataFrame, cover: int = COVER) -> DataFrame:
    """The documents that no item contaminates, with their columns unchanged."""
    leaks = durable(find_leaks(docs, bench, cover).select(F.col("doc_id").alias("doc"), "key").distinct())
    rows = packed(docs, doc=F.col("doc_id").cast("long"), key=F.xxhash64("text"))
    return unpacked(without(rows, leaks, ["doc", "key"]))
