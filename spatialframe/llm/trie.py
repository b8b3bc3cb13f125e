"""Prefix trie of conversations, its subtree sums by the Euler-tour technique.

Conversations are rebuilt first: conversation c takes the first h turns of conversation c - c % 100, h = crc32(c) % 6, and then its own turns after its first
h. A node of depth d is a distinct sequence of d turns (role, text), found by the combined 128-bit hashes of its turns with their places.

*Tour.* Siblings get consecutive numbers, so each node's first child and next sibling are a look-up away. A node has an enter arc and an exit arc; an enter
arc is followed by that of the first child, or by the node's own exit; an exit arc by the next sibling's enter arc, or by the parent's exit.
*List ranking.* In rounds, every arc whose random priority is above those of both neighbours leaves the list and tells them; its
predecessor takes over its length. About a third of the arcs goes each round, in one shuffle. What is left when ``walk`` arcs or fewer remain is walked in one
task, and the arcs come back in reverse order of their leaving. *Sums.* Enter arcs carry whether their node is a leaf and what it saves; prefix
sums over the places of the tour, by blocks of places, give each subtree as a difference at its two arcs.

Turns are in order of ``turn`` (null first), then role, then text; null role and text are empty. Repeated rows are turns of their own. Rows without a conv_id
belong to no conversation and are left out. A conversation may be of any length: turns are ranked by ranges and hashed by blocks, and equal rows are counted
first. The digest of the ids that end at a node is one stream by its definition: pieces of it are sorted and joined in many tasks, only their bytes pass
through one. An empty table has no root and gives no row. Columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from spatialframe.functions.durable import Scratch

from .ranking import global_index
from .words import seeded

SHARED, FAMILY = 6, 100
BLOCK = 4096                    # turns of a conversation, or places of the tour, in one block
COPIES = 100_000                # equal turns made by one row
WALK = 50_000                   # arcs walked in one task
EMPTY = hashlib.sha256(b"").hexdigest()


def zero() -> Column:
    return F.lit(0).cast("long")


def _copies(df: DataFrame, count: str, index: str) -> DataFrame:
    """Each row ``count`` times, with its number from 0; no array is longer than ``COPIES``."""
    blocks = df.withColumn("__block", F.explode(F.sequence(zero(), F.floor((F.col(count) - 1) / COPIES))))
    at = F.sequence(F.col("__block") * COPIES, F.least(F.col(count), (F.col("__block") + 1) * COPIES) - 1)
    return blocks.withColumn(index, F.explode(at)).drop("__block")


def ordered_turns(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(c, pos, k1, k2, chars) of every turn: place in its conversation from 1, 128 bits of role and text, code points of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("c"), "turn", role.alias("role"), text.alias("text"))
    distinct = rows.groupBy("c", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    placed = global_index(distinct, ["c", F.col("turn").asc_nulls_first(), "role", "text"], scratch, "turns", "row")
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))
    half = lambda a: F.conv(F.substring(digest, a, 16), 16, -10).cast("long")
    slim = scratch.keep(placed.select("c", "row", "n", half(1).alias("k1"), half(17).alias("k2"), F.length("text").cast("long").alias("chars")), "slim")
    # turns before a row, in blocks of row numbers
    block = slim.groupBy("c", F.floor(F.col("row") / BLOCK).alias("b")).agg(F.sum("n").alias("all"))
    before = F.coalesce(F.sum("all").over(W.partitionBy("c").orderBy("b").rowsBetween(W.unboundedPreceding, -1)), zero())
    block = block.select("c", "b", before.alias("before"))
    inside = F.coalesce(F.sum("n").over(W.partitionBy("c", "b").orderBy("row").rowsBetween(W.unboundedPreceding, -1)), zero())
    first = slim.withColumn("b", F.floor(F.col("row") / BLOCK)).withColumn("inside", inside).join(block, ["c", "b"])
    first = first.select("c", (F.col("before") + F.col("inside") + 1).alias("first"), "n", "k1", "k2", "chars")
    return _copies(first, "n", "copy").select("c", (F.col("first") + F.col("copy")).alias("pos"), "k1", "k2", "chars")


def shared_turns(c: Column) -> Column:
    return (F.crc32(c.cast("string").cast("binary")) % SHARED).cast("long")


def rebuilt(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(c, d, k1, k2, chars) of every rebuilt turn, d from 1, and one row per conversation with d 0 and the number of its turns in ``chars``."""
    own = scratch.keep(ordered_turns(turns, scratch), "own")
    sizes = own.groupBy("c").agg(F.count(F.lit(1)).alias("n")).withColumns({"h": shared_turns(F.col("c")), "base": F.col("c") - F.col("c") % FAMILY})
    sizes = scratch.keep(sizes, "sizes")
    base = sizes.select(F.col("c").alias("base"), F.col("n").alias("base_n"))
    sizes = scratch.keep(sizes.join(base, "base", "left").withColumn("given", F.least("h", F.coalesce("base_n", zero()))), "convs")
    giving = own.where((F.col("c") % FAMILY == 0) & (F.col("pos") < SHARED)).withColumnRenamed("c", "base")      # five turns of a conversation at most
    given = sizes.where("given > 0").select("c", "base", "given").join(giving, "base").where("pos <= given").select("c", F.col("pos").alias("d"), "k1", "k2", "chars")
    kept = own.join(sizes.where("n > h").select("c", "h", "given"), "c").where("pos > h").select("c", (F.col("pos") - F.col("h") + F.col("given")).alias("d"), "k1", "k2", "chars")
    count = F.col("given") + F.greatest(F.col("n") - F.col("h"), zero())
    top = sizes.select("c", zero().alias("d"), zero().alias("k1"), zero().alias("k2"), count.alias("chars"))
    return given.unionByName(kept).unionByName(top)


def prefixes(steps: DataFrame, scratch: Scratch) -> DataFrame:
    """(c, d, p1, p2, q1, q2, chars): hashes of the first d turns and of the first d - 1. A turn is hashed with its place, so that the
    exclusive or of the hashes stands for the sequence; blocks of a conversation are combined first."""
    placed = steps.withColumns({"x1": F.when(F.col("d") > 0, F.xxhash64(F.lit(1), "d", "k1", "k2")).otherwise(zero()), "x2": F.when(F.col("d") > 0, F.xxhash64(F.lit(2), "d", "k2", "k1")).otherwise(zero()),
                                "b": F.floor(F.col("d") / BLOCK)})
    placed = scratch.keep(placed.select("c", "d", "b", "x1", "x2", "chars"), "placed")
    blocks = placed.groupBy("c", "b").agg(F.bit_xor("x1").alias("y1"), F.bit_xor("x2").alias("y2"))
    before = W.partitionBy("c").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("c", "b", *[F.coalesce(F.bit_xor(f"y{k}").over(before), zero()).alias(f"z{k}") for k in (1, 2)])
    here = W.partitionBy("c", "b").orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    upto = placed.withColumns({f"w{k}": F.bit_xor(f"x{k}").over(here) for k in (1, 2)}).join(blocks, ["c", "b"])
    upto = upto.withColumns({f"p{k}": F.col(f"w{k}").bitwiseXOR(F.col(f"z{k}")) for k in (1, 2)})
    return upto.select("c", "d", "p1", "p2", *[F.col(f"p{k}").bitwiseXOR(F.col(f"x{k}")).alias(f"q{k}") for k in (1, 2)], "chars")


def ends_digests(ends: DataFrame) -> DataFrame:
    """(d, p1, p2, ends_sha256) of the sorted ids ``c`` that end at a node. Ids are sorted by ranges and joined to pieces there; the pieces of a node
    pass through its digest one by one, whatever their number."""
    node, kinds = ["d", "p1", "p2"], "d long, p1 long, p2 long"

    def pieces(batches):
        for b in batches:
            keys = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            cuts = np.flatnonzero(np.any(keys[:, 1:] != keys[:, :-1], axis=0)) + 1
            cs, out = b.column(3).to_pylist(), []
            for a, z in zip([0, *cuts], [*cuts, len(cs)]):
                if z > a:
                    out.append((*keys[:, a].tolist(), cs[a], ",".join(map(str, cs[a:z]))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [pa.int64()] * 4 + [pa.string()])], [*node, "first", "ids"])

    def digests(batches):
        now, sha = None, None
        for b in batches:
            out = []
            for *key, ids in zip(*(b.column(c).to_pylist() for c in (0, 1, 2, 4))):
                if key != now:
                    if now is not None:
                        out.append((*now, sha.hexdigest()))
                    now, sha = key, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [pa.int64()] * 3 + [pa.string()])], [*node, "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*now, sha.hexdigest()), [pa.int64()] * 3 + [pa.string()])], [*node, "ends_sha256"])
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = ends.select(*node, "c").repartitionByRange(parts, *node, "c").sortWithinPartitions(*node, "c").mapInArrow(pieces, f"{kinds}, first long, ids string")
    return ranged.repartition(parts, *node).sortWithinPartitions(*node, "first").mapInArrow(digests, f"{kinds}, ends_sha256 string")


def list_ranks(arcs: DataFrame, scratch: Scratch, walk: int = WALK) -> DataFrame:
    """(arc, place) of a linked list (arc, prev, next) from 0 on; ``prev`` of the first and ``next`` of the last are null."""
    live = scratch.keep(arcs.select("arc", "prev", "next", F.lit(1).cast("long").alias("length")), "live")
    rounds = []
    while live.count() > walk:
        turn = len(rounds)
        priority = lambda c: F.struct(seeded("arc", F.lit(turn), c).alias("p"), c.alias("a"))
        above = lambda c: F.col(c).isNull() | (priority(F.col("arc")) > priority(F.col(c)))
        marked = live.withColumn("out", above("prev") & above("next") & F.col("prev").isNotNull())     # the first arc stays
        gone = scratch.keep(marked.where("out").select("arc", "prev", "next", "length"), f"gone{turn}")
        none = F.lit(None).cast("long")
        stay = marked.where("not out").select("arc", "prev", "next", "length", none.alias("new_prev"), none.alias("new_next"), zero().alias("more"), F.lit(False).alias("prev_gone"), F.lit(False).alias("next_gone"))
        to_prev = gone.select(F.col("prev").alias("arc"), none.alias("prev"), none.alias("next"), zero().alias("length"), none.alias("new_prev"), F.col("next").alias("new_next"),
                              F.col("length").alias("more"), F.lit(False).alias("prev_gone"), F.lit(True).alias("next_gone"))
        to_next = gone.where("next is not null").select(F.col("next").alias("arc"), none.alias("prev"), none.alias("next"), zero().alias("length"), F.col("prev").alias("new_prev"), none.alias("new_next"),
                                                        zero().alias("more"), F.lit(True).alias("prev_gone"), F.lit(False).alias("next_gone"))
        told = stay.unionByName(to_prev).unionByName(to_next).groupBy("arc").agg(*[F.max(c).alias(c) for c in ("prev", "next", "new_prev", "new_next", "prev_gone", "next_gone")], F.sum("length").alias("length"), F.sum("more").alias("more"))
        pick = lambda c: F.when(F.col(f"{c}_gone"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
        # where an arc that left began: after the length its predecessor had until then
        had = told.where("next_gone").select(F.col("arc").alias("prev"), F.col("length").alias("after"))
        rounds.append(scratch.keep(gone.join(had, "prev").select("arc", "prev", "after"), f"left{turn}"))
        live = scratch.keep(told.select("arc", pick("prev"), pick("next"), (F.col("length") + F.col("more")).alias("length")), "live")
        scratch.drop(f"gone{turn}")

    def walked(t: pa.Table) -> pa.Table:
        arc, nxt, length = t["arc"].to_pylist(), t["next"].to_pylist(), t["length"].to_pylist()
        at = {a: i for i, a in enumerate(arc)}
        places, place, now = [0] * len(arc), 0, next((a for a, p in zip(arc, t["prev"].to_pylist()) if p is None), None)
        while now is not None:
            i = at[now]
            places[i], place, now = place, place + length[i], nxt[i]
        return pa.table({"arc": pa.array(arc, pa.int64()), "place": pa.array(places, pa.int64())})
    ranks = scratch.keep(live.groupBy(F.lit(0).alias("g")).applyInArrow(walked, "arc long, place long"), "ranks")       # ``walk`` arcs at most
    for turn in range(len(rounds) - 1, -1, -1):
        came = rounds[turn].join(ranks.select(F.col("arc").alias("prev"), "place"), "prev").select("arc", (F.col("place") + F.col("after")).alias("place"))
        ranks = scratch.keep(ranks.unionByName(came), "ranks")
        scratch.drop(f"left{turn}")
    scratch.drop("live")
    return ranks


def euler_tour(nodes: DataFrame) -> DataFrame:
    """Arcs (arc, prev, next) of a tree (node, parent, first, last, older, younger): children from ``first`` to ``last``, the siblings before and after,
    all null where there is none. Node i enters by arc 2i and leaves by arc 2i + 1."""
    enter, leave = lambda c: F.col(c) * 2, lambda c: F.col(c) * 2 + 1
    down = nodes.select(enter("node").alias("arc"), F.coalesce(leave("older"), enter("parent")).alias("prev"), F.coalesce(enter("first"), leave("node")).alias("next"))
    up = nodes.select(leave("node").alias("arc"), F.coalesce(leave("last"), enter("node")).alias("prev"), F.coalesce(enter("younger"), leave("parent")).alias("next"))
    return down.unionByName(up)


def build_trie(turns: DataFrame, walk: int = WALK) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) per node."""
    scratch = Scratch(turns.sparkSession)
    steps = prefixes(scratch.keep(rebuilt(turns, scratch), "steps"), scratch)
    steps = scratch.keep(steps, "prefixes")
    scratch.drop("turns", "slim", "own", "sizes", "convs", "steps", "placed")
    key = ["d", "p1", "p2"]
    found = steps.groupBy(*key).agg(F.min("c").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.max(F.when(F.col("d") > 0, F.col("chars")).otherwise(0)).alias("chars"), F.min("q1").alias("q1"), F.min("q2").alias("q2"))
    # by depth and parent, then by smallest member: siblings stand next to each other
    nodes = scratch.keep(global_index(found, ["d", "q1", "q2", "conv", "p1", "p2"], scratch, "sorted", "node"), "nodes")
    children = nodes.where("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.min("node").alias("first"), F.max("node").alias("last"))
    parents = scratch.keep(nodes.join(children, key).select("node", "conv", "d", "p1", "p2", "first", "last"), "parents")
    up = parents.select((F.col("d") + 1).alias("d"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("node").alias("parent"), F.col("conv").alias("parent_conv_id"), F.col("first").alias("eldest"), F.col("last").alias("youngest"))
    placed = nodes.join(up, ["d", "q1", "q2"], "left").join(parents.select("node", "first", "last"), "node", "left")
    placed = placed.withColumns({"older": F.when(F.col("node") > F.col("eldest"), F.col("node") - 1), "younger": F.when(F.col("node") < F.col("youngest"), F.col("node") + 1),
                                 "n_children": F.coalesce(F.col("last") - F.col("first") + 1, zero()), "saved": (F.col("n_convs") - 1) * F.col("chars")})
    placed = scratch.keep(placed, "tree")
    ranks = list_ranks(euler_tour(placed), scratch, walk)

    # prefix sums over the tour: what a place carries, the sums of the blocks before it and within its own
    node = F.floor(F.col("arc") / 2).cast("long")
    carried = placed.select((F.col("node") * 2).alias("arc"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaf"), "saved")
    along = ranks.join(carried, "arc", "left").select("arc", "place", F.floor(F.col("place") / BLOCK).alias("b"), F.coalesce("leaf", zero()).alias("leaf"), F.coalesce("saved", zero()).alias("saved"))
    along = scratch.keep(along, "along")
    blocks = along.groupBy("b").agg(F.sum("leaf").alias("l"), F.sum("saved").alias("s"))
    before = W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)                 # one row per block of the tour
    blocks = blocks.select("b", F.coalesce(F.sum("l").over(before), zero()).alias("l"), F.coalesce(F.sum("s").over(before), zero()).alias("s"))
    here = W.partitionBy("b").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    sums = along.withColumns({"li": F.coalesce(F.sum("leaf").over(here), zero()), "si": F.coalesce(F.sum("saved").over(here), zero())}).join(blocks, "b")
    at = lambda v, w, side: F.sum(F.when(F.col("arc") % 2 == side, F.col(v) + F.col(w)))
    spans = sums.groupBy(node.alias("node")).agg((at("l", "li", 1) - at("l", "li", 0)).alias("n_leaves"), (at("s", "si", 1) - at("s", "si", 0)).alias("saved_tokens"))
    # a conversation ends where no turn follows: at the depth that its row of depth 0 tells
    last = steps.where("d = 0").select("c", F.col("chars").alias("d"))
    ends = ends_digests(steps.join(last, ["c", "d"]))
    out = placed.join(spans, "node").join(ends, key, "left").select(
        F.col("conv").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
    out = scratch.keep(out, "trie")
    scratch.close("trie")
    return out


def oracle_sql() -> str:
    """The same nodes from whole prefixes, subtrees by joining every conversation's nodes with those below them."""
    from .importance import CRC_SQL, crc_sql
    return f"""with {CRC_SQL},
    t as materialized (select conv_id c, coalesce(role, '') r, coalesce(text, '') x, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) p from conversations where conv_id is not null),
    convs as materialized (select c, c - c % {FAMILY} b, n, {crc_sql('c::varchar')} % {SHARED} h from (select c, count(*) n from t group by c), crc_table),
    given as (select v.c, v.h, least(v.h, coalesce(w.n, 0)) m, v.b from convs v left join convs w on v.b = w.c),
    turns as (select g.c, t.p d, r, x from given g join t on t.c = g.b and t.p <= g.h union all select g.c, t.p - g.h + g.m, r, x from given g join t on t.c = g.c and t.p > g.h),
    chain as (select c, d, length(x) n, md5(string_agg(length(r) || ':' || r || length(x) || ':' || x, '' order by d) over (partition by c order by d rows unbounded preceding)) k from turns),
    steps as materialized (select c, d, n, k, lag(k, 1, 'root') over (partition by c order by d) up from chain union all select c, 0, 0, 'root', null from convs),
    nodes as materialized (select d, k, any_value(up) up, min(c) conv, count(*) m, max(n) n from steps group by d, k),
    kids as (select up k, d - 1 d, count(*) n from nodes where d > 0 group by all),
    below as (select distinct a.d, a.k, z.d zd, z.k zk from steps a join steps z on a.c = z.c and z.d >= a.d),
    sums as (select a.d, a.k, count(*) filter (where q.n is null) leaves, sum((z.m - 1) * z.n) saved from below a join nodes z on z.d = a.zd and z.k = a.zk left join kids q on q.d = a.zd and q.k = a.zk group by all),
    ends as (select d, k, string_agg(c::varchar, ',' order by c) ids from (select c, max(d) d, arg_max(k, d) k from steps group by c) group by d, k)
    select v.conv conv_id, v.d::bigint depth, p.conv parent_conv_id, v.m::bigint n_convs, coalesce(q.n, 0)::bigint n_children, s.leaves::bigint n_leaves, s.saved::bigint saved_tokens, sha256(coalesce(e.ids, '')) ends_sha256
    from nodes v left join nodes p on p.d = v.d - 1 and p.k = v.up left join kids q on q.d = v.d and q.k = v.k join sums s on s.d = v.d and s.k = v.k left join ends e on e.d = v.d and e.k = v.k"""
