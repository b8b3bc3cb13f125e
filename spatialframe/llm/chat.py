"""Chat formatting: multi-party perspective rotation.

Every participant of a dialogue gets a rendering in which they are the assistant, the others are users with their names, and the
mask covers what they say. ``system`` turns are context for all and no participant; a turn without a role is said by ``unknown``,
who gets no rendering. A null text is empty. ``<|`` inside texts and names is written ``< |``, so a text cannot forge a marker.

A dialogue is rendered in blocks of ``block`` consecutive turn numbers, so that one of any length never has to fit in one row; a turn
number without a value has a block of its own. Turns of one number are ordered by role and text and repeated rows are all kept;
where more than ``most`` rows share a block, its parts are runs of ``most`` rows in that order. So the pieces of one perspective, by block (null
first) and part, joined together are the whole rendering. System turns aren't repeated in later blocks. An empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from spatialframe.functions.durable import Scratch

END = "<|end|>\n"


def _safe(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def _parts(said: DataFrame, most: int) -> DataFrame:
    """``part`` of every row: its place in the block divided by ``most``. Only the different rows of blocks with more rows are sorted, by
    ranges over all tasks; the place is what lies in earlier ranges and what comes before in its own."""
    scratch, row = Scratch(said.sparkSession), ["conv_id", "block", "turn", "role", "text"]
    sizes = said.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    sizes = scratch.keep(sizes.select(F.col("conv_id").alias("__sc"), F.col("block").alias("__sb")), "crowded")
    first = F.lit(0).cast("long").alias("part")
    if sizes.isEmpty():
        scratch.close()
        return said.select(*row, first)
    same = F.col("conv_id").eqNullSafe(F.col("__sc")) & F.col("block").eqNullSafe(F.col("__sb"))
    counted = said.join(sizes, same, "left_semi").groupBy(*row).agg(F.count(F.lit(1)).alias("__n"))
    ranged = counted.repartitionByRange(int(said.sparkSession.conf.get("spark.sql.shuffle.partitions")), *row)
    ranged = scratch.keep(ranged.withColumn("__range", F.spark_partition_id()), "ranged")
    before = lambda *keys: W.partitionBy("conv_id", "block", *keys).rowsBetween(W.unboundedPreceding, -1)
    totals = ranged.groupBy("conv_id", "block", "__range").agg(F.sum("__n").alias("__all"))
    totals = totals.select(F.col("conv_id").alias("__sc"), F.col("block").alias("__sb"), F.col("__range").alias("__r"), F.coalesce(F.sum("__all").over(before().orderBy("__range")), F.lit(0)).alias("__first"))
    placed = ranged.withColumn("__in", F.coalesce(F.sum("__n").over(before("__range").orderBy("turn", "role", "text")), F.lit(0))).join(totals, same & (F.col("__range") == F.col("__r")))
    place = F.explode(F.sequence(F.col("__first") + F.col("__in"), F.col("__first") + F.col("__in") + F.col("__n") - 1)).alias("__place")
    parts = placed.select(*row, place).select(*row, F.floor(F.col("__place") / most).cast("long").alias("part"))
    return said.join(sizes, same, "left_anti").select(*row, first).unionByName(parts)


def rotate(turns: DataFrame, block: int = 64, most: int = 4096) -> DataFrame:
    """(conv_id, block, part, perspective, n_turns, n_own, chat, mask) with ``mask`` an array of (from, to) in characters of ``chat``."""
    said = turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
                        F.floor(F.col("turn") / block).cast("long").alias("block"))
    people = turns.where("role is not null and role <> 'system'").select(F.col("conv_id").alias("__c"), F.col("role").alias("perspective")).distinct()
    said = _parts(said, most)
    seen = said.join(people, F.col("conv_id").eqNullSafe(F.col("__c"))).drop("__c")
    own = F.col("role") == F.col("perspective")
    head = F.when(own, "<|assistant|>\n").when(F.col("role") == "system", "<|system|>\n").otherwise(F.concat(F.lit("<|user name="), _safe(F.col("role")), F.lit("|>\n")))
    seen = seen.withColumns({"__head": head, "__body": _safe(F.col("text")), "__own": own})
    seen = seen.withColumn("__len", F.length("__head") + F.length("__body") + len(END))
    w = W.partitionBy("conv_id", "block", "part", "perspective").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum("__len").over(w), F.lit(0))
    placed = seen.withColumn("__at", start + F.length("__head"))
    one = F.struct(F.col("__at").alias("at"), F.col("__head").alias("head"), F.col("__body").alias("body"), F.col("__own").alias("own"))
    packed = placed.groupBy("conv_id", "block", "part", "perspective").agg(F.sort_array(F.collect_list(one)).alias("__t"))
    spans = F.transform(F.filter("__t", lambda t: t["own"]), lambda t: F.struct(t["at"].alias("from"), (t["at"] + F.length(t["body"])).alias("to")))
    return packed.select("conv_id", "block", "part", "perspective", F.size("__t").alias("n_turns"), F.size(spans).alias("n_own"),
                         F.array_join(F.transform("__t", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("chat"), spans.alias("mask"))


ORACLE_SQL = """with rows as (select conv_id, turn, coalesce(role, 'unknown') r, coalesce(text, '') t, cast(floor(turn / 64) as bigint) block from conversations),
said as (select *, (row_number() over (partition by conv_id, block order by turn nulls first, r, t) - 1) // 4096 part from rows),
people as (select distinct conv_id, role perspective from conversations where role is not null and role <> 'system'),
seen as (select s.*, p.perspective, r = p.perspective own, replace(t, '<|', '< |') body,
    case when r = p.perspective then '<|assistant|>' || chr(10) when r = 'system' then '<|system|>' || chr(10) else '<|user name=' || replace(r, '<|', '< |') || '|>' || chr(10) end head
    from said s join people p on s.conv_id is not distinct from p.conv_id),
placed as (select *, length(head) + coalesce(sum(length(head) + length(body) + 8) over (partition by conv_id, block, part, perspective order by turn nulls first, r, t rows between unbounded preceding and 1 preceding), 0) pos from seen)
select conv_id, block, part, perspective, cast(count(*) as integer) n_turns, cast(sum(case when own then 1 else 0 end) as integer) n_own,
    string_agg(head || body || '<|end|>' || chr(10), '' order by pos, head, body) chat,
    coalesce(string_agg(case when own then cast(pos as bigint) || '-' || cast(pos + length(body) as bigint) end, ',' order by pos, head, body), '') mask
from placed group by conv_id, block, part, perspective"""
