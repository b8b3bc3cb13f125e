"""Seeded draws: matching, permutation, bootstrap and identity nulls.

Every draw is a hash rank or a hash index, so results do not depend on partitioning, retries or lost executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StructField, StructType

from ..functions import as_list, exact_percentiles, hash_hex, hash_int, hash_rank, n_rows, rarefied_detection
from ..functions.durable import durable
from ..functions.ordering import ACCURACY
from .graph import axis_nodes, clump_of, topology
from .spatial import nearest, nearest_other, self_pairs
from .stats import bh_adjust, cliffs_delta, mann_whitney


# --- case / control matching -------------------------------------------------------------------------

def match_depth(case: DataFrame, ctrl: DataFrame, by, k: int = 5, bins_per_decade: int = 20, rounds: int = 1, seed=0,
                id: str = "entity_id", depth: str = "n_tx") -> DataFrame:
    """1:k matching on log10 depth without replacement: (group, case_id, control_id, slot, bin_shift).

    Inside a depth bin both sides are put in hash order and the r-th control fills the r-th slot. Slots left open
    are offered the unused controls of the bins next to it, one step further per round. What stays open is a
    shortfall; ``match_shortfall`` counts it.
    """
    by = as_list(by)
    bin_ = F.floor(F.log10(F.greatest(F.col(depth), F.lit(1)).cast("double")) * bins_per_decade)
    order = hash_hex(seed, F.col("id"))
    cases = case.select(*by, F.col(id).alias("id"), bin_.alias("bin")).withColumn("hx", order)
    pool = ctrl.select(*by, F.col(id).alias("id"), bin_.alias("bin")).withColumn("hx", order)
    first = hash_rank(cases, [*by, "bin"], "hx", "id", "rk").withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(k))))
    slots = first.select(*by, "bin", F.col("id").alias("case_id"), F.col("j").alias("slot"), ((F.col("rk") - 1) * k + F.col("j")).alias("pos"))
    shifts = [0] + [s for r in range(1, rounds + 1) for s in (-r, r)]
    done = None
    for s in shifts:
        offer = hash_rank(pool.withColumn("bin", F.col("bin") - s), [*by, "bin"], "hx", "id", "pos")
        hit = slots.join(offer.select(*by, "bin", "pos", F.col("id").alias("control_id")), [*by, "bin", "pos"])
        hit = hit.select(*by, "case_id", "control_id", "slot", F.lit(s).alias("bin_shift"))
        if len(shifts) > 1:
            hit = durable(hit)
        done = hit if done is None else done.unionByName(hit)
        if s == shifts[-1]:
            break
        pool = durable(pool.join(hit.select(*by, F.col("control_id").alias("id")), [*by, "id"], "left_anti"))
        left = slots.drop("pos").join(hit.select(*by, "case_id", "slot"), [*by, "case_id", "slot"], "left_anti")
        left = left.withColumn("hx", hash_hex(seed, F.col("case_id"), F.col("slot"))).withColumn("cs", F.concat_ws("|", "case_id", "slot"))
        slots = durable(hash_rank(left, [*by, "bin"], "hx", "cs", "pos").drop("hx", "cs"))
    return done


def match_shortfall(case: DataFrame, matched: DataFrame, by, k: int = 5) -> DataFrame:
    by = as_list(by)
    want = case.groupBy(*by).agg((n_rows() * k).alias("n_wanted"))
    got = matched.groupBy(*by).agg(n_rows().alias("n_matched"))
    return want.join(got, by, "left").withColumn("n_matched", F.coalesce("n_matched", F.lit(0))).withColumn("shortfall", F.col("n_wanted") - F.col("n_matched"))


# --- permutation null --------------------------------------------------------------------------------

SIDE_BUCKETS = 256


def permuted_members(members: DataFrame, n: int, seed, by, id: str = "entity_id") -> DataFrame:
    """For every draw the members that carry the marker, as many per side as observed.

    ``members`` holds (group, side, id, pos). A draw takes the smallest hashes of a side. Rows whose hash is far
    above the expected cut are dropped before any shuffle (and the job stops if too few were left); of the rest,
    whole hash buckets are taken by their counts and only the bucket at the cut is ranked.
    """
    by = as_list(by)
    keys = [*by, "side"]
    size = members.groupBy(*keys).agg(n_rows().alias("_all"), F.count_if(F.col("pos")).alias("_k")).where("_k > 0")
    cut = F.least(F.lit(1.0), (F.col("_k") + 12 * F.sqrt(F.col("_k")) + 24) / F.col("_all"))
    top = F.floor(cut * 4294967296.0)
    size = size.withColumns({"_cut": cut, "_top": F.when(top < 4294967296, F.lpad(F.lower(F.hex(top)), 8, "0")).otherwise("g")})
    rows = (members.join(F.broadcast(size), keys)  # one row per group and side
            .withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
            .withColumn("_h", hash_hex(seed, F.col("draw"), F.col("side"), F.col(id))))
    u = F.conv(F.substring("_h", 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
    # the cut as text: most rows go without a conversion of their hash
    rows = rows.where(F.substring("_h", 1, 8) <= F.col("_top")).drop("_top").withColumn("_b", F.least(F.floor(u / F.col("_cut") * SIDE_BUCKETS), F.lit(SIDE_BUCKETS - 1)))
    # hashed once and written without the hash: only rows of the bucket at the cut need it again
    rows = durable(rows.drop("_h", "_all", "_cut"))
    dk = [*keys, "draw"]
    cnt = rows.groupBy(*dk, "_b").agg(n_rows().alias("_c"), F.max("_k").alias("_k"))
    cum = W.partitionBy(*dk).orderBy("_b").rowsBetween(W.unboundedPreceding, 0)
    enough = F.sum("_c").over(W.partitionBy(*dk)) >= F.col("_k")
    cnt = (cnt.withColumn("_ok", F.when(enough, True).otherwise(F.raise_error(F.lit("draw cut too tight")).cast("boolean")))
           .withColumn("_left", F.col("_k") - (F.sum("_c").over(cum) - F.col("_c"))).where("_ok and _left > 0")
           .select(*dk, "_b", "_left", (F.col("_left") < F.col("_c")).alias("_edge")))
    # written: its size is known, and while it is small the rows meet it without a shuffle
    kept = rows.drop("_k").join(durable(cnt), [*dk, "_b"])
    rank = F.row_number().over(W.partitionBy(*dk, "_b").orderBy("_h", id))
    # rank only what shares the bucket with the cut
    edge = kept.where("_edge").withColumn("_h", hash_hex(seed, F.col("draw"), F.col("side"), F.col(id))).withColumn("_r", rank).where("_r <= _left").drop("_r", "_h")
    return kept.where("not _edge").unionByName(edge).drop("_b", "_left", "_edge", "pos")


def _members(ent: DataFrame, axis, by, id: str) -> DataFrame:
    lg, lc, rg, rc = axis
    lig, rec = F.col("cell_type").isin(as_list(lc)), F.col("cell_type").isin(as_list(rc))
    return ent.where(lig | rec).select(*by, F.col(id).alias("id"), "x", "y", F.when(lig, "L").otherwise("R").alias("side"),
                                       F.when(lig, F.col(lg) > 0).otherwise(F.col(rg) > 0).alias("pos"))


SITES_AT_ONCE = 1024  # rows whose bitmaps are unpacked together
SUMS_AT_ONCE = 512  # sums of one group and radius a task holds before it emits them


def _draw_bits(look: DataFrame, by: list[str], n: int) -> DataFrame:
    """(group, id, x, y, plane, l, r, some_l, some_r): bit ``draw`` of ``l`` is binary digit ``plane`` of how many left members the draw picked at the
    site; ``some_l``: any bit is set."""
    names = [*by, "id", "x", "y"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SITES_AT_ONCE):
                b = whole.slice(at, SITES_AT_ONCE)
                row = np.repeat(np.arange(b.num_rows), pc.list_value_length(b["picks"]).to_numpy(zero_copy_only=False))
                draw, *counts = (b["picks"].flatten().field(i).to_numpy(zero_copy_only=False) for i in range(3))
                for plane in range(int(max(c.max(initial=0) for c in counts)).bit_length()):
                    sides = []
                    for c in counts:
                        flags = np.zeros((b.num_rows, n), np.uint8)
                        flags[row, draw] = c >> plane & 1
                        sides.append(np.packbits(flags, axis=1))
                    flags = [s.any(1) for s in sides]
                    some = np.flatnonzero(flags[0] | flags[1])
                    part = b.take(pa.array(some))
                    yield pa.RecordBatch.from_arrays(
                        [*(part[c] for c in names), pa.array(np.full(len(some), plane, np.int32)), *(pa.array([x.tobytes() for x in s[some]], pa.binary()) for s in sides),
                         *(pa.array(f[some]) for f in flags)], [*names, "plane", "l", "r", "some_l", "some_r"])

    fields = ([look.schema[c] for c in names] + [StructField("plane", IntegerType()), StructField("l", BinaryType()), StructField("r", BinaryType())]
              + [StructField("some_l", BooleanType()), StructField("some_r", BooleanType())])
    return look.mapInArrow(pack, StructType(fields))


def _count_draws(met: DataFrame, by: list[str], n: int) -> DataFrame:
    """Add up mixed edges per draw inside each task: (group, _from, draw, _e). Only sums leave the task."""
    names = [*by, "_from"]
    kinds = [to_arrow_type(met.schema[c].dataType) for c in names]
    wide = (n + 7) // 8

    def emit(sums: dict[tuple, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for key, t in sums.items():
            draw = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([*(pa.array([v] * len(draw), k) for v, k in zip(key, kinds)), pa.array(draw.astype(np.int32)), pa.array(t[draw])],
                                             [*names, "draw", "_e"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, SITES_AT_ONCE):
                b = whole.slice(at, SITES_AT_ONCE)
                la, ra, lb, rb = (np.frombuffer(b[c].cast(pa.binary(wide)).buffers()[1], np.uint8, b.num_rows * wide).reshape(-1, wide) for c in ("_la", "_ra", "_lb", "_rb"))
                mixed = np.stack([la & rb, ra & lb], axis=1)
                of = np.zeros(b.num_rows, np.int64)
                for c in [*names, "_shift"]:
                    kinds = pc.dictionary_encode(b[c], null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                    first, of = np.unique(of * (b.num_rows + 1) + kinds, return_index=True, return_inverse=True)[1:]
                heads = b.select([*names, "_shift"]).take(pa.array(first))
                for i, (*key, shift) in enumerate(zip(*(c.to_pylist() for c in heads.columns))):
                    t = np.unpackbits(mixed[of == i].reshape(-1, wide), axis=1, count=n).sum(0, dtype=np.int64) << shift
                    sums[tuple(key)] = sums.get(tuple(key), 0) + t
            if len(sums) > SUMS_AT_ONCE:
                yield from emit(sums)
                sums = {}
        yield from emit(sums)

    fields = [met.schema[c] for c in names] + [StructField("draw", IntegerType()), StructField("_e", LongType())]
    return met.mapInArrow(count, StructType(fields))


def permutation_null(ent: DataFrame, axis, radii, n: int, seed, by, id: str = "entity_id", full: bool = False) -> DataFrame:
    """Mixed edges per group, radius and draw when marker status is permuted within each class.

    Space is joined once, at the largest radius, over all members of both classes. Members at one place form one site. A site keeps, per side,
    one bitmap of draws for each binary digit of how many of it a draw picked; an edge meets the bitmaps of its ends by AND, and a task adds
    them up per draw, so what is shuffled after the join grows with tasks x draws and not with edges x draws. With ``full`` the components of
    every draw are found too, all draws in one run keyed by draw; there an edge becomes a row for each draw that both its ends share.
    """
    by = as_list(by)
    radii = sorted(float(r) for r in ([radii] if isinstance(radii, (int, float)) else radii))
    mem = _members(ent, axis, by, id)
    # each member makes many draws: a small table in few files must not leave them to few tasks
    mem = durable(mem.repartition(int(mem.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id"))
    sites = mem.groupBy(*by, "x", "y").agg(F.min("id").alias("id"))
    picks = permuted_members(mem, n, seed, by, "id").groupBy(*by, "x", "y", "draw").agg(
        F.count_if(F.col("side") == "L").alias("l"), F.count_if(F.col("side") == "R").alias("r"))
    per_site = durable(picks.groupBy(*by, "x", "y").agg(F.collect_list(F.struct("draw", "l", "r")).alias("picks")))
    nodes = sites.join(per_site, [*by, "x", "y"])  # a site no draw ever picked cannot matter
    keys = [*by, "radius", "draw"]
    grid = (mem.select(*by).distinct().withColumn("radius", F.explode(F.array(*[F.lit(r) for r in radii])))
            .withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))))
    if full:
        pairs, look = self_pairs(nodes.select(*by, "id", "x", "y"), radii[-1], by), nodes.select(*by, "id", "picks")
        j = (pairs.select(*by, "a_id", "b_id", "dist2")
             .join(look.withColumnsRenamed({"id": "a_id", "picks": "_pa"}), [*by, "a_id"])
             .join(look.withColumnsRenamed({"id": "b_id", "picks": "_pb"}), [*by, "b_id"]))
        draws = F.array_intersect(F.col("_pa.draw"), F.col("_pb.draw"))
        of = lambda c: F.map_from_arrays(F.col(f"{c}.draw"), F.col(c))
        both = (j.select(*by, "a_id", "b_id", "dist2", of("_pa").alias("_ma"), of("_pb").alias("_mb"), F.explode(draws).alias("draw"))
                .select(*by, "a_id", "b_id", "dist2", "draw", F.element_at("_ma", F.col("draw")).alias("a"), F.element_at("_mb", F.col("draw")).alias("b"))
                .withColumn("radius", F.explode(F.filter(F.array(*[F.lit(r) for r in radii]), lambda r: F.col("dist2") <= r * r))))
        drawn = (nodes.select(*by, "id", "x", "y", F.inline("picks"))
                 .withColumn("radius", F.explode(F.array(*[F.lit(r) for r in radii])))
                 .select(*keys, "id", F.col("l").alias("n_lig"), F.col("r").alias("n_rec"), clump_of(radii[0]).alias("clump")))
        # the clump of the smallest radius is a clique at every radius
        place = nodes.select(*by, "id", clump_of(radii[0]).alias("clump"))
        e = (both.select(*keys, "a_id", "b_id", F.col("a.l").alias("a_n_lig"), F.col("a.r").alias("a_n_rec"), F.col("b.l").alias("b_n_lig"), F.col("b.r").alias("b_n_rec"))
             .join(place.withColumnsRenamed({"id": "a_id", "clump": "a_clump"}), [*by, "a_id"])
             .join(place.withColumnsRenamed({"id": "b_id", "clump": "b_clump"}), [*by, "b_id"]))
        t = topology(drawn, e, keys)
        return grid.join(t, keys, "left").select(*keys, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_mixed_edges", "largest_mixed")],
                                                 F.coalesce("frac_in_mixed", F.lit(0.0)).alias("frac_in_mixed"))
    # the bitmaps go with the sites into the join in space, so its many pairs are not shuffled again
    pairs = self_pairs(durable(_draw_bits(nodes, by, n)), radii[-1], by).where("(a_some_l and b_some_r) or (a_some_r and b_some_l)")
    first = F.array_min(F.filter(F.array(*[F.lit(r) for r in radii]), lambda r: F.col("dist2") <= r * r))
    met = pairs.select(*by, first.alias("_from"), (F.col("a_plane") + F.col("b_plane")).alias("_shift"), *[F.col(f"{e}_{c}").alias(f"_{c}{e}") for e in "ab" for c in "lr"])
    m = (_count_draws(met, by, n).withColumn("radius", F.explode(F.filter(F.array(*[F.lit(r) for r in radii]), lambda r: r >= F.col("_from"))))
         .groupBy(*keys).agg(F.sum("_e").alias("_e")))
    own = (per_site.select(*by, F.inline("picks")).where("l > 0 and r > 0").groupBy(*by, "draw").agg(F.sum(F.col("l") * F.col("r")).alias("_o")))
    return (grid.join(m, keys, "left").join(own, [*by, "draw"], "left")
            .select(*keys, (F.coalesce("_e", F.lit(0)) + F.coalesce("_o", F.lit(0))).alias("n_mixed_edges")))


def perm_pvalue(obs: DataFrame, draws: DataFrame, by, col: str = "n_mixed_edges") -> DataFrame:
    """(1 + draws at or above the observed) / (1 + N), with null mean, population sd and quantiles of the N draws."""
    by = as_list(by)
    j = draws.select(*by, F.col(col).cast("double").alias("_d")).join(obs.select(*by, F.col(col).cast("double").alias("observed")), by)
    q = lambda p: F.percentile("_d", F.lit(p))  # N values per group
    g = j.groupBy(*by, "observed").agg(
        n_rows().alias("n_draws"), ((1 + F.count_if(F.col("_d") >= F.col("observed"))) / (1 + n_rows())).alias("p"), F.avg("_d").alias("null_mean"),
        F.stddev_pop("_d").alias("null_sd"), q(.025).alias("null_q025"), q(.25).alias("null_q25"), q(.75).alias("null_q75"), q(.975).alias("null_q975"))
    return g.withColumn("enrich", F.when(F.col("null_mean") > 0, F.col("observed") / F.col("null_mean")))


def observed_mixed(ent: DataFrame, axis, radii, by, id: str = "entity_id") -> DataFrame:
    """Observed mixed edges per group and radius, space joined once at the largest radius."""
    from .spatial import weighted_sites
    by = as_list(by)
    radii = sorted(float(r) for r in radii)
    nodes = axis_nodes(ent, axis)
    lig = F.col("is_lig")
    sites = weighted_sites(nodes, by, id, l=lig, r=~lig)
    p = self_pairs(sites, radii[-1], by).withColumn("radius", F.explode(F.filter(F.array(*[F.lit(r) for r in radii]), lambda r: F.col("dist2") <= r * r)))
    m = p.groupBy(*by, "radius").agg(F.sum(F.col("a_l") * F.col("b_r") + F.col("a_r") * F.col("b_l")).alias("_e"))
    own = sites.groupBy(*by).agg(F.sum("l").alias("n_lig"), F.sum("r").alias("n_rec"), F.sum(F.col("l") * F.col("r")).alias("_o"))
    grid = own.withColumn("radius", F.explode(F.array(*[F.lit(r) for r in radii])))
    return grid.join(m, [*by, "radius"], "left").select(*by, "radius", "n_lig", "n_rec", (F.col("_o") + F.coalesce("_e", F.lit(0))).alias("n_mixed_edges"))


def confidence_floors(ent: DataFrame, quantiles, by, col: str = "confidence", among=None) -> DataFrame:
    """Repeat entities per confidence floor: those at or above a quantile of the group's confidence."""
    by = as_list(by)
    src = ent if among is None else ent.where(among)
    cuts = exact_percentiles(src, by, {f"q{i}": (col, q) for i, q in enumerate(quantiles)})
    rows = F.array(*[F.struct(F.lit(float(q)).alias("conf_q"), F.col(f"q{i}").alias("_f")) for i, q in enumerate(quantiles)])
    return ent.join(cuts.select(*by, rows.alias("_r")), by).withColumn("_r", F.explode("_r")).where(F.col(col) >= F.col("_r._f")).withColumn(
        "conf_q", F.col("_r.conf_q")).drop("_r")


def radius_sensitivity(ent: DataFrame, axis, radii, conf_q, n: int, seed, by, id: str = "entity_id") -> DataFrame:
    """Observed mixed edges and their permutation p over radii and confidence floors; both parameters are columns."""
    by = as_list(by)
    classes = F.col("cell_type").isin(as_list(axis[1]) + as_list(axis[3]))
    e = durable(confidence_floors(ent.where(classes), conf_q, by))
    keys = [*by, "conf_q"]
    obs = observed_mixed(e, axis, radii, keys, id)
    null = permutation_null(e, axis, radii, n, seed, keys, id)
    p = perm_pvalue(obs, null, [*keys, "radius"])
    return obs.join(p.drop("observed"), [*keys, "radius"])


# --- bootstrap ---------------------------------------------------------------------------------------

#: Half widths of the share of a group, around its middle, whose values are told apart when medians of resamples are sought.
MIDDLES = (0.001, 0.003, 0.01, 0.03, 0.1, 0.3)


def _resamples(df: DataFrame, by, col: str, stats: list[str], n: int, seed, id: str) -> DataFrame:
    """(group, rep, one column per statistic). Values are indexed by hash rank; resample position i of replicate r takes the value at
    hash(seed, r, group, i) mod size.

    Drawn positions are shuffled once, to the values' indexes, and only sums leave that step. The rank of a resample's median among
    the group's own values has an sd of half the root of the size; values more than 12 sd away, and the error of the sketch, are only
    counted as below or above, and the job stops if a median were among them.
    """
    by = as_list(by)
    if unknown := set(stats) - {"mean", "median"}:
        raise ValueError(f"unknown statistic {', '.join(sorted(unknown))}")
    src = df.where(F.col(col).isNotNull() & ~F.isnan(col)).select(*by, F.col(id).alias("_id"), F.col(col).cast("double").alias("_v"))
    idx = hash_rank(src.withColumn("_h", hash_hex(seed, F.col("_id"))), by, "_h", "_id", "_i").withColumn("_i", F.col("_i") - 1)
    marks = [.5 + s for s in sorted((*MIDDLES, *(-s for s in MIDDLES)))]
    size = src.groupBy(*by).agg(n_rows().alias("_n"), F.percentile_approx("_v", marks, ACCURACY).alias("_q"))
    width = 6 / F.sqrt("_n") + 3.0 / ACCURACY
    edge = lambda side: F.coalesce(*[F.when(width <= s, F.col("_q")[marks.index(.5 + side * s)]) for s in MIDDLES])
    size = durable(size.select(*by, "_n", edge(-1).alias("_lo"), edge(1).alias("_hi")))
    idx = idx.join(size, by) if by else idx.join(F.broadcast(size))
    zone = F.when(F.col("_v") < F.col("_lo"), 0).when(F.col("_v") > F.col("_hi"), 2).otherwise(1)
    idx = durable(idx.select(*by, "_i", "_v", "_n", zone.alias("_z")))
    # positions are the indexes themselves: no separate sequence per group
    draw = idx.select(*by, "_i", "_n").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    draw = draw.select(*by, "rep", F.pmod(hash_int(seed, F.col("rep"), *[F.col(b) for b in by], F.col("_i")), F.col("_n")).alias("_i"))
    x = draw.join(idx.select(*by, "_i", "_v", "_z").hint("shuffle_hash"), [*by, "_i"])
    keys = [*by, "rep"]
    if "median" not in stats:
        return x.groupBy(*keys).agg(F.avg("_v").alias("mean"))
    c = x.groupBy(*keys, "_z", F.when(F.col("_z") == 1, F.col("_v")).alias("_x")).agg(n_rows().alias("_c"), F.sum("_v").alias("_s"))
    whole = W.partitionBy(*keys)
    c = c.withColumns({"_to": F.sum("_c").over(whole.orderBy("_z", "_x").rowsBetween(W.unboundedPreceding, 0)), "_at": (F.sum("_c").over(whole) - 1) * .5})
    value = lambda k: F.max(F.when((F.col("_to") > k) & (F.col("_to") - F.col("_c") <= k) & (F.col("_z") == 1), F.col("_x")))
    g = c.groupBy(*keys).agg((F.sum("_s") / F.sum("_c")).alias("mean"), value(F.floor("_at")).alias("_a"), value(F.ceil("_at")).alias("_b"), F.max("_at").alias("_at"))
    middle = F.expr("case when _a is null or _b is null then cast(raise_error('median outside its bracket') as double) else _a + (_b - _a) * (_at - floor(_at)) end")
    return g.withColumn("median", middle).select(*keys, *stats)


def bootstrap_draws(df: DataFrame, by, col: str, stat: str, n: int, seed, id: str) -> DataFrame:
    """Statistic (``mean`` or ``median``) of ``n`` resamples per group: (group, rep, stat)."""
    return _resamples(df, by, col, [stat], n, seed, id).withColumnRenamed(stat, "stat")


def bootstrap_ci(df: DataFrame, by, col: str, stat: str | list[str], n: int, seed, id: str, alpha: float = 0.05) -> DataFrame:
    """Percentile bootstrap interval per group; groups with fewer than three values get NULL bounds. A list of statistics gives a row for
    each, named in ``stat``, from the same resamples."""
    by = as_list(by)
    names = as_list(stat)
    several = [] if isinstance(stat, str) else ["stat"]
    d = _resamples(df, by, col, names, n, seed, id)
    d = d.select(*by, "rep", F.inline(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).alias("_s")) for s in names])))
    q = d.groupBy(*by, *several).agg(F.percentile("_s", F.lit(alpha / 2)).alias("ci_lo"), F.percentile("_s", F.lit(1 - alpha / 2)).alias("ci_hi"))
    size = df.where(F.col(col).isNotNull() & ~F.isnan(col)).groupBy(*by).agg(n_rows().alias("n"))
    if several:
        size = size.withColumn("stat", F.explode(F.array(*[F.lit(s) for s in names])))
    on = [*by, *several]
    keep = lambda c: F.when(F.col("n") >= 3, F.col(c)).alias(c)
    return (size.join(q, on, "left") if on else size.join(F.broadcast(q))).select(*by, *several, "n", F.lit(n).alias("n_draws"), keep("ci_lo"), keep("ci_hi"))


def ratio_ci(a: DataFrame, b: DataFrame, by, alpha: float = 0.05) -> DataFrame:
    """Interval of the ratio of two independent bootstrap series, paired by replicate number."""
    by = as_list(by)
    j = a.withColumnRenamed("stat", "_a").join(b.withColumnRenamed("stat", "_b"), [*by, "rep"]).withColumn("_r", F.col("_a") / F.when(F.col("_b") != 0, F.col("_b")))
    return j.groupBy(*by).agg(F.percentile("_r", F.lit(alpha / 2)).alias("lo"), F.percentile("_r", F.lit(1 - alpha / 2)).alias("hi"))


# --- matched-marker contrast -------------------------------------------------------------------------

def contrast_rows(stats: DataFrame, canon: dict[str, str], value: str = "pos", key: str = "entity_id", label: str = "cell_type", keep=()) -> DataFrame:
    """Per entity: values of the canonical markers in type order, their sum, the number measured, and the own index."""
    types = list(canon)
    per = stats.groupBy(key, label, *as_list(keep)).agg(F.array(*[F.max(F.when(F.col("marker") == canon[t], F.col(value))) for t in types]).alias("P"))
    code = F.create_map(*[F.lit(v) for i, t in enumerate(types) for v in (t, i)])
    return per.withColumns({
        "code": F.try_element_at(code, F.col(label)), "tot": F.aggregate("P", F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0))),
        "k": F.size(F.filter("P", lambda v: v.isNotNull()))}).where("code is not null")


def contrast_at(code: Column, head: str = "") -> Column:
    """Own value minus the mean of the other measured ones; NULL where the own value is missing. ``head`` names another array, as
    ``control_rows`` adds it."""
    own = F.get(f"{head}P", code)
    return own - (F.col(f"{head}tot") - F.coalesce(own, F.lit(0.0))) / F.greatest(F.col(f"{head}k") - 1, F.lit(1))


def matched_contrast(stats: DataFrame, canon: dict[str, str], **kw) -> DataFrame:
    r = contrast_rows(stats, canon, **kw)
    return r.where(F.col("k") >= len(canon) - 1).withColumn("delta", contrast_at(F.col("code"))).drop("P", "tot")


def identity_null(rows: DataFrame, n_types: int, n: int, seed, by, key: str = "entity_id", min_n: int = 30) -> DataFrame:
    """Observed median contrast against entities scored on a random other lineage's marker.

    ``rows`` comes from ``contrast_rows``; ``by`` may hold view, class, subset and type (or ALL) columns. The sum and
    count that do not depend on the draw are already columns, so a draw only picks one array element.
    """
    by = as_list(by)
    src = rows.where(F.col("k") >= n_types - 1)
    size = src.groupBy(*by).agg(n_rows().alias("n")).where(F.col("n") >= min_n)
    src = durable(src.join(size.select(*by), by, "left_semi").withColumn("d", contrast_at(F.col("code"))))
    other = lambda draw: F.pmod(F.col("code") + 1 + F.pmod(hash_int(seed, draw, F.col(key)), F.lit(n_types - 1)), F.lit(n_types)).cast("int")
    obs = src.groupBy(*by).agg(F.avg("d").alias("mean_delta"), F.avg((F.col("d") > 0).cast("double")).alias("frac_positive_delta"))
    med = durable(exact_percentiles(src.withColumn("_s", contrast_at(F.pmod(F.col("code") + 1, F.lit(n_types)).cast("int"))), by,
                            {"median_delta": ("d", .5), "median_delta_swapped_map": ("_s", .5)}))
    drawn = src.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("_x", contrast_at(other(F.col("draw"))))
    nul = exact_percentiles(drawn.select(*by, "draw", "_x"), [*by, "draw"], {"_m": ("_x", .5)})
    nul = nul.join(med.select(*by, "median_delta"), by).groupBy(*by).agg(
        F.percentile("_m", F.lit(.5)).alias("null_median"), F.stddev_samp("_m").alias("null_sd"),
        ((F.count_if(F.col("_m") >= F.col("median_delta")) + 1) / F.lit(n + 1)).alias("p_perm"))
    pair = src.withColumn("_v", F.explode(F.array(F.struct(F.lit("own").alias("g"), F.col("d").alias("v")),
                                                  F.struct(F.lit("null").alias("g"), contrast_at(other(F.lit(-1))).alias("v")))))
    # contrasts that are equal but for rounding must tie
    cd = cliffs_delta(pair.select(*by, "_v.g", F.round("_v.v", 9).alias("v")), by, "v", "g", "own").select(*by, F.col("delta").alias("cliffs_delta_vs_null"))
    out = reduce(lambda a, b: a.join(b, by), [size, obs, med, nul, cd])
    return out.withColumn("z_vs_null", (F.col("median_delta") - F.col("null_median")) / F.greatest("null_sd", F.lit(1e-12)))


def control_rows(stats: DataFrame, canon: dict[str, str], control: list[str], views: dict[str, str], key: str = "entity_id", label: str = "cell_type", keep=()) -> DataFrame:
    """Rows of ``contrast_rows`` for every pixel view (name -> value column), with the values of channels that carry no marker
    (autofluorescence) beside them as ``c_P``, ``c_tot`` and ``c_k``. One pass over the channel statistics; a view whose own values are
    missing keeps its row, with NULLs."""
    types, keep = list(canon), as_list(keep)
    pick = lambda markers, v: F.array(*[F.max(F.when(F.col("marker") == m, F.col(v))) for m in markers])
    per = stats.groupBy(key, label, *keep).agg(*[a for n, v in views.items() for a in (pick([canon[t] for t in types], v).alias(f"{n}__P"), pick(control, v).alias(f"{n}__C"))])
    code = F.create_map(*[F.lit(v) for i, t in enumerate(types) for v in (t, i)])
    per = per.withColumn("code", F.try_element_at(code, F.col(label))).where("code is not null")
    out = per.select(key, label, *keep, "code", F.inline(F.array(*[F.struct(F.lit(n).alias("view"), F.col(f"{n}__P").alias("P"), F.col(f"{n}__C").alias("c_P")) for n in views])))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
    known = lambda c: F.size(F.filter(c, lambda v: v.isNotNull()))
    return out.withColumns({"tot": total("P"), "k": known("P"), "c_tot": total("c_P"), "c_k": known("c_P")})


def discordant(ent: DataFrame, whole: Column, by=(), key: str = "entity_id", label: str = "cell_type") -> DataFrame:
    """(group, key, discordant): is the nearest other whole entity of another type? Entities without one have no row."""
    by = as_list(by)
    near = nearest_other(ent, ent.where(whole).withColumn("_near", F.col(label)), by, payload="_near", src_id=key, tgt_id=key)
    return ent.select(*by, key, label).join(near.select(*by, key, "_near"), [*by, key]).select(*by, key, (F.col("_near") != F.col(label)).alias("discordant"))


def identity_controls(rows: DataFrame, n_types: int, n_control: int, n: int, n_boot: int, seed, by, key: str = "entity_id", min_n: int = 30) -> DataFrame:
    """``identity_null`` with its controls, for rows of ``control_rows``: a bootstrap interval of the median contrast, the same entities
    scored on a randomly picked control channel (``median_delta_control``, ``frac_positive_control``) and on the map moved on by one type,
    Cliff's delta of both against the null draw, and Benjamini-Hochberg q over all groups.

    ``by`` holds view, class, subset and type (or ALL) columns. Groups below ``min_n`` entities have no row; entities whose own or
    control value is missing are left out of the figures that need it.
    """
    by = as_list(by)
    src = durable(rows.where(F.col("k") >= n_types - 1))
    out = durable(identity_null(src.drop("c_P", "c_tot", "c_k"), n_types, n, seed, by, key, min_n))  # a row per group, read twice
    src = src.join(out.select(*by), by, "left_semi")
    shift = F.pmod(hash_int(seed, F.lit(-1), F.col(key)), F.lit(n_types - 1))
    scored = src.select(*by, key, contrast_at(F.col("code")).alias("d"),
                        contrast_at(F.pmod(F.col("code") + 1, F.lit(n_types)).cast("int")).alias("swapped"),
                        contrast_at(F.pmod(F.col("code") + 1 + shift, F.lit(n_types)).cast("int")).alias("null"),
                        contrast_at(F.pmod(hash_int(seed, F.lit("control"), F.col(key)), F.lit(n_control)).cast("int"), "c_").alias("control"),
                        contrast_at(F.pmod(hash_int(seed, F.lit("control null"), F.col(key)), F.lit(n_control)).cast("int"), "c_").alias("control_null"))
    scored = durable(scored)
    ci = bootstrap_ci(scored, by, "d", "median", n_boot, seed, key).select(*by, "ci_lo", "ci_hi")
    mid = exact_percentiles(scored.where("control is not null").select(*by, "control"), by, {"median_delta_control": ("control", .5)})
    share = scored.groupBy(*by).agg(F.avg((F.col("control") > 0).cast("double")).alias("frac_positive_control"))

    def effect(case: str, null: str, name: str) -> DataFrame:
        pair = scored.select(*by, F.inline(F.array(F.struct(F.lit("own").alias("g"), F.round(case, 9).alias("v")), F.struct(F.lit("null").alias("g"), F.round(null, 9).alias("v")))))
        return cliffs_delta(pair.where("v is not null"), by, "v", "g", "own").select(*by, F.col("delta").alias(name))
    parts = [ci, mid, share, effect("swapped", "null", "cliffs_swapped_map"), effect("control", "control_null", "cliffs_control")]
    out = reduce(lambda a, b: a.join(b, by, "left"), parts, out)
    return bh_adjust(durable(out), "p_perm", out="q_bh")


# --- composed audits ---------------------------------------------------------------------------------

def lineage_identity(df: DataFrame, case: Column, other: Column, state: Column, by, module: str, k: int = 5, d_rare: int = 20, seed=0, rounds: int = 1,
                     id: str = "entity_id", min_case: int = 5, bins_per_decade: int = 20) -> DataFrame:
    """Does a population carry its lineage's module beyond depth? Case against depth-matched other lineages, against
    all others, and against its own lineage without the marker; positive share raw, matched and rarefied.

    ``df`` carries the columns of ``module_rate`` for ``module``.
    """
    by = as_list(by)
    df = durable(df)
    c, o, s = df.where(case), df.where(other), df.where(state)
    ok = c.groupBy(*by).agg(n_rows().alias("_n")).where(F.col("_n") >= min_case).select(*by)
    c = c.join(ok, by, "left_semi")
    pick = lambda pool: match_depth(c, pool, by, k, bins_per_decade, rounds, seed, id)
    matched = o.join(pick(o).select(*by, F.col("control_id").alias(id)), [*by, id], "left_semi")
    matched_s = s.join(pick(s).select(*by, F.col("control_id").alias(id)), [*by, id], "left_semi")
    tag = lambda d, g: d.select(*by, "n_tx", F.col(f"{module}_k").alias("k"), F.col(f"{module}_rate").alias("rate"), F.lit(g).alias("grp"))
    groups = ["case", "matched", "raw", "state"]
    rows = reduce(lambda a, b: a.unionByName(b), [tag(d, g) for d, g in zip((c, matched, o.join(ok, by, "left_semi"), matched_s), groups)])
    rows = durable(rows)
    rare = rarefied_detection(F.greatest("n_tx", F.lit(1)), F.col("k"), d_rare)
    m = lambda g, v: F.avg(F.when(F.col("grp") == g, v))
    pos = (F.col("k") > 0).cast("double")
    aggs = [x for g in groups for x in (F.count_if(F.col("grp") == g).alias(f"{g}_n"), m(g, pos).alias(f"{g}_pos"), m(g, F.col("rate")).alias(f"{g}_rate"), m(g, rare).alias(f"{g}_rare"))]
    q = exact_percentiles(rows, [*by, "grp"], {"med": ("n_tx", .5)})
    med = q.groupBy(*by).agg(*[F.max(F.when(F.col("grp") == g, F.col("med"))).alias(f"{g}_med_tx") for g in groups])
    ratio = lambda a, b: F.col(a) / F.when(F.col(b) != 0, F.col(b))
    return rows.groupBy(*by).agg(*aggs).join(med, by).withColumns({
        "ratio_raw": ratio("case_pos", "raw_pos"), "ratio_depthmatched": ratio("case_pos", "matched_pos"),
        "ratio_rarefied": ratio("case_rare", "matched_rare"), "ratio_vs_state": ratio("case_pos", "state_pos")})


def proximity_audit(ent: DataFrame, target: Column, case: Column, control: Column, by, n: int = 200, seed=0, id: str = "entity_id") -> DataFrame:
    """Nearest distance to a target class: raw, relative to all entities, and case against control, with bootstrap
    intervals of the two ratios and a rank test that the case lies closer."""
    by = as_list(by)
    d = nearest(ent, ent.where(target), by, src_id=id, tgt_id=id).select(*by, id, "dist")
    lab = ent.select(*by, id, F.when(case, "case").when(control, "control").otherwise("rest").alias("grp"))
    x = durable(d.join(lab, [*by, id]))
    both = x.withColumn("g", F.explode(F.array("grp", F.lit("all")))).where("g <> 'rest'")
    q = exact_percentiles(both, [*by, "g"], {"m": ("dist", .5)})
    p = lambda g: F.max(F.when(F.col("g") == g, F.col("m")))
    med = q.groupBy(*by).agg(p("case").alias("med_raw"), p("all").alias("med_background"), p("control").alias("med_control"))
    size = both.groupBy(*by).agg(F.count_if(F.col("g") == "case").alias("n_case"), F.count_if(F.col("g") == "control").alias("n_control"))
    boot = durable(bootstrap_draws(both, [*by, "g"], "dist", "median", n, seed, id))
    of = lambda g: boot.where(F.col("g") == g).drop("g")
    adj = ratio_ci(of("case"), of("all"), by).withColumnsRenamed({"lo": "adj_lo", "hi": "adj_hi"})
    cc = ratio_ci(of("case"), of("control"), by).withColumnsRenamed({"lo": "cc_lo", "hi": "cc_hi"})
    mw = mann_whitney(x.where("grp <> 'rest'"), by, "dist", "grp", "case", side="less").select(*by, "rank_biserial", F.col("p").alias("p_case_closer"))
    return (size.join(med, by).join(adj, by, "left").join(cc, by, "left").join(mw, by, "left")
            .withColumns({"adjusted": F.col("med_raw") / F.col("med_background"), "case_ctrl": F.col("med_raw") / F.col("med_control")}))
