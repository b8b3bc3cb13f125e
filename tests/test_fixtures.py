"""Hand-made border cases and properties."""

import math
import random

import pytest
from pyspark.sql import functions as F

from spatialframe.functions import exact_percentiles, hash_hex, hash_rank, prefix_sums, rarefied_detection, stars, take_hash_ranked
from spatialframe.operators import calls, entities, graph, pixels, resample, spatial, stats, summaries, vectors, windows
from spatialframe.sources import text


def pts(spark, rows):
    return spark.createDataFrame([("s", i, float(x), float(y)) for i, x, y in rows], "sample string, entity_id long, x double, y double")


def cloud(spark, n, seed, spread=100.0, groups=("a", "b")):
    r = random.Random(seed)
    rows = [(r.choice(groups), i, r.uniform(-spread, spread), r.uniform(-spread, spread)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "sample string, entity_id long, x double, y double")


# --- radius graph ------------------------------------------------------------------------------------

def test_radius_border_is_closed(spark):
    n = pts(spark, [(1, 0, 0), (2, 3, 4), (3, -3, -4), (4, 3, 4.0001)]).withColumn("is_lig", F.col("entity_id") == 1)
    got = {(r.a, r.b) for r in spatial.radius_pairs(n, 5.0, "sample").collect()}
    assert got == {(1, 2), (1, 3), (2, 4)}
    t = graph.graph_topology(n, 5.0, "sample", floor=1).first()
    assert (t.n_edges, t.n_mixed_edges, t.n_comp, t.largest_mixed) == (3, 2, 1, 4)


def test_no_edges(spark):
    n = pts(spark, [(1, 0, 0), (2, 100, 0)]).withColumn("is_lig", F.col("entity_id") == 1)
    t = graph.graph_topology(n, 5.0, "sample", floor=1).first()
    assert (t.n_edges, t.n_comp, t.n_mixed_comp, t.largest_comp, t.largest_mixed) == (0, 2, 0, 1, 0)


def test_too_sparse_keeps_a_row(spark):
    n = pts(spark, [(i, i, 0) for i in range(14)]).withColumn("is_lig", F.col("entity_id") < 4)
    t = graph.graph_topology(n, 5.0, "sample").first()
    assert (t.n_lig, t.n_rec, t.status, t.n_edges) == (4, 10, "too_sparse", None)


@pytest.mark.parametrize("hot", [20_000, 3])
def test_pairs_match_brute_force(spark, hot):
    rows, df = cloud(spark, 250, 1, 40)
    want = {(min(a[1], b[1]), max(a[1], b[1])) for a in rows for b in rows if a[1] < b[1] and a[0] == b[0]
            and (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= 64}
    p = spatial.self_pairs(df, 8.0, "sample", "entity_id", hot=hot)
    got = [(min(r.a_entity_id, r.b_entity_id), max(r.a_entity_id, r.b_entity_id)) for r in p.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_many_copies_of_one_point(spark):
    # a third of all points lie on one spot: counted by weights, not by pairs
    rows = [(i, 0, 0) for i in range(300)] + [(300 + i, 3 * i, 50) for i in range(600)]
    n = pts(spark, rows).withColumn("is_lig", F.col("entity_id") % 3 == 0)
    t = graph.graph_topology(n, 2.0, "sample", floor=1).first()
    assert t.n_edges == 300 * 299 // 2 and t.n_mixed_edges == 100 * 200 and t.n_comp == 601
    assert spatial.radius_join(n, n, 2.0, "sample").first().n_pairs == 300 * 300 + 600


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "src long, dst long")
    n = spark.createDataFrame([(i,) for i in (1, 2, 3, 5, 6, 9)], "node long")
    got = {r.node: r.component for r in graph.connected_components(e, n).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 9: 9}


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(400)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    e = spark.createDataFrame(path + star, "src long, dst long")
    n = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    got = {(r.component, r["count"]) for r in graph.connected_components(e, n).groupBy("component").count().collect()}
    assert got == {(0, 401), (1000, 300)}


# --- nearest -----------------------------------------------------------------------------------------

@pytest.mark.parametrize("cell", [None, 1.0, 400.0])
def test_nearest_matches_brute_force(spark, cell):
    a, da = cloud(spark, 120, 2, 100)
    b, db = cloud(spark, 40, 3, 100)
    # a crowd far away from everything, and sources next to nothing
    far = [("a", 500 + i, 2000 + (i % 7) * 0.1, 2000 + (i // 7) * 0.1) for i in range(60)]
    db = db.union(spark.createDataFrame(far, db.schema))
    b = b + far
    got = {r.entity_id: (r.nearest_id, r.dist) for r in spatial.nearest(da, db, "sample", cell=cell).collect()}
    for g, i, x, y in a:
        d, t = min((math.dist((x, y), (q[2], q[3])), q[1]) for q in b if q[0] == g)
        assert got[i][0] == t and abs(got[i][1] - d) < 1e-9


def test_nearest_other_skips_itself_and_breaks_ties_by_id(spark):
    d = pts(spark, [(7, 0, 0), (5, 0, 0), (9, 0, 0), (1, 50, 50)])
    got = {r.entity_id: (r.nearest_id, round(r.dist, 3)) for r in spatial.nearest_other(d, d, "sample").collect()}
    assert got == {7: (5, 0.0), 5: (7, 0.0), 9: (5, 0.0), 1: (5, 70.711)}


def test_nearest_without_targets_is_empty(spark):
    d = pts(spark, [(1, 0, 0)])
    assert spatial.nearest(d, d.where("false"), "sample").count() == 0
    assert spatial.nearest_within(d, d, "sample", 25.0, exclude_self=True).count() == 0


def test_nearest_over_one_group_and_one_point(spark):
    d = pts(spark, [(1, 0, 0), (2, 3, 4)])
    got = {r.entity_id: r.nearest_id for r in spatial.nearest(d, d, [], exclude_self=True).collect()}
    assert got == {1: 2, 2: 1}
    assert spatial.nearest(d.where("entity_id = 1"), d.where("entity_id = 1"), [], exclude_self=True).count() == 0


def test_file_digest(spark, tmp_path):
    import hashlib
    from spatialframe.sources.tables import file_digests
    (tmp_path / "a.bin").write_bytes(b"abc")
    assert file_digests(spark, str(tmp_path / "a.bin")).first().sha256 == hashlib.sha256(b"abc").hexdigest()


# --- statistics --------------------------------------------------------------------------------------

def test_perm_pvalue(spark):
    draws = spark.createDataFrame([("s", float(i)) for i in range(1, 10)], "g string, n_mixed_edges double")
    obs = spark.createDataFrame([("s", 7.0)], "g string, n_mixed_edges double")
    assert resample.perm_pvalue(obs, draws, "g").first().p == 0.4
    assert resample.perm_pvalue(obs.withColumn("n_mixed_edges", F.lit(99.0)), draws, "g").first().p == 0.1


def test_bh(spark):
    d = spark.createDataFrame([(1, .01), (2, .04), (3, .03), (4, None)], "i int, p double")
    got = {r.i: r.q for r in stats.bh_adjust(d, "p").collect()}
    assert got[1] == pytest.approx(.03) and got[2] == pytest.approx(.04) and got[3] == pytest.approx(.04) and got[4] is None


def test_signflip(spark):
    d = spark.createDataFrame([("g", 1.0)] * 6, "g string, d double")
    assert stats.signflip_exact(d, "g", "d").first().p == 2 / 64


def test_exact_u_is_the_count_of_all_splits(spark):
    import itertools
    from spatialframe.functions.tails import u_counts
    for m, n in itertools.product(range(1, 7), range(1, 7)):
        want = [0] * (m * n + 1)
        for side in itertools.combinations(range(m + n), m):
            want[sum(a > b for a in side for b in set(range(m + n)) - set(side))] += 1
        assert u_counts(m, n).tolist() == want
    import math
    assert int(u_counts(8, 2000).sum()) == math.comb(2008, 8)                    # beyond 64 bits
    rows = [("few", "a", v) for v in (5.0, 7.0, 9.0)] + [("few", "b", v) for v in (1.0, 6.0, 2.0, 8.0)] + [("tied", "a", 1.0), ("tied", "b", 1.0), ("tied", "b", 2.0), ("one", "a", 1.0)]
    rows += [("wide", "a", float(i)) for i in range(9)] + [("wide", "b", i + 0.5) for i in range(9)]
    d = spark.createDataFrame(rows, "k string, g string, v double")
    for side in ("greater", "less"):
        got = {x.k: x for x in stats.mann_whitney(d, "k", "v", "g", "a", side).collect()}
        c = u_counts(3, 4)
        want = c[9:].sum() if side == "greater" else c[:10].sum()
        assert got["few"].u == 9 and got["few"].p == want / 35 and got["few"].method == "exact"
        assert got["tied"].method == got["wide"].method == "asymptotic" and 0 < got["wide"].p < 1 and got["one"].p is None


def test_signflip_halves_are_the_enumeration(spark):
    import itertools
    r = random.Random(3)
    sets = [[float(r.randint(-3, 3)) for _ in range(n)] for n in range(1, 17)] + [[r.gauss(0.5, 1) for _ in range(n)] for n in (5, 12, 15)] + [[0.1] * 9, [0.0] * 4]
    from spatialframe.functions.tails import _flip_p
    for v in sets:
        sums = [abs(sum(x * s for x, s in zip(v, signs))) for signs in itertools.product((1, -1), repeat=len(v))]
        assert _flip_p(v) == sum(s >= abs(sum(v)) - 1e-12 * len(v) for s in sums) / len(sums)
    d = spark.createDataFrame([("forty", 1.0)] * 40 + [("seventeen", 1.0)] * 17 + [("over", 1.0)] * 41, "g string, d double")
    assert {x.g: (x.n, x.p) for x in stats.signflip_exact(d, "g", "d").collect()} == {"forty": (40, 2.0 ** -39), "seventeen": (17, 2.0 ** -16), "over": (41, None)}


def test_kendall_is_the_count_of_pairs(spark):
    r = random.Random(8)
    rows = [("a", float(r.randint(0, 40)), float(r.randint(0, 30))) for _ in range(150)] + [("b", float(i), float(i * i)) for i in range(40)] + [("flat", 1.0, float(i)) for i in range(3)] + [("c", 1.0, None), ("c", 2.0, 1.0), ("a", float("nan"), 1.0)]
    got = {x.g: x for x in stats.rank_correlation(spark.createDataFrame(rows, "g string, x double, y double"), "x", "y", "kendall", "g").collect()}
    sign = lambda v: (v > 0) - (v < 0)
    own = [(x, y) for g, x, y in rows if g == "a" and x == x]
    pairs = [(sign(p[0] - q[0]), sign(p[1] - q[1])) for i, p in enumerate(own) for q in own[:i]]
    want = sum(a * b for a, b in pairs) / (sum(a != 0 for a, _ in pairs) * sum(b != 0 for _, b in pairs)) ** 0.5
    assert got["a"].kendall == pytest.approx(want, abs=1e-12) and got["a"].n == 150 and got["b"].kendall == 1 and got["flat"].kendall is None and got["c"].kendall is None


def test_ranks_agree_with_each_other(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 2.0)], "g string, v double")
    assert stats.cliffs_delta(d, [], "v", "g", "a").first().delta == 0
    r = random.Random(5)
    e = spark.createDataFrame([(r.choice("ab"), float(r.randint(0, 9))) for _ in range(80)], "g string, v double")
    x, y = [stats.cliffs_delta(e, [], "v", "g", k).first().delta for k in "ab"]
    assert x == pytest.approx(-y)
    assert stats.auroc(e, "v", F.col("g") == "a").first().auroc == pytest.approx((x + 1) / 2)
    m = stats.mann_whitney(e, [], "v", "g", "a").first()
    assert x == pytest.approx(2 * m.u / (m.n_a * m.n_b) - 1) and 0 < m.p < 1


def test_tails(spark):
    d = spark.createDataFrame([("g", 1.0)] * 9 + [("g", -1.0)], "g string, v double")
    assert stats.sign_test(d, "g", "v").first().p == pytest.approx(2 * 11 / 1024)
    from spatialframe.functions.tails import normal_isf, normal_sf, t_quantile
    r = spark.range(1).select(normal_sf(F.lit(1.959963984540054)).alias("a"), normal_isf(F.lit(0.025)).alias("b"), t_quantile(F.lit(0.975), F.lit(5.0)).alias("c")).first()
    assert r.a == pytest.approx(0.025) and r.b == pytest.approx(1.959964, abs=1e-6) and r.c == pytest.approx(2.570582, abs=1e-6)


def test_cohort_meta(spark):
    d = spark.createDataFrame([(2.0, .01), (4.0, .2), (1.0, .5)], "enrich double, p double")
    r = stats.cohort_meta(d, "enrich", "p").first()
    assert r.n_units == 3 and r.fold == pytest.approx(2.0) and r.n_enrich_gt1 == 2 and r.ci_lo < r.mean_log2 < r.ci_hi


def test_rarefaction_and_stars(spark):
    cases = [(10, 10, 5, 1.0), (4, 2, 5, 0.0), (10, 0, 5, 0.0), (10, 3, 1, .3)]
    for n, k, d, want in cases:
        assert spark.range(1).select(rarefied_detection(F.lit(n), F.lit(k), d).alias("p")).first().p == pytest.approx(want)
    got = spark.createDataFrame([(5e-4,), (.04,), (.5,), (float("nan"),), (None,)], "p double").select(stars(F.col("p")).alias("s"))
    assert [r.s for r in got.collect()] == ["***", "*", "ns", "ns", "ns"]


# --- order statistics over skewed groups -------------------------------------------------------------

def test_percentiles_match_the_builtin(spark):
    r = random.Random(8)
    rows = [(g, r.choice([r.gauss(0, 1), 7.0, float(r.randint(0, 3))])) for g, n in (("big", 30_000), ("one", 1), ("two", 2), ("mid", 500)) for _ in range(n)]
    d = spark.createDataFrame(rows, "g string, v double").repartition(8)
    specs = {f"p{i}": ("v", p) for i, p in enumerate((0.0, .002, .1, .5, .75, .998, 1.0))}
    want = d.groupBy("g").agg(*[F.percentile("v", F.lit(p)).alias(k) for k, (_, p) in specs.items()])
    a, b = [{x.g: x.asDict() for x in t.collect()} for t in (exact_percentiles(d, "g", specs), want)]
    assert a.keys() == b.keys()
    for g in a:
        for k in specs:
            assert a[g][k] == pytest.approx(b[g][k], abs=1e-12), (g, k)


def test_prefix_sums_and_hash_ranks(spark):
    d = spark.range(500).select((F.col("id") % 2).alias("g"), (F.col("id") * F.col("id")).cast("double").alias("v"), F.col("id"))
    got = prefix_sums(d.withColumn("one", F.lit(1)), "g", "v", {"before": "one"}).orderBy("id").collect()
    assert all(r.before == r.id // 2 for r in got)
    h = hash_rank(d.withColumn("hx", hash_hex(1, F.col("id"))), "g", "hx", "id", "rk").collect()
    for g in (0, 1):
        mine = sorted((r.hx, r.id, r.rk) for r in h if r.g == g)
        assert [m[2] for m in mine] == list(range(1, 251))
    t = take_hash_ranked(d.withColumns({"hx": hash_hex(1, F.col("id")), "n": F.lit(37)}), "g", "hx", "id", "n").collect()
    assert {r.id for r in t} == {r.id for r in h if r.rk <= 37}


def test_results_do_not_depend_on_partitions(spark):
    _, d = cloud(spark, 300, 4)
    d = d.withColumns({"lig": (F.col("entity_id") % 3 == 0).cast("int"), "rec": F.lit(1), "cell_type": F.when(F.col("entity_id") % 2 == 0, "TAM").otherwise("T")})
    seen = set()
    for n in (1, 4, 50):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        t = resample.permutation_null(d.repartition(n), ("lig", "TAM", "rec", "T"), 15.0, 5, 1, "sample")
        seen.add(tuple(sorted(map(tuple, t.collect()))))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(seen) == 1


def test_permutation_mean_is_the_exact_expectation(spark):
    _, d = cloud(spark, 200, 6, 30, ("a",))
    d = d.withColumns({"cell_type": F.when(F.col("entity_id") < 100, "TAM").otherwise("T"), "lig": (F.col("entity_id") % 4 == 0).cast("int"), "rec": (F.col("entity_id") % 2 == 0).cast("int")})
    draws = resample.permutation_null(d, ("lig", "TAM", "rec", "T"), 10.0, 300, 2, "sample")
    lo, hi = d.where("cell_type='TAM'"), d.where("cell_type='T'")
    edges = spatial.radius_join(lo, hi, 10.0, "sample").first().n_pairs
    m = draws.agg(F.avg("n_mixed_edges").alias("m"), F.stddev("n_mixed_edges").alias("s")).first()
    assert abs(m.m - edges * .25 * .5) < 4 * m.s / math.sqrt(300)


def test_full_null_agrees_with_the_plain_one(spark):
    _, d = cloud(spark, 150, 9, 30, ("a",))
    d = d.withColumns({"cell_type": F.when(F.col("entity_id") < 70, "TAM").otherwise("T"), "lig": (F.col("entity_id") % 3 == 0).cast("int"), "rec": (F.col("entity_id") % 2 == 0).cast("int")})
    ax = ("lig", "TAM", "rec", "T")
    a = {r.draw: r.n_mixed_edges for r in resample.permutation_null(d, ax, 8.0, 4, 3, "sample").collect()}
    b = {r.draw: r.n_mixed_edges for r in resample.permutation_null(d, ax, 8.0, 4, 3, "sample", full=True).collect()}
    assert a == b and sum(a.values()) > 0


def test_permutation_null_with_many_members_at_one_place(spark):
    """Sites of several members need more than one binary digit; two radii and two grouping columns, one of them text."""
    r = random.Random(12)
    rows = [(i, "s'1" if i % 5 else "s 2", i % 2, float(r.randrange(4)) * 3, float(r.randrange(3)) * 3, "TAM" if r.random() < .5 else "T", int(r.random() < .6), int(r.random() < .7))
            for i in range(400)]
    d = spark.createDataFrame(rows, "entity_id int, sample string, part int, x double, y double, cell_type string, lig int, rec int")
    ax, by, radii = ("lig", "TAM", "rec", "T"), ["sample", "part"], [3.0, 6.5]
    plain = {(x.sample, x.part, x.radius, x.draw): x.n_mixed_edges for x in resample.permutation_null(d, ax, radii, 11, 3, by).collect()}
    full = {(x.sample, x.part, x.radius, x.draw): x.n_mixed_edges for x in resample.permutation_null(d, ax, radii, 11, 3, by, full=True).collect()}
    assert plain == full and len(plain) == 2 * 2 * 2 * 11 and min(plain.values()) > 0
    # all members carry their marker: every draw is the observed count
    e = d.withColumns({"lig": F.lit(1), "rec": F.lit(1)})
    for q in radii:
        want = {}
        for a in rows:
            for b in rows:
                if a[1:3] == b[1:3] and a[5] == "TAM" and b[5] == "T" and (a[3] - b[3]) ** 2 + (a[4] - b[4]) ** 2 <= q * q:
                    want[a[1:3]] = want.get(a[1:3], 0) + 1
        got = {(x.sample, x.part, x.draw): x.n_mixed_edges for x in resample.permutation_null(e, ax, q, 3, 5, by).collect()}
        assert got == {(*k, t): v for k, v in want.items() for t in range(3)}


def test_matching_is_without_replacement_and_close(spark):
    r = random.Random(7)
    case = spark.createDataFrame([("s", i, r.randint(5, 400)) for i in range(30)], "sample string, entity_id long, n_tx int")
    ctrl = spark.createDataFrame([("s", 1000 + i, r.randint(5, 400)) for i in range(400)], "sample string, entity_id long, n_tx int")
    m = resample.match_depth(case, ctrl, "sample", 5, 10, rounds=2, seed=1)
    rows = m.collect()
    assert len({x.control_id for x in rows}) == len(rows) and len({(x.case_id, x.slot) for x in rows}) == len(rows)
    depth = {x.entity_id: x.n_tx for x in case.union(ctrl).collect()}
    step = lambda n: math.floor(math.log10(n) * 10)
    assert all(step(depth[x.control_id]) - step(depth[x.case_id]) == x.bin_shift for x in rows)
    s = resample.match_shortfall(case, m, "sample", 5).first()
    assert s.n_wanted == 150 and s.n_matched == len(rows)


# --- summaries ---------------------------------------------------------------------------------------

def test_fate(spark):
    rows = [(0, 0, "a", "a"), (0, 0, "a", "b"), (3, 1, None, "c"), (3, 0, None, "a"), (0, 3, "a", None)]
    m = spark.createDataFrame(rows, "etype_at_input int, etype_at_finalize int, entity_id string, owner_out string")
    f = {r.quantity: r.n for r in summaries.molecule_fate(m).collect()}
    assert (f["kept_in_place"], f["redistributed"], f["recovered_from_unassigned"], f["unassigned_to_partial"], f["unassigned_to_cell"], f["lost_to_unassigned"]) == (1, 1, 2, 1, 1, 1)


def test_pooling(spark):
    d = spark.createDataFrame([("t", "w", .2, 10), ("t", "p", .8, 30), ("u", "w", .5, 4)], "g string, s string, e double, n int")
    rows = summaries.pool_weighted(d, "g", "s", "e", "n").collect()
    assert len(rows) == 1 and rows[0].e == pytest.approx(.65)


def test_axis_category(spark):
    d = spark.createDataFrame([(True, True, True, 10, 20), (True, True, True, 10, 19), (False, True, True, 0, 20), (False, False, True, 0, 0),
                               (True, False, False, 9, 0), (None, None, None, None, None)], "pre boolean, post_whole boolean, post_all boolean, anchor_pre int, anchor_whole int")
    got = [r.category for r in entities.classify_axis(d).collect()]
    assert got == ["strengthened post", "visible pre", "enabled post-whole", "enabled by partials", "visible pre", "unsupported"]


def test_histogram_edge(spark):
    d = spark.createDataFrame([(0.0,), (299.0,), (300.0,), (301.0,)], "v double")
    got = {r.bin: r.n for r in summaries.histogram(d, [], "v", [0.0, 100.0, 200.0, 300.0]).collect()}
    assert got == {0: 1, 2: 2}


def test_label_rules(spark):
    labels = ["bT cells", "tNeutrophils", "bMonoDC2", "tMono1", "bN3", "Patient 4-specific", "CD8 T", "bpDC", "  ", None, "Plasma cells", "MoMacDC", "Club cells", "ND"]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i int, l string")
    got = [(r.fine, r.coarse) for r in entities.harmonize_rules(d, "l", entities.RULES["lung"]()).orderBy("i").collect()]
    assert got == [("T cells", "T cells"), ("tNeutrophils", "neutrophil"), ("bMonoDC2", "DC"), ("tMono1", "monocyte"), ("bN3", "neutrophil"), ("malignant", "malignant"),
                   ("CD8 T", "T cells"), ("pDC", "DC"), ("unknown", "unknown"), ("unknown", "unknown"), ("plasma", "plasma"), ("macrophage", "macrophage"), ("epithelial", "epithelial"), ("unknown", "unknown")]


@pytest.mark.parametrize("call", [
    lambda d: entities.harmonize_strict(d, "l", {"a": "A"}), lambda d: entities.stratum_map(d, "l", {"a": "A"}),
    lambda d: windows.shared_features(d.withColumnRenamed("l", "feature"), d.withColumnRenamed("l", "feature")),
    lambda d: calls.tidy_metrics(d.select(F.lit("m").alias("method"), F.lit("k").alias("metric"), F.length("l").cast("double").alias("value"), F.lit("s").alias("setting")), ["k"])])
def test_broken_contracts_stop_the_job(spark, call):
    d = spark.createDataFrame([("a",), ("zz",)], "l string")
    with pytest.raises(Exception):
        call(d).collect()


# --- pixels and vectors ------------------------------------------------------------------------------

def test_pedestal_tie_takes_the_smallest(spark):
    px = spark.createDataFrame([("m", 1, i, v) for i, v in enumerate((99, 99, 100, 100, 101))], "marker string, row int, col int, value int")
    t = pixels.calibrate_threshold(px, px.select("row", "col")).first()
    assert t.pedestal == 99 and t.thr == pytest.approx(1.96)


def test_signflip_large_group_leaves_the_others_alone(spark):
    d = spark.createDataFrame([("few", float(i)) for i in range(1, 7)] + [("many", 1.0)] * 500 + [(None, 2.0)], "g string, d double")
    assert {x.g: (x.n, x.p) for x in stats.signflip_exact(d, "g", "d").collect()} == {"few": (6, 2 / 64), "many": (500, None), None: (1, 1.0)}
    assert stats.signflip_exact(d.where("g = 'few'"), [], "d").first().p == 2 / 64


def test_binomial_tail_is_exact_for_any_n():
    from spatialframe.functions.tails import _binom_two_sided
    for n in (1, 2, 3, 10, 51, 400, 20_001):
        for k in {0, 1, n // 3, n // 2 - 1, n // 2, n - 1, n} & set(range(n + 1)):
            if n > 400 and abs(2 * k - n) > 600:
                continue
            tail = sum(math.comb(n, i) for i in range(min(k, n - k) + 1)) if n <= 400 else None
            if tail is None:  # from the middle outwards, in whole numbers
                half, c = 1 << (n - 1), math.comb(n, n // 2)
                for i in range(n // 2, min(k, n - k), -1):
                    half, c = half - c, c * i // (n - i + 1)
                tail = half
            assert _binom_two_sided(k, n) == pytest.approx(min(1.0, (2 * tail << 60) // (1 << n) / 2 ** 60 if n > 400 else 2 * tail / 2 ** n), rel=1e-9)
    # far beyond 4,000 terms the normal tail with continuity correction agrees
    assert _binom_two_sided(5 * 10 ** 7 - 5000, 10 ** 8) == pytest.approx(math.erfc((9999 / 1e4) / math.sqrt(2)), rel=1e-6)


def test_shared_embedding_fits_all_rows_with_equal_arms(spark):
    import numpy as np
    g = np.random.default_rng(5)
    x = {"a": g.normal(0, 1, (60, 5)) * [3, 1, 1, .5, 0], "b": g.normal(1, 2, (900, 5)) * [1, 1, 4, .5, 0]}
    rows = [(f"{a}{i}", a, v.tolist()) for a, m in x.items() for i, v in enumerate(m)] + [("none", "a", None)]
    d = spark.createDataFrame(rows, "id string, arm string, vector array<double>").repartition(5)
    got = {r.id: r.pcs for r in vectors.shared_embedding(d, 3, lognorm=False).collect()}
    assert len(got) == 961 and got["none"] is None
    mean = (x["a"].mean(0) + x["b"].mean(0)) / 2
    var = sum((m ** 2).mean(0) for m in x.values()) / 2 - mean ** 2
    unit = {a: np.clip((m - mean) / np.where(var >= 1e-12, np.sqrt(var), 1), -10, 10) for a, m in x.items()}
    c = sum(u.mean(0) for u in unit.values()) / 2
    load = np.linalg.eigh(sum(u.T @ u / len(u) for u in unit.values()) / 2 - np.outer(c, c))[1][:, ::-1][:, :3]
    load *= np.sign(load[np.abs(load).argmax(0), range(3)])
    for a, u in unit.items():
        assert np.allclose([got[f"{a}{i}"] for i in range(len(u))], u @ load, atol=1e-6)


def test_wide_embedding_agrees_with_the_exact_fit(spark):
    import numpy as np
    g = np.random.default_rng(8)
    mix = g.normal(size=(64, 64)) * np.linspace(3, .2, 64)[:, None]
    rows = [(f"{a}{i}", a, g.poisson(np.exp(np.clip(z @ mix / 12, -4, 4))).astype(float).tolist()) for a, n in (("a", 120), (None, 500), ("c", 90)) for i, z in enumerate(g.normal(size=(n, 64)))]
    rows += [("none", "a", None)]
    d = spark.createDataFrame(rows, "id string, arm string, vector array<double>").repartition(4)
    exact = {x.id: x.pcs for x in vectors.shared_embedding(d, 6).collect()}
    wide = {x.id: x.pcs for x in vectors.wide_embedding(d, 6, extra=4, max_blocks=3).collect()}  # the basis is cut back on the way
    assert exact.keys() == wide.keys() and wide["none"] is None
    assert np.allclose([exact[i] for i in exact if i != "none"], [wide[i] for i in exact if i != "none"], atol=1e-6)


def test_wide_embedding_border_cases(spark):
    import numpy as np
    kind = "id int, arm string, vector array<double>, extra string"
    odd = spark.createDataFrame([(1, "a", [1.0, 2.0], "x"), (2, "a", [2.0, 1.0], "x"), (3, "b", [0.0, 5.0], "x"), (3, "b", [0.0, 5.0], "x"), (4, None, [1.0, None], "x"),
                                 (5, "b", [float("nan"), 1.0], "x"), (6, "a", None, "x")], kind)
    got = sorted((x.id, x.arm, x.pcs is None, len(x.pcs or [])) for x in vectors.wide_embedding(odd, 5, lognorm=False).collect() if x.arm)
    assert got == [(1, "a", False, 2), (2, "a", False, 2), (3, "b", False, 2), (3, "b", False, 2), (5, "b", True, 0), (6, "a", True, 0)]
    assert vectors.wide_embedding(odd.where("id = 4"), 2).first().pcs is None
    assert vectors.wide_embedding(odd.where("false"), 2).count() == 0
    assert vectors.wide_embedding(odd.where("id = 3"), 1, lognorm=False).first().pcs == [0.0]  # no variance at all
    with pytest.raises(ValueError):
        vectors.wide_embedding(spark.createDataFrame([(1, "a", [1.0, 2.0], ""), (2, "a", [1.0], "")], kind), 1)


def test_mask_distance_is_exact(spark):
    r = random.Random(3)
    grid = spark.range(31 * 61).select((F.col("id") / 61).cast("int").alias("row"), (F.col("id") % 61).cast("int").alias("col"), F.lit("x").alias("tag"))
    spots = {(r.randint(0, 30), r.randint(0, 60)) for _ in range(12)}
    corner = {(0, 0), (0, 1), (5, 0)}                   # pixels 60 steps away
    outside = {(-9, 70), (40, 3)}                       # a mask beyond the grid counts too
    for mask in (spots, corner, outside, spots | outside):
        got = pixels.mask_distance(grid, spark.createDataFrame(list(mask), "row int, col int")).collect()
        assert len(got) == 31 * 61
        for x in got:
            assert x.dist == pytest.approx(min(math.dist((x.row, x.col), m) for m in mask)) and x.tag == "x"


def test_mask_distance_without_mask_or_place(spark):
    grid = spark.createDataFrame([(0, 0), (None, 1), (2, None), (2, 2)], "row int, col int")
    empty = spark.createDataFrame([], "row int, col int")
    assert {x.dist for x in pixels.mask_distance(grid, empty).collect()} == {None}
    got = {(x.row, x.col): x.dist for x in pixels.mask_distance(grid, spark.createDataFrame([(2, 5)], "row int, col int")).collect()}
    assert got == {(0, 0): pytest.approx(math.sqrt(29)), (None, 1): None, (2, None): None, (2, 2): 3.0}
    assert pixels.mask_distance(empty, grid).count() == 0


def test_footprint_pixels_without_distance_stay(spark):
    foot = spark.createDataFrame([("a", 0, 0), ("a", 0, 1), ("b", 9, 9)], "entity_id string, row int, col int")
    dist = spark.createDataFrame([(0, 0, 3.0)], "row int, col int, dist double")
    got = {x.entity_id: (x.n_px, x.n_px_far, x.dist_max) for x in pixels.footprint_stats(foot, dist).collect()}
    assert got == {"a": (2, 1, 3.0), "b": (1, 0, None)}


def test_feature_knn_matches_brute_force(spark):
    r = random.Random(11)
    vec = [[r.gauss(c, .2) for c in ((i % 4) * 3, 0, 1)] for i in range(300)] + [[5.0, 5.0, 5.0]] * 60  # and many copies
    d = spark.createDataFrame(list(enumerate(vec)), "id long, vector array<double>")
    got = {}
    for x in vectors.feature_knn(d, 4).collect():
        got.setdefault(x.id, {})[x.rank] = x.neighbor_id
    for i, v in enumerate(vec):
        want = [j for _, j in sorted((sum((a - b) ** 2 for a, b in zip(v, w)), j) for j, w in enumerate(vec) if j != i)[:4]]
        assert [got[i][k] for k in (1, 2, 3, 4)] == want


def test_hull(spark):
    r = random.Random(2)
    rows = [(1, float(r.randint(0, 50)), float(r.randint(0, 50))) for _ in range(3000)] + [(1, -1.0, -1.0), (1, 51.0, -1.0), (1, 51.0, 51.0), (1, -1.0, 51.0)]
    rows += [(2, 0.0, 0.0), (2, 1.0, 1.0), (2, 2.0, 2.0), (3, 0.0, 0.0), (3, 4.0, 0.0), (3, 0.0, 3.0)]
    h = spatial.polygon_area(spatial.convex_footprint(spark.createDataFrame(rows, "entity_id long, x double, y double")))
    assert {x.entity_id: (x.area, x.n_vertices) for x in h.collect()} == {1: (52 * 52, 4), 3: (6.0, 3)}


def test_specificity_p_and_q(spark):
    rows = [("cell", "T", m, i, 20, (0.5 if m == "A" else 0.1) + 0.01 * (i % 3), None) for m in "AB" for i in range(40)]
    st = spark.createDataFrame(rows, "entity_class string, cell_type string, marker string, entity_id long, n_px long, pos double, pos_far double")
    nul = spark.createDataFrame([(m, s, "T", 0.1 + 0.01 * s, 0.1) for m in "AB" for s in range(3)], "marker string, shift int, cell_type string, pos_frac double, pos_frac_far double")
    got = {r.marker: r for r in pixels.specificity_matrix(st, nul, canon={"T": "A"}).collect()}
    assert got["A"].p_z < 1e-6 and got["A"].q_bh >= got["A"].p_z and got["B"].p_z > 0.5 and got["A"].is_canonical and not got["B"].is_canonical


def test_wide_text_headers_and_bad_lines(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("gene\tc1\tc2\nG1|x\t1\t0\ngene\t2\t\n")
    (tmp_path / "b.tsv").write_text("gene\tc3\nG1\t5\n")
    rows = lambda **kw: sorted(tuple(r) for r in text.wide_text_to_long(spark, str(tmp_path), **kw).collect())
    want = [("c1", "G1", 1.0), ("c1", "gene", 2.0), ("c3", "G1", 5.0)]
    assert rows() == want
    (tmp_path / "c.tsv").write_text("gene\tc4\nG1\t5\t6\nG2\tword\n")
    with pytest.raises(Exception, match="another width|no number"):
        rows()
    assert rows(skip_bad=True) == want
