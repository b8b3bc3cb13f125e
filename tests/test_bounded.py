"""Operators whose intermediate tables must not outgrow the input."""

from __future__ import annotations

import hashlib
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from spatialframe.functions import ordering
from spatialframe.functions.durable import durable
from spatialframe.operators import graph, resample, vectors
from spatialframe.sources import text


def counted(monkeypatch, module):
    """Rows of every table the operators of ``module`` write."""
    rows, real = [], module.durable

    def keep(df):
        out = real(df)
        rows.append(out.count())
        return out
    monkeypatch.setattr(module, "durable", keep)
    return rows


def test_knn_carries_each_point_once(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(600, 12))
    v[500:] = v[:1]  # a large group of copies: ties go to the smallest id
    v *= 1e4  # rounding of squares follows the length
    monkeypatch.setattr(vectors, "SHELF_ROWS", 0)  # shelves of 256 points, the group of copies among them
    rows = counted(monkeypatch, vectors)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>").repartition(3)
    got = {}
    for r in vectors.feature_knn(df, 4).collect():
        got.setdefault(r.id, {})[r["rank"]] = (r.neighbor_id, round(r.dist, 6))
    assert max(rows) <= len(v)  # nothing can be ruled out here, and still no point is written once per cell
    for i in range(len(v)):
        d = np.sqrt(((v - v[i]) ** 2).sum(1))
        best = sorted((x, j) for j, x in enumerate(d) if j != i)[:4]
        assert [got[i][k] for k in (1, 2, 3, 4)] == [(j, round(x, 6)) for x, j in best], i


def test_resamples_write_the_group_and_not_the_draws(spark, monkeypatch):
    """Mean and median from the same resamples, equal to the draws redone by hand; no table has a row per draw."""
    values = {"a": [float(i * i % 97) for i in range(700)], "b": [float("nan"), 2.0, 5.0, 1.0], "c": [7.0], "d": [3.0] * 2500}
    rows = counted(monkeypatch, resample)
    rows_of = [(g, f"{g}{i}", v) for g, vs in values.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows_of, "g string, id string, v double").repartition(3)
    h = lambda *parts: int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)
    want = {}
    for g, vs in values.items():
        order = sorted((hashlib.md5(f"8|{g}{i}".encode()).hexdigest(), f"{g}{i}", v) for i, v in enumerate(vs) if v == v)
        for rep in range(6):
            drawn = [order[h(8, rep, g, i) % len(order)][2] for i in range(len(order))]
            want[g, rep] = (statistics.fmean(drawn), statistics.median(drawn))
    for k, stat in enumerate(("mean", "median")):
        got = {(r.g, r.rep): r.stat for r in resample.bootstrap_draws(df, "g", "v", stat, 6, 8, "id").collect()}
        assert got == {key: pytest.approx(w[k]) for key, w in want.items()}
    ci = {(r.g, r.stat): (r.n, r.ci_lo is None) for r in resample.bootstrap_ci(df, "g", "v", ["mean", "median"], 6, 8, "id").collect()}
    assert ci == {(g, s): (n, n < 3) for g, n in (("a", 700), ("b", 3), ("c", 1), ("d", 2500)) for s in ("mean", "median")}
    assert max(rows) <= len(rows_of)


def test_percentiles_never_broadcast_the_values(spark):
    """The values come from a small file and are many times larger in memory; what goes to every executor is one row per group."""
    src = durable(spark.range(60_000).select((F.col("id") % 3).cast("string").alias("g"), (F.col("id") % 5).cast("double").alias("v")))
    q = ordering.exact_percentiles(src, "g", {"m": ("v", .5)})
    assert {r.g: r.m for r in q.collect()} == {"0": 2.0, "1": 2.0, "2": 2.0}
    sizes, todo = [], [q._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if node.nodeName() == "BroadcastExchange":
            sizes.append(node.metrics().apply("numOutputRows").value())
        if node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    assert sizes and max(sizes) <= 3, sizes


def test_components_go_on_with_the_few_roots_that_differ(spark, monkeypatch):
    """A winding chain of clumps: after one pass over all edges, no table of the rounds has a row per clump."""
    side = 40
    place = [(x if y % 2 == 0 else side - 1 - x, y) for y in range(0, side) for x in range(side) if y % 2 == 0 or x == 0]
    clump = [(x << 32) + y + 2 ** 31 for x, y in place]
    rows, real = [], graph.Scratch.keep

    def keep(self, df, name):
        out = real(self, df, name)
        rows.append((name, out.count()))
        return out
    monkeypatch.setattr(graph.Scratch, "keep", keep)
    sites = spark.createDataFrame([(1, c, 1, 0) for c in clump], "g int, clump long, n_lig int, n_rec int")
    edges = spark.createDataFrame([(1, a, b) for a, b in zip(clump, clump[1:])], "g int, a_clump long, b_clump long").repartition(3)
    got = graph.clump_labels(sites, edges, "g").select("clump", "component").collect()
    assert {r.component for r in got} == {min(clump)} and len(got) == len(clump)
    later = [n for name, n in rows if name == "edges"][1:]
    assert later and max(later) <= len(clump) // 20, rows


@pytest.mark.parametrize("kind", ["long", "string"])
def test_components_of_small_batches(spark, kind):
    """Random graphs of several groups, with edges spread over many batches, against labels spread by hand."""
    rng = np.random.default_rng(5)
    name = (lambda i: int(i) * 7 - 300) if kind == "long" else (lambda i: f"é{i * 37 % 101}x{i}")
    edges = [(str(g), name(a), name(b)) for g in range(3) for a, b in rng.integers(0, 120, (70 + 20 * g, 2))]
    nodes = [(str(g), name(i)) for g in range(4) for i in range(120)]
    want = {x: x[1] for x in nodes}
    for _ in range(120):
        for g, a, b in edges:
            want[g, a] = want[g, b] = min(want[g, a], want[g, b])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = graph.connected_components(spark.createDataFrame(edges, f"g string, src {kind}, dst {kind}"), spark.createDataFrame(nodes, f"g string, node {kind}"), "g").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {(r.g, r.node): r.component for r in got} == want


def test_draws_do_not_shuffle_the_pairs(spark):
    """300 sites that all meet each other, from one file: the sites go to their cells with their draws, and the 44,850 pairs stay where they are found."""
    df = spark.createDataFrame([(0, i, i * 1e-3, 0.0, "TAM" if i % 2 else "T", int(i % 3 == 0), int(i % 4 == 0)) for i in range(300)],
                               "g int, id long, x double, y double, cell_type string, lig int, rec int").coalesce(1)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        q = resample.permutation_null(df, ("lig", "TAM", "rec", "T"), 1.0, 4, 3, "g", "id")
        got = [r.n_mixed_edges for r in q.collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == [50 * 75] * 4
    moved, todo = [], [q._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if node.nodeName() == "Exchange":
            moved.append(node.metrics().apply("shuffleRecordsWritten").value())
        if node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    assert moved and max(moved) <= 5 * 300, moved


def test_matrix_in_several_files(spark, tmp_path):
    """The size line is that of the file with the banner, wherever Spark reads it; a matrix need not be one file, so no task need hold it to write it."""
    files = {"a": "1 2 0.5\n2 1 -3\n" * 200, "b": "%%MatrixMarket matrix coordinate real general\n% note\n2 3 402\n", "c": "2 3 4\n1 1 7\n"}
    (tmp_path / "m").mkdir()
    for k, v in files.items():
        (tmp_path / "m" / k).write_text(v)
    (tmp_path / "names").write_text("g\nh\n")
    (tmp_path / "meta").write_text("id\nx\ny\nz\n")
    read = lambda: text.read_mtx(spark, str(tmp_path / "m" / "*"), str(tmp_path / "names"), str(tmp_path / "meta"))
    got = read().groupBy("cell_id", "feature", "count").count().collect()
    assert {tuple(r) for r in got} == {("y", "g", 0.5, 200), ("x", "h", -3.0, 200), ("z", "h", 4.0, 1), ("x", "g", 7.0, 1)}
    (tmp_path / "m" / "d").write_text(files["b"])
    with pytest.raises(ValueError, match="several files with a banner"):
        read()
