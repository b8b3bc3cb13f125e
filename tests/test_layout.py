"""Stored layouts, control contrasts and the life of intermediate tables."""

import os
import random
import statistics

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from spatialframe.functions.durable import durable, shared_dir, temporary_tables
from spatialframe.operators import pixels, resample
from spatialframe.sources import sinks, tables

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pixel_store_prunes_and_keeps_rows(spark, tmp_path):
    rows = [(m, r, c, r * c) for m in ("01", "B", None) for r in range(-5, 40) for c in range(0, 30, 3)]
    px = spark.createDataFrame(rows, "marker string, row int, col int, value int")
    sinks.write_pixel_store(px, str(tmp_path / "store"), 8)
    got = tables.scan_pixel_store(spark, str(tmp_path / "store"), ["01", "B"], rows=(-3, 17), cols=(3, 20), height=8)
    assert sorted(map(tuple, got.select("marker", "row", "col", "value").collect())) == sorted(r for r in rows if r[0] and -3 <= r[1] < 17 and 3 <= r[2] < 20)
    filters = plan(got).split("PartitionFilters: [")[1].split("]")[0] + plan(got).split("PushedFilters: [")[1]
    assert "marker" in filters and "band_8" in filters and "GreaterThanOrEqual(row,-3)" in filters   # the plan's text is cut after a few
    whole = tables.scan_pixel_store(spark, str(tmp_path / "store"), ["01", "B"], height=8)
    assert whole.count() == sum(r[0] is not None for r in rows)
    with pytest.raises(ValueError):
        tables.scan_pixel_store(spark, str(tmp_path / "store"), "B", rows=(0, 5), height=16)


def test_bucketed_join_has_no_exchange(spark, tmp_path):
    r = random.Random(4)
    foot = spark.createDataFrame([(i, r.randrange(30), r.randrange(30)) for i in range(500)], "entity_id long, row int, col int")
    px = spark.createDataFrame([(m, a, b, a + b) for m in "AN" for a in range(30) for b in range(30)], "marker string, row int, col int, value int")
    for df, name in ((foot, "t_foot"), (px, "t_px")):
        sinks.write_table_bucketed(df, name, 4, "row", "col", path=str(tmp_path / name))
        assert len([f for f in os.listdir(tmp_path / name) if f.endswith(".parquet")]) <= 4
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = pixels.pixel_join(spark.table("t_foot"), spark.table("t_px"))
        assert "SortMergeJoin" in plan(got) and "Exchange" not in plan(got)
        assert got.count() == pixels.pixel_join(foot, px).count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("drop table t_foot")
        spark.sql("drop table t_px")


def test_no_table_is_left(spark):
    left = lambda: set(os.listdir(shared_dir(spark).removeprefix("file:")))
    before = left()
    for name in ("graph_topology", "nearest_other", "calibrate_threshold", "pixel_join_bucketed", "molecule_fate_stream", "read_mtx", "scan_arm"):
        with temporary_tables(spark):
            assert entry.queries()[name](spark, SF).collect()
        assert left() == before, name
    with pytest.raises(ZeroDivisionError), temporary_tables(spark):
        durable(spark.range(3))
        1 / 0
    assert left() == before
    with temporary_tables(spark):                           # an inner block leaves the outer one's tables alone
        outer = durable(spark.range(3))
        with temporary_tables(spark):
            durable(spark.range(4)).count()
        assert outer.count() == 3
    assert left() == before


def test_discordant_neighbour(spark):
    ent = spark.createDataFrame([(1, "A", True, 0.0, 0.0), (2, "A", True, 1.0, 0.0), (3, "B", True, 1.5, 0.0), (4, "B", False, 2.0, 0.0), (5, "A", False, 1.6, 0.0)],
                                "entity_id long, cell_type string, whole boolean, x double, y double")
    got = {r.entity_id: r.discordant for r in resample.discordant(ent, F.col("whole")).collect()}
    assert got == {1: False, 2: True, 3: True, 4: False, 5: True}   # partial ones are never a neighbour, nobody is its own


def test_identity_controls_by_hand(spark):
    r, canon = random.Random(8), {"x": "A", "y": "B", "z": "C"}
    rows, values = [], {}
    for e in range(120):
        kind = "xyz"[e % 3]
        for m in ("A", "B", "C", "F1", "F2", "F3"):
            v = None if r.random() < .05 else r.random() + (canon[kind] == m)
            values[e, m] = v
            rows.append((e, kind, m, v))
    stats = spark.createDataFrame(rows, "entity_id long, cell_type string, marker string, pos double")
    wide = resample.control_rows(stats, canon, ["F1", "F2", "F3"], {"all": "pos"}).withColumn("level", F.lit("ALL"))
    got = resample.identity_controls(wide, 3, 3, 20, 50, 7, ["view", "level"]).first()
    assert len(wide.columns) == len(set(wide.columns)) and got.q_bh == got.p_perm

    def contrast(e, own, markers):
        have = [values[e, m] for m in markers if values[e, m] is not None]
        return None if values[e, own] is None else values[e, own] - (sum(have) - values[e, own]) / max(len(have) - 1, 1)
    ids = [e for e in range(120) if sum(values[e, m] is not None for m in "ABC") >= 2]
    own = [d for e in ids if (d := contrast(e, "ABC"[e % 3], "ABC")) is not None]
    assert got.n == len(ids) and got.median_delta == pytest.approx(statistics.median(own))
    assert got.ci_lo < got.median_delta < got.ci_hi and got.p_perm == pytest.approx(1 / 21)
    pick = {q.entity_id: q.i for q in spark.createDataFrame([(e,) for e in ids], "entity_id long").select("entity_id", (resample.hash_int(7, F.lit("control"), F.col("entity_id")) % 3).alias("i")).collect()}
    control = [d for e in ids if (d := contrast(e, f"F{pick[e] + 1}", ("F1", "F2", "F3"))) is not None]
    assert got.median_delta_control == pytest.approx(statistics.median(control))
    assert got.frac_positive_control == pytest.approx(sum(d > 0 for d in control) / len(control))
    assert got.cliffs_delta_vs_null > .8 > .4 > abs(got.cliffs_control) and got.cliffs_swapped_map < got.cliffs_delta_vs_null
    assert resample.identity_controls(wide.limit(0), 3, 3, 20, 50, 7, ["view", "level"]).count() == 0
    assert resample.identity_controls(wide, 3, 3, 20, 50, 7, ["view", "level"], min_n=1000).count() == 0
