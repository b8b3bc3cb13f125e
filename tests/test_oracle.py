"""A cross-section of registered queries against their SQL on the smallest tables (all of them: tests/oracle.py)."""

import oracle
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = ["scan_arm", "enrich_missing", "sample_cap", "compare_runs", "depth_summary", "molecule_fate", "paired_vs_baseline", "bh_adjust",
         "cliffs_delta", "nearest", "nearest_other", "radius_pairs", "radius_join", "window_join", "graph_topology", "permutation_null", "bootstrap_ci",
         "expr_detect", "marker_support", "transfer_labels", "feature_knn", "match_depth", "calibrate_threshold", "signed_distance_bands", "read_mtx"]


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    status, _, note = oracle.compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert status == "ok", f"{status} {note}"


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
