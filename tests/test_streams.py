"""Incremental jobs over several file drops, a repeated batch, and runs without new files."""

import os
import random

from spatialframe.operators import summaries
from spatialframe.streaming import incremental as J

SCHEMA = "entity_id long, owner_out long, x double, y double, etype_at_input int, etype_at_finalize int"


def drop(spark, folder, seed, n=200):
    r = random.Random(seed)
    rows = [(r.randrange(20 * seed, 20 * seed + 40), r.randrange(40), float(r.randrange(100)), float(r.randrange(100)), r.choice([0, 3]), r.choice([0, 1, 3, 5]))
            for _ in range(n)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def agrees(spark, data, fate, centroids):
    seen = spark.read.parquet(data)
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    assert rows(J.fate_result(fate)) == rows(summaries.molecule_fate(seen))
    assert rows(J.centroid_result(centroids)) == rows(summaries.centroids(seen).select("entity_id", "x", "y", "n_tx"))


def jobs(spark, base):
    stream = J.read_stream(spark, f"{base}/in", "*.parquet", SCHEMA, 1)
    fate, acc = J.molecule_fate_stream(stream), J.entity_accumulator_stream(stream)
    return (fate.schema, acc.schema), lambda: (J.run_available(fate, f"{base}/fate", f"{base}/c1"), J.run_available(acc, f"{base}/acc", f"{base}/c2", "entity_id"))


def test_drops_replay_and_idle_runs(spark, tmp_path):
    base = str(tmp_path)
    drop(spark, f"{base}/in", 1)
    (s1, s2), run = jobs(spark, base)
    agrees(spark, f"{base}/in", *run())
    agrees(spark, f"{base}/in", *run())                     # nothing new: same state, nothing written
    assert J._batches(spark, f"{base}/acc", "batch=") == [0]
    drop(spark, f"{base}/in", 2)
    drop(spark, f"{base}/in", 3)
    agrees(spark, f"{base}/in", *run())                     # two files, a batch each
    assert J._batches(spark, f"{base}/acc", "batch=") == [0, 1, 2]
    for c in ("c1", "c2"):                                  # the job died before it noted batch 2 as done: it's repeated
        for f in ("2", ".2.crc"):
            os.remove(f"{base}/{c}/commits/{f}")
    agrees(spark, f"{base}/in", *run())
    assert J._batches(spark, f"{base}/acc", "batch=") == [0, 1, 2]
    # only changed keys are written again
    assert spark.read.parquet(f"{base}/acc/batch=2").count() <= 40 < J.current_state(spark, f"{base}/acc", s2, "entity_id").count()
    # folding keeps the state and the batch that can still be repeated
    for path, schema, keys in ((f"{base}/fate", s1, ()), (f"{base}/acc", s2, "entity_id")):
        assert J.fold_batches(spark, path, schema, keys) == 1
        assert J.fold_batches(spark, path, schema, keys) == 1
        assert (J._batches(spark, path, "batch="), J._batches(spark, path, "fold-")) == ([2], [1])
    drop(spark, f"{base}/in", 1)                            # old keys change once more
    agrees(spark, f"{base}/in", *run())
    assert J.fold_batches(spark, f"{base}/acc", s2, "entity_id") == 2
    assert (J._batches(spark, f"{base}/acc", "batch="), J._batches(spark, f"{base}/acc", "fold-")) == ([3], [2])
    agrees(spark, f"{base}/in", *run())


def test_no_file_yet(spark, tmp_path):
    os.makedirs(f"{tmp_path}/in")
    _, run = jobs(spark, str(tmp_path))
    fate, acc = run()
    assert acc.count() == 0 and fate.count() == 0


def test_unfinished_tables_are_not_read(spark, tmp_path):
    base = str(tmp_path)
    drop(spark, f"{base}/in", 1)
    drop(spark, f"{base}/in", 2)
    (_, s2), run = jobs(spark, base)
    agrees(spark, f"{base}/in", *run())
    spark.createDataFrame([(1, 5, 1.0, 1.0)], s2).write.parquet(f"{base}/acc/fold-1")
    os.remove(f"{base}/acc/fold-1/_SUCCESS")                # a fold that died half-way
    agrees(spark, f"{base}/in", *run())
    assert J.fold_batches(spark, f"{base}/acc", s2, "entity_id") == 0
    agrees(spark, f"{base}/in", *run())


def test_null_keys_and_values(spark, tmp_path):
    base = str(tmp_path)
    spark.createDataFrame([(None, 1, 1.0, 2.0, 0, 0), (1, None, 3.0, 4.0, None, None), (None, 2, 5.0, 6.0, 3, 1)], SCHEMA).coalesce(1).write.parquet(f"{base}/in")
    _, run = jobs(spark, base)
    fate, acc = run()
    got = {r.entity_id: (r.x, r.y, r.n_tx) for r in J.centroid_result(acc).collect()}
    assert got == {None: (3.0, 4.0, 2), 1: (3.0, 4.0, 1)}
    assert J.fate_result(fate).where("quantity = 'total'").first().n == 3
