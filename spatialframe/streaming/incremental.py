"""Incremental counterparts of two batch summaries. Both keep only mergeable counters as state.

A job runs in update mode: batch N writes just the rows whose counters it changed, as ``<path>/batch=N``. The state is the newest row of
every key. A batch that is repeated after a failure overwrites its own folder with the same rows, so nothing is counted twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import as_list, n_rows
from ..operators.summaries import fate_conditions, fate_rows


def read_stream(spark: SparkSession, folder: str, pattern: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """New Parquet files of a folder as a stream, with a declared schema."""
    r = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(folder)


def molecule_fate_stream(stream: DataFrame, **cols) -> DataFrame:
    """Running fate counters over everything seen so far (a streaming aggregate of one row)."""
    return stream.groupBy().agg(*[F.sum(c.cast("bigint")).alias(n) for n, c in fate_conditions(**cols).items()])


def entity_accumulator_stream(stream: DataFrame, key: str = "entity_id") -> DataFrame:
    """Running n, sum x and sum y per entity; the centroid follows from them at read time."""
    return stream.groupBy(key).agg(n_rows().alias("n_tx"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _batches(spark: SparkSession, path: str, head: str) -> list[int]:
    """Numbers of the finished tables ``<path>/<head><number>``, ascending. A table is finished once it holds its success mark."""
    fs, root = _fs(spark, path)
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    done = lambda n: fs.exists(_fs(spark, f"{path}/{n}/_SUCCESS")[1])
    return sorted(int(n[len(head):]) for n in names if n.startswith(head) and n[len(head):].isdigit() and done(n))


def run_available(agg: DataFrame, path: str, checkpoint: str, keys=()) -> DataFrame:
    """Process what is there, stop, and return the state (see ``current_state``). Without new files nothing is written, and the
    state is the one of the earlier runs; before the first file it is empty."""
    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    q = agg.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return current_state(agg.sparkSession, path, agg.schema, keys)


def current_state(spark: SparkSession, path: str, schema, keys=(), until: int | None = None) -> DataFrame:
    """Newest row of every key, over the folded state and the batches after it (up to batch ``until``). One aggregate with map-side
    combine; a key comes at most once per batch, so a hot key is as cheap as any."""
    keys = as_list(keys)
    wanted = lambda head: [b for b in _batches(spark, path, head) if until is None or b <= until]
    base = max(wanted("fold-"), default=-1)
    batches = [f"{path}/batch={b}" for b in wanted("batch=") if b > base]
    tables = []
    if base >= 0:
        tables.append(spark.read.schema(schema).parquet(f"{path}/fold-{base}").withColumn("batch", F.lit(base)))
    if batches:
        tables.append(spark.read.schema(schema).option("basePath", path).parquet(*batches))   # adds the number of the folder
    if not tables:
        return spark.createDataFrame([], schema)
    values = [c for c in schema.names if c not in keys]
    newest = reduce(DataFrame.unionByName, tables).groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_s")).where("_s is not null")
    return newest.select(*[F.col(c) if c in keys else F.col(f"_s.{c}").alias(c) for c in schema.names])


def fold_batches(spark: SparkSession, path: str, schema, keys=()) -> int | None:
    """Fold finished batches into one table, so that reading doesn't slow down with their number, and delete them. Returns the last
    folded batch, None if there is nothing to fold.

    The newest batch stays as it is, since it alone can be repeated after a failure. A fold counts from its success mark on: a run that
    dies before it leaves the batches in use, one that dies after it leaves folders that no reader opens and the next fold removes.
    """
    batches, folds = _batches(spark, path, "batch="), _batches(spark, path, "fold-")
    if len(batches) > 1 and batches[-2] > max(folds, default=-1):
        current_state(spark, path, schema, keys, until=batches[-2]).write.mode("overwrite").parquet(f"{path}/fold-{batches[-2]}")
        folds.append(batches[-2])
    if not folds:
        return None
    for name in [f"batch={b}" for b in batches if b <= folds[-1]] + [f"fold-{f}" for f in folds[:-1]]:
        fs, p = _fs(spark, f"{path}/{name}")
        fs.delete(p, True)
    return folds[-1]


def fate_result(state: DataFrame) -> DataFrame:
    return fate_rows(state)


def centroid_result(state: DataFrame, key: str = "entity_id") -> DataFrame:
    return state.select(key, (F.col("sx") / F.col("n_tx")).alias("x"), (F.col("sy") / F.col("n_tx")).alias("y"), "n_tx")
