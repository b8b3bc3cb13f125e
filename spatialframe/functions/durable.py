"""Cutting lineage through the shared folder, so that a lost executor costs a re-read and not a re-run."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's checkpoint folder. Only a local session may make its own, and a
    cluster's folder must name a file system unless the default one is shared."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    path = current or spark.conf.get("spark.checkpoint.dir", None)
    local = sc.master == "local" or sc.master.startswith("local[")
    if path is None:
        if not local:
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    default = sc._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    if not local and not urlparse(path).scheme and default.startswith("file:"):
        raise RuntimeError(f"spark.checkpoint.dir is {path}, a folder of one machine; name it with its file system")
    if not current:
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


#: Paths made inside the innermost ``temporary_tables`` block; None outside of any.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def fresh_path(spark: SparkSession, head: str) -> str:
    """A new path in the shared folder. Inside ``temporary_tables`` it's deleted with the block."""
    path = f"{shared_dir(spark)}/{head}-{uuid.uuid4().hex}"
    if _made.get() is not None:
        _made.get().append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def temporary_tables(spark: SparkSession):
    """Delete the intermediate tables of all operators called inside when the block ends, also when it fails. Results that read them must
    be written or collected inside the block; blocks may be nested. Outside of a block tables stay in the checkpoint folder."""
    token = _made.set([])
    try:
        yield
    finally:
        made = _made.get()
        _made.reset(token)
        for path in made:
            delete(spark, path)


def durable(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read back. Unlike a checkpointed RDD the table has known sizes, so
    small intermediate results are joined by broadcast."""
    path = fresh_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """The intermediate tables of one job, kept by name in the shared folder and deleted as soon as no later step reads
    them. Writing under a name again puts the new table in place before the old one goes."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = fresh_path(spark, "scratch")
        self.paths: dict[str, str] = {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.paths:
                delete(self.spark, self.paths.pop(name))

    def close(self, *keep: str) -> None:
        """Delete all tables but those that the result still reads."""
        self.drop(*[n for n in list(self.paths) if n not in keep])
