"""A corpus pipeline over ``documents``: score, deduplicate, cut, decontaminate and mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's documents. All
but the last return the columns of ``documents``; the last adds ``copy``, the number of a row among the copies that the mix takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spatialframe.functions.durable import Scratch
from spatialframe.llm import decontaminate, minhash, mixing, phrases, quality
from spatialframe.llm.words import fold


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network rejects go. It learns as the query does, from labels outside the held-out fold."""
    net = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold("doc_id", 5) != 0)
    return quality.filter_quality(docs, net)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return minhash.keep_one(docs)


def stage_phrases(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document holds are cut."""
    return phrases.remove_repeats(docs)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or one with other values in its slots, go."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: never, once, or up to three times."""
    return mixing.take_mix(docs)


STAGES = [("quality", stage_quality), ("near_duplicates", stage_near_duplicates), ("phrases", stage_phrases), ("decontaminate", stage_decontaminate), ("mix", stage_mix)]

#: No SQL: a trained network and a dynamic programme decide which rows stay. The stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; what a stage hands to the next is a written table."""
    scratch, docs = Scratch(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.close(name)
    return docs
