"""One query per operator over its whole table, with production parameters, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from spatialframe.functions.durable import Scratch

from . import chat, decontaminate, embedding, importance, langid, minhash, mixing, phrases, quality, toxicity, trie, urls, warc
from .words import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_quality")
def op1_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = quality.fit_quality(docs, labels, fold("doc_id", 5) != 0)
    return quality.score_quality(docs, net).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op9_language")
def op9_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = langid.predict_language(docs, langid.fit_dictionaries(docs, fold("doc_id", 3) != 1), reject_margin=0.0)
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", (F.col("margin") >= 0.01).alias("confident"))


@query("op10_toxicity")
def op10_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit_toxicity(docs, labels, fold("doc_id", 3) != 1)
    return toxicity.score_toxicity(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op2_mixing")
def op2_mixing(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


@query("op4_urls", urls.oracle_sql())
def op4_urls(spark, sf_dir):
    return urls.judge_pages(table(spark, sf_dir, "pages"))


@query("op8_chat", chat.ORACLE_SQL)
def op8_chat(spark, sf_dir):
    mask = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["from"].cast("string"), m["to"].cast("string"))), ",")
    return chat.rotate(table(spark, sf_dir, "conversations")).withColumn("mask", mask)


@query("op3_decontaminate")
def op3_decontaminate(spark, sf_dir):
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


@query("op7_phrases", phrases.ORACLE_SQL)
def op7_phrases(spark, sf_dir):
    return phrases.remove_digest(table(spark, sf_dir, "documents"))


@query("op6_minhash")
def op6_minhash(spark, sf_dir):
    scratch = Scratch(spark)
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), scratch)
    scratch.close("classes")
    return found.select("doc_id", "class_id", "kept")


@query("op5_embeddings")
def op5_embeddings(spark, sf_dir):
    return embedding.link_vectors(table(spark, sf_dir, "embeddings"))


@query("op13_importance", importance.ORACLE_SQL)
def op13_importance(spark, sf_dir):
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op11_warc", warc.ORACLE_SQL)
def op11_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query("op12_trie", trie.oracle_sql())
def op12_trie(spark, sf_dir):
    return trie.build_trie(table(spark, sf_dir, "conversations"))
