"""Queries of the training-data operators, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from custody.llm import decontaminate, language, manifest, mixing, neardup, packing, quality, runs, substring, toxicity, urls, vectors, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Rows that no learning sees: crc32 of the id's text leaves 0 by 5."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


@query("op3_best_fit_packing")
def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(packing.lengths(table(spark, folder, "documents")))


@query("op6_warc", warc.ORACLE)
def warc_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    return warc.roundtrip(table(spark, folder, "pages"))


RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@query("op8_url_filter", urls.oracle(RULES))
def url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.filter_urls(table(spark, folder, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op9_language_id")
def language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    profiles = language.learn(docs, ~held_out(F.col("doc_id")))
    found = language.identify(docs, profiles)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op5_chosen_path_dedup")
def chosen_path_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"), size=2, percent=80)


@query("op1_pstable_neighbours", vectors.ORACLE)
def pstable_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_vectors(table(spark, folder, "embeddings"), cosine=0.95)


@query("op4_toxicity")
def toxicity_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    net = toxicity.learn(docs, labels, ~held_out(F.col("doc_id")))
    found = toxicity.score(docs, net)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op7_substring_dedup")
def substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring.kept_digests(table(spark, folder, "documents"), window=20)


@query("op2_decontamination")
def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op10_quality_cotraining")
def quality_cotraining(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = quality.learn(docs, labels, ~held_out(F.col("doc_id")))
    found = quality.score(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "text_score", "meta_score")


@query("op11_context_mixing")
def context_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    found = mixing.score(docs, ~held)
    first = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"]
    return found.select("doc_id", held.alias("held_out"), *first)


@query("op12_merkle_manifest", manifest.ORACLE)
def merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return manifest.prove(manifest.leaves(docs, claimed=tampered))


@query("op13_periodic_runs", runs.ORACLE)
def periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs.digests(runs.repetitions(runs.planted(table(spark, folder, "documents"))))
