"""Corpus pipeline: reject, deduplicate, decontaminate and pack the documents.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's documents. All but the last return the columns of the
documents; the last one lists in which bin each piece of each document lies.

Defined cases are those of the operators. Documents without id pass every stage that judges
by id; a document listed more than once (equal rows) is listed once after the second stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custody.llm import decontaminate, neardup, packing, substring, toxicity
from custody.llm.queries import held_out
from custody.llm.work import written

PASSAGE_WORDS = 50


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, fitted on the labels of this folder, doesn't call toxic."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return toxicity.accepted(docs, toxicity.learn(docs, labels, ~held_out(F.col("doc_id"))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates (five-word shingles, 0.8)."""
    found = written(neardup.near_duplicates(docs, size=5, percent=80), "near-duplicates")
    left = docs.join(found.where(~F.col("kept")).select("doc_id").hint("merge"), "doc_id", "left_anti").select(*docs.columns)
    twice = found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if twice.isEmpty():
        return left
    return left.where("doc_id is not null").dropDuplicates(["doc_id"]).union(left.where("doc_id is null"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of PASSAGE_WORDS words that also start earlier."""
    return substring.deduplicated(docs, window=PASSAGE_WORDS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window matches a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    found = decontaminate.contaminated(docs, benchmark).select("doc_id").distinct()
    return docs.join(written(found, "contaminated").hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, piece, start, n_tokens, bin_id)."""
    return packing.pack(packing.lengths(docs))


STAGES = [
    ("toxicity", reject_toxic),
    ("minhash_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack_bins),
]

ORACLE_SQL = None  # the network's scores can't be said in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; the bins of the last one."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
