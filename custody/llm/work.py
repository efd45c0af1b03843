"""Written intermediate tables and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custody.session import shared_dir


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it again, which cuts its lineage."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _stars(edges: DataFrame) -> bool:
    """Every edge (u, v) leads from a node of one edge to a node that no edge leads from."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("inward")).union(
        edges.select("v", F.lit(0), F.lit(1))
    )
    per = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("inward").alias("inward"))
    return per.agg(F.coalesce(F.max(F.when(F.col("out") > 0, F.col("out") + F.col("inward"))), F.lit(0))).first()[0] <= 1


def connected_components(links: DataFrame, a: str, b: str, id_name: str) -> DataFrame:
    """(id_name, component_id) of every node of a link; the component is its smallest id.

    Alternates the two star steps: each node hands its larger neighbours to its smallest
    one, then its smaller neighbours to the smallest of them, until all edges form stars around
    the smallest ids. Steps are aggregates and joins on one key; a node with very many links is
    pre-aggregated. Every round is written; rounds grow with the logarithm of the longest chain,
    and links that are stars already need none.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = written(edges, "links")
    while not _stars(edges):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # at most as many rows as edges; equal ones go at the end of the round
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(
            F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        edges = written(small.select("e.u", "e.v").where("u <> v").distinct(), "links")
    ends = edges.select(F.col("u").alias(id_name), F.col("v").alias("component_id"))
    return ends.union(edges.select(F.col("v").alias(id_name), F.col("v").alias("component_id")).distinct())
