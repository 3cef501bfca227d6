"""Graphs made from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomesh.operators.spatial import Near
from chronomesh.plans.storage import stored, table


def embedding_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node a vector: its first three coordinates, a lifetime from its id, and a name."""
    begin = F.col("vec_id") * 37 % 60
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")],
        begin.alias("begin_ts"), F.least(F.lit(100), begin + 20 + F.col("vec_id") * 11 % 40).cast("bigint").alias("end_ts"),
        F.create_map(F.lit("name"), F.concat(F.lit("v"), F.col("vec_id").cast("string"))).alias("props"),
    )


def embedding_graph(spark: SparkSession, sf_dir: str, radius: float = 0.1) -> Near:
    """Nodes near each other while both live.  Nodes are stored once, as loops read them many times; edges are not stored."""
    return Near(stored(embedding_nodes(spark, sf_dir), "nodes")[0], radius)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(domain, doc_seq, text): documents by language."""
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("domain"), F.col("doc_id").alias("doc_seq"), "text")
