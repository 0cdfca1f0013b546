"""Table sources (S1): read the parquet tables and shape labelled samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLES = ("documents", "labels", "embeddings", "benchmark", "conversations", "events", "pages")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def load_samples(spark: SparkSession, root: str, label_col: str = "toxic") -> DataFrame:
    """documents JOIN labels ON doc_id -> (id, text, label, lang, source).

    Only the five needed columns are read (pruned at the scan); the join is an
    equi-join on doc_id, shuffled on the key (or broadcast by AQE when the
    labels side is measured small)."""
    docs = read_table(spark, root, "documents").select(
        F.col("doc_id").alias("id"), "text", "lang", "source")
    labels = read_table(spark, root, "labels").select(
        F.col("doc_id").alias("id"), F.col(label_col).cast("int").alias("label"))
    return docs.join(labels, on="id", how="inner").select("id", "text", "label", "lang", "source")
