"""H4: augmentation that can be broken off anywhere and started again.

An attempt writes its selected rows and the ids it has processed (those without
a selection too) into partitions of its own, then one row that names it into
the manifest. Spark commits that row or not, so an attempt counts as a whole or
not at all: readers join the tables with the manifest, and what an attempt left
that was broken off before is never read. The manifest has one row an attempt,
so it is broadcast. Attempts on one folder run one after the other.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.assemble import path_exists
from .rounds import RoundsResult

SELECTED_SCHEMA = "id bigint, text string, label int, source string, candidate_id string, final_score double, round int, ordinal int"


def committed(spark: SparkSession, base: str, table: str, schema: str) -> DataFrame:
    """The rows that committed attempts wrote into ``table``; none where there is no such attempt."""
    if not path_exists(spark, f"{base}/manifest") or not path_exists(spark, f"{base}/{table}"):
        return spark.createDataFrame([], schema)
    attempts = spark.read.schema("attempt string").parquet(f"{base}/manifest")
    rows = spark.read.schema(f"{schema}, attempt string").parquet(f"{base}/{table}")
    return rows.join(F.broadcast(attempts), "attempt", "left_semi").drop("attempt")


def selections(spark: SparkSession, base: str) -> DataFrame:
    return committed(spark, base, "selected", SELECTED_SCHEMA)


def to_do(samples: DataFrame, base: str) -> DataFrame:
    """The samples that no committed attempt has processed."""
    return samples.join(committed(samples.sparkSession, base, "processed", "id bigint"), "id", "left_anti")


def write_attempt(samples: DataFrame, augment: Callable[[DataFrame], RoundsResult], base: str) -> str:
    """Augments the pending samples and writes both tables, uncommitted; returns the attempt's name."""
    attempt = uuid.uuid4().hex
    own = F.lit(attempt).alias("attempt")
    pending = to_do(samples, base)
    selected = augment(pending).selected.select("id", "text", "label", "source", "candidate_id", "final_score", "round", "ordinal", own)
    selected.write.mode("append").partitionBy("attempt").parquet(f"{base}/selected")
    pending.select("id", own).write.mode("append").partitionBy("attempt").parquet(f"{base}/processed")
    return attempt


def commit(spark: SparkSession, base: str, attempt: str) -> None:
    spark.range(1).select(F.lit(attempt).alias("attempt")).write.mode("append").parquet(f"{base}/manifest")


def augment_resumable(samples: DataFrame, augment: Callable[[DataFrame], RoundsResult], base: str) -> DataFrame:
    """Augments what is pending below ``base``, commits it, and returns the selections of all attempts."""
    commit(samples.sparkSession, base, write_attempt(samples, augment, base))
    return selections(samples.sparkSession, base)
