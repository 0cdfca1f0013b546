"""Stage and result sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder of its own below spark.checkpoint.dir, which all executors share."""
    from ..session import checkpoint_dir
    return f"{checkpoint_dir(spark).rstrip('/')}/flipside-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes a table once and reads it back: what made it runs once, and its lineage ends."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_stage(df: DataFrame, root: str, stage: str, run_id: str) -> None:
    """Append a stage table (plans, candidates, verifications, selected)
    as JSON lines under root/stage, partitioned by run_id. Each task writes
    its own files; a rerun of the same run_id replaces only that partition."""
    (df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("run_id").json(f"{root}/{stage}"))


def read_stage(spark: SparkSession, root: str, stage: str, schema: StructType | str) -> DataFrame:
    """Read a stage back with an explicit schema; a missing folder gives an
    empty frame of that schema."""
    from ..operators.assemble import path_exists
    path = f"{root}/{stage}"
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def write_results(df: DataFrame, path: str) -> None:
    """S3: CSV result table with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_splits(df: DataFrame, path: str) -> None:
    """Processed splits, one folder per split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def collect_runs(spark: SparkSession, root: str, schema: StructType | str, table: str = "main") -> DataFrame:
    """Every ``<root>/<task>/<ratio>/seed_<n>/<table>`` result table (S3) in
    one glob read; the path's dimensions become the columns task, ratio and
    seed. Missing trees give an empty frame of the same columns."""
    from ..operators.assemble import path_exists
    path = F.col("_metadata.file_path")
    at = rf"/([^/]+)/([^/]+)/seed_(\d+)/{table}/[^/]*$"
    dims = {"task": F.regexp_extract(path, at, 1), "ratio": F.regexp_extract(path, at, 2),
            "seed": F.regexp_extract(path, at, 3).cast("int")}
    pattern = f"{root}/*/*/seed_*/{table}"
    if not path_exists(spark, pattern):
        return spark.createDataFrame([], schema).select(
            "*", *[F.lit("" if c != "seed" else 0).alias(c) for c in dims])
    df = spark.read.schema(schema).option("header", True).csv(pattern)
    return df.select("*", *[c.alias(n) for n, c in dims.items()])
