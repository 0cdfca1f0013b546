"""Tables of the experiment grid, written once for an application and its input (J2-J4 and what J5-J12 read)."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.assemble import path_exists
from ..session import checkpoint_dir
from . import grid


def _grid_folder(spark: SparkSession, root: str, *key) -> str:
    """The folder of a grid's tables, below this application's own checkpoint
    folder and named after the parameters and the input files (path, size,
    time), so that the roll-ups of one application share one run and neither
    another session nor changed data ever meets it. The files' list is hashed
    where it is read."""
    marks = []
    for table in ("documents", "labels"):
        file = F.struct("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
        files = spark.read.parquet(f"{root}/{table}.parquet").groupBy(file.alias("file")).count()
        marks.append(tuple(files.agg(F.count(F.lit(1)), F.sum(F.xxhash64("file").cast("decimal(38,0)"))).first()))
    return f"{checkpoint_dir(spark).rstrip('/')}/flipside-grid-{hashlib.md5(repr((key, root, marks)).encode()).hexdigest()}"


def _kept(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at ``path``, made and written first where the mark isn't there that follows a whole table."""
    if not path_exists(spark, f"{path}-done"):
        make().coalesce(1).write.mode("overwrite").parquet(path)   # a row for each run
        spark.range(1).write.mode("overwrite").parquet(f"{path}-done")
    return spark.read.parquet(path)


def method_runs(spark: SparkSession, root: str, seeds=grid.SEEDS) -> DataFrame:
    """One row for each (task, ratio, seed, preset, method): the low-resource ladder, and its whole samples as the main task."""
    runs = _kept(spark, _grid_folder(spark, root, "methods", tuple(seeds)), lambda: grid.method_runs(spark, root, seeds))
    low = runs.withColumn("task", F.lit("low_resource"))
    main = runs.where("ratio = '100pct'").withColumn("task", F.lit("main"))
    return low.unionByName(main).withColumn("variant", F.lit("full"))


def main_runs(spark: SparkSession, root: str, seeds=grid.SEEDS) -> DataFrame:
    return method_runs(spark, root, seeds).where("task = 'main'")


def quality_runs(spark: SparkSession, root: str, seeds=grid.SEEDS) -> DataFrame:
    """Mean scores of the main task's methods that verify rewrites."""
    return main_runs(spark, root, seeds).where("label_success IS NOT NULL").select(
        "task", "ratio", "seed", "preset", "method", "label_success", "semantic_sim", "edit_similarity", "final_score")


def ablation_runs(spark: SparkSession, root: str, seeds=grid.SEEDS) -> DataFrame:
    """variant, seed, acc, f1, label_success."""
    runs = _kept(spark, _grid_folder(spark, root, "ablation", tuple(seeds)), lambda: grid.ablation_runs(spark, root, seeds))
    return runs.select(F.col("method").alias("variant"), "seed", F.col("test_acc").alias("acc"), F.col("test_f1").alias("f1"),
                       F.coalesce("label_success", F.lit(0.0)).alias("label_success"))
