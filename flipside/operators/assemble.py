"""Training-set assembly and run bookkeeping (H1-H4)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.keys import hash_rank_key
from ..functions.sampling import take_smallest

AUG_COLS = ["id", "text", "label", "source"]


def merge_train(orig: DataFrame, aug: DataFrame, ratio: float, seed: int) -> DataFrame:
    """H1: originals (source='original') UNION a seeded sample of the augmented
    rows of size min(floor(n_orig * ratio), n_aug). Empty aug -> originals only.

    n_orig is an uncorrelated scalar subquery; the sample is the exact
    histogram cut of functions.sampling (no single-task global sort)."""
    base = orig.select("id", "text", "label").withColumn("source", F.lit("original"))
    n_orig = orig.agg(F.count(F.lit(1))).scalar()
    tie = "candidate_id" if "candidate_id" in aug.columns else "text"
    keyed = aug.withColumn("_tie", F.col(tie).cast("string"))
    picked = take_smallest(keyed, hash_rank_key(seed, F.lit("merge"), "id", "_tie"),
                           lambda total: F.least(total, F.floor(n_orig * F.lit(float(ratio)))),
                           tiebreak=("id", "_tie"))
    return base.unionByName(picked.select(*AUG_COLS))


def sample_stats(method: str, aug: DataFrame, ver: DataFrame | None) -> DataFrame:
    """H2: (method, generated, selected): none -> 0/0; synonym -> n/n; others
    -> verifications (or augmented rows when there are none) / augmented rows."""
    n_aug = aug.agg(F.count(F.lit(1)).alias("n"))
    if method == "none":
        return n_aug.select(F.lit(method).alias("method"), F.lit(0).cast("long").alias("generated"),
                            F.lit(0).cast("long").alias("selected"))
    if method == "synonym" or ver is None:
        return n_aug.select(F.lit(method).alias("method"), F.col("n").alias("generated"), F.col("n").alias("selected"))
    n_ver = ver.agg(F.count(F.lit(1))).scalar()
    return n_aug.select(F.lit(method).alias("method"),
                        F.when(n_ver > 0, n_ver).otherwise(F.col("n")).cast("long").alias("generated"),
                        F.col("n").alias("selected"))


def run_counters(samples: DataFrame, ver: DataFrame, selected: DataFrame) -> DataFrame:
    """H3: input / generated / verified / selected / dropped counts, plus the
    number of samples with no selected row (anti join on id)."""
    n_in = samples.agg(F.count(F.lit(1))).scalar()
    n_ver = ver.agg(F.count(F.lit(1))).scalar()
    n_sel = selected.agg(F.count(F.lit(1))).scalar()
    no_pick = samples.select("id").join(selected.select("id"), "id", "left_anti").agg(F.count(F.lit(1))).scalar()
    one = samples.agg(F.count(F.lit(1)).alias("_n"))   # one-row frame to hang the scalars on
    return one.select(
        n_in.alias("input_samples"), n_ver.alias("generated_candidates"), n_ver.alias("verified_candidates"),
        n_sel.alias("selected_samples"), F.greatest(F.lit(0), n_in - n_sel).alias("dropped_samples"),
        no_pick.alias("samples_without_selection"))


def pending(spark: SparkSession, samples: DataFrame, processed_path: str) -> DataFrame:
    """H4: samples whose id is not in the processed-ids table (left anti join).
    A missing table means nothing was processed yet."""
    if not path_exists(spark, processed_path):
        return samples
    done = spark.read.parquet(processed_path).select("id")
    return samples.join(done, "id", "left_anti")


def record_processed(samples: DataFrame, processed_path: str, run_id: str) -> None:
    """H4: append the ids of a finished run (samples without a selection too,
    so they are not generated again)."""
    samples.select("id", F.lit(run_id).alias("run_id")).write.mode("append").parquet(processed_path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there; ``path`` may be a glob."""
    try:
        return bool(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").head(1))
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
