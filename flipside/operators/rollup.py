"""Experiment roll-ups (J1, J2, J5-J12): grouping, pivot, ranking over runs tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..params import METHODS


def mean_std(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """Mean and sample std per group as `<col>_mean` / `<col>_std`;
    a single-run group has a NULL std."""
    aggs = []
    for c in cols:
        aggs += [F.round(F.avg(c), 4).alias(f"{c}_mean"), F.round(F.stddev_samp(c), 4).alias(f"{c}_std")]
    return df.groupBy(*by).agg(*aggs)


def summarize_main(runs: DataFrame) -> DataFrame:
    """Test accuracy / F1 by method over seeds and presets."""
    return mean_std(runs.filter(F.col("task") == "main"), ["method"], ["test_acc", "test_f1"])


def summarize_quality(quality: DataFrame) -> DataFrame:
    """Quality means by method over seeds."""
    return mean_std(quality, ["method"], ["label_success", "semantic_sim", "edit_similarity"])


def summarize_low_resource(runs: DataFrame) -> DataFrame:
    """Test accuracy by (method, ratio)."""
    return mean_std(runs.filter(F.col("task") == "low_resource"), ["method", "ratio"], ["test_acc"])


def summarize_ablation(ablation: DataFrame) -> DataFrame:
    """Acc / F1 / label success by variant."""
    return mean_std(ablation, ["variant"], ["acc", "f1", "label_success"])


def summarize_ood(runs: DataFrame) -> DataFrame:
    """ID / OOD accuracy and gap by (method, OOD set)."""
    return mean_std(runs.withColumn("ood_dataset", F.lit("ood_test")), ["method", "ood_dataset"],
                    ["test_acc", "ood_acc", "gap"])


def ratio_pivot(runs: DataFrame, ratios=("10pct", "30pct", "50pct", "100pct"), presets=("default", "multi_stage"),
                methods=METHODS) -> DataFrame:
    """Method x ratio matrix of 100*acc at 2 dp; when a method appears in
    several presets the first preset (in `presets` order) wins; fixed row order;
    NULL when missing."""
    rank = F.array_position(F.array(*[F.lit(x) for x in presets]), F.col("preset"))
    firsts = (runs.withColumn("_prank", rank)
              .groupBy("method", "ratio").agg(F.min_by("test_acc", F.struct("_prank", "seed")).alias("acc")))
    wide = firsts.groupBy("method").pivot("ratio", list(ratios)).agg(F.first(F.round(F.col("acc") * 100, 2)))
    order = runs.sparkSession.createDataFrame([(m, i) for i, m in enumerate(methods)], "method string, row_order int")
    return order.join(wide, "method", "left").select(
        "row_order", "method", *[F.col(r).alias(f"acc_{r}") for r in ratios])


def best_per_group(summary: DataFrame, group: str = "ratio", value: str = "test_acc_mean",
                   ours: str = "multi_stage") -> DataFrame:
    """Best method per group (ties -> method name) beside our method's value."""
    best = summary.groupBy(group).agg(
        F.max_by("method", F.struct(F.col(value), F.col("method"))).alias("best_method"),
        F.max(value).alias("best_value"),
        F.max(F.when(F.col("method") == ours, F.col(value))).alias("ours_value"))
    return best


def delta_vs(summary: DataFrame, ref: str, group: str = "ratio", value: str = "test_acc_mean",
             key: str = "method") -> DataFrame:
    """Points (x100, 2 dp) gained over the reference row of each group."""
    w = Window.partitionBy(group)
    return summary.withColumn("_ref", F.max(F.when(F.col(key) == ref, F.col(value))).over(w)).select(
        group, key, F.round((F.col(value) - F.col("_ref")) * 100, 2).alias("delta_points"))
