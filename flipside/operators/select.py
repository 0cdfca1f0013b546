"""Selection (G1-G6): filter, per-group percentile cut, top-k.

All windows are partitioned by the sample id (plus round), which is the hash
partitioning established once at preprocess; groups hold one sample's
candidates (bounded by num_candidates), never a whole key space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..params import Params

GROUP = ("id", "round")


def passes_thresholds(p: Params) -> Column:
    """G1 predicate: label, semantic and final on the stored (rounded) scores;
    minimality and status are not looked at."""
    return ((F.col("label_score") >= p.th_label) & (F.col("semantic_score") >= p.th_semantic)
            & (F.col("final_score") >= p.th_final))


def threshold_filter(ver: DataFrame, p: Params) -> DataFrame:
    """G1."""
    return ver.filter(passes_thresholds(p))


def dynamic_percentile(df: DataFrame, p: Params, group=GROUP) -> DataFrame:
    """Per group, only when the mode is dynamic and the group holds more
    than k rows, keep final >= quantile(1 - keep) (linear interpolation)."""
    if p.filtering_mode != "dynamic_percentile":
        return df
    q = max(0.0, min(1.0, 1.0 - float(p.percentile_keep)))
    w = Window.partitionBy(*group)
    return (
        df.withColumn("_n", F.count(F.lit(1)).over(w))
        .withColumn("_cut", F.percentile(F.col("final_score"), F.lit(q)).over(w))
        .filter((F.col("_n") <= p.keep_top_k) | (F.col("final_score") >= F.col("_cut")))
        .drop("_n", "_cut")
    )


def top_k(df: DataFrame, k: int, group=GROUP) -> DataFrame:
    """Best k by final score; ties go to the lower ordinal."""
    w = Window.partitionBy(*group).orderBy(F.col("final_score").desc(), F.col("ordinal"))
    return df.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= k).drop("_rk")


def _shape(df: DataFrame, source: str) -> DataFrame:
    return df.select("id", "round", F.col("cand_text").alias("text"), F.col("target_label").alias("label"),
                     F.lit(source).alias("source"), "candidate_id", "ordinal", "final_score")


def select(ver: DataFrame, p: Params, source: str = "multi_stage", group=GROUP, texts=lambda rows: rows) -> DataFrame:
    """G4 = G1 -> G2 -> G3 (order matters) + output shape (label = target). ``texts`` adds cand_text to the selected rows
    where ``ver`` has none."""
    return _shape(texts(top_k(dynamic_percentile(threshold_filter(ver, p), p, group), p.keep_top_k, group)), source)


def select_pass_only(ver: DataFrame, source: str = "multi_stage", texts=lambda rows: rows) -> DataFrame:
    """Selector ablated -- every `pass` row of the round, no k. ``texts``: see ``select``."""
    return _shape(texts(ver.filter(F.col("status") == "pass")), source)


def post_filter(aug: DataFrame, ver: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """Keep verifications over three thresholds, then augmented rows whose
    id survives (semi join on id)."""
    kept = threshold_filter(ver, p)
    return aug.join(kept.select("id"), "id", "left_semi"), kept
