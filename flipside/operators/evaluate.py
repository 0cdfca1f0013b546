"""Model evaluation and reports (I3-I6). I1/I2 live in operators.score
(fit_text_classifier / predict)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    den = 2 * tp + fp + fn
    return F.when(den > 0, (2 * tp) / den).otherwise(F.lit(0.0))


def classification_metrics(pred: DataFrame, by: list[str] | tuple[str, ...] = (),
                           label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy and macro-F1 per group in one pass of conditional sums.
    Macro-F1 averages over the classes present in truth or prediction; a class
    with no true or predicted positives scores 0."""
    y, yh = F.col(label), F.col(prediction)
    agg = pred.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(y == yh, 1).otherwise(0)).alias("correct"),
        *[F.sum(F.when((y == c) & (yh == c), 1).otherwise(0)).alias(f"tp{c}") for c in (0, 1)],
        *[F.sum(F.when((y != c) & (yh == c), 1).otherwise(0)).alias(f"fp{c}") for c in (0, 1)],
        *[F.sum(F.when((y == c) & (yh != c), 1).otherwise(0)).alias(f"fn{c}") for c in (0, 1)],
        *[F.max(F.when((y == c) | (yh == c), 1).otherwise(0)).alias(f"present{c}") for c in (0, 1)],
    )
    f0 = _f1(F.col("tp0"), F.col("fp0"), F.col("fn0"))
    f1 = _f1(F.col("tp1"), F.col("fp1"), F.col("fn1"))
    n_cls = F.col("present0") + F.col("present1")
    macro = F.when(n_cls > 0, (f0 * F.col("present0") + f1 * F.col("present1")) / n_cls).otherwise(F.lit(0.0))
    return agg.select(*by, F.col("n").alias("n_rows"),
                      F.round(F.col("correct") / F.col("n"), 4).alias("acc"),
                      F.round(macro, 4).alias("f1"))


def quality_report(ver: DataFrame, by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Mean label / semantic / minimality / final score over all scored candidates."""
    return ver.groupBy(*by).agg(
        F.round(F.avg("label_score"), 4).alias("label_success"),
        F.round(F.avg("semantic_score"), 4).alias("semantic_sim"),
        F.round(F.avg("minimality_score"), 4).alias("edit_similarity"),
        F.round(F.avg("final_score"), 4).alias("final_score"),
    )


def ood_report(metrics: DataFrame, by: list[str] | tuple[str, ...] = ("method",)) -> DataFrame:
    """Per group ID and OOD accuracy / F1 side by side and the gap.
    Input: classification_metrics grouped by (*by, domain)."""
    m = metrics
    return m.groupBy(*by).agg(
        F.max(F.when(F.col("domain") == "id", F.col("acc"))).alias("id_acc"),
        F.max(F.when(F.col("domain") == "id", F.col("f1"))).alias("id_f1"),
        F.max(F.when(F.col("domain") == "ood", F.col("acc"))).alias("ood_acc"),
        F.max(F.when(F.col("domain") == "ood", F.col("f1"))).alias("ood_f1"),
    ).withColumn("gap", F.round(F.col("id_acc") - F.col("ood_acc"), 4))
