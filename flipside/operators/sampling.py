"""Sample preparation, projections, filters and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.keys import hash_bucket, hash_rank_key
from ..functions.sampling import take_smallest, take_smallest_each
from ..functions.text import clean_text
from ..params import LADDER, Params


def preprocess(df: DataFrame) -> DataFrame:
    """Clean whitespace, drop blank text / null label, int label, one row per id.

    The groupBy on id is the one shuffle of the samples; everything downstream
    (candidates, scores, per-sample windows) reuses this hash partitioning."""
    cleaned = (
        # blank is seen in the raw text: a filter on the cleaned one would clean it twice
        df.filter(F.col("text").rlike(r"\S") & F.col("label").isNotNull())
        .withColumn("text", clean_text(F.col("text")))
        .withColumn("label", F.col("label").cast("int"))
    )
    rest = [c for c in cleaned.columns if c != "id"]
    return (
        cleaned.groupBy("id")
        .agg(F.min_by(F.struct(*rest), F.col("text")).alias("_r"))
        .select("id", *[F.col(f"_r.{c}").alias(c) for c in rest])
    )


def assign_split(df: DataFrame, seed: int = 0, train_pct: int = 70, validation_pct: int = 15) -> DataFrame:
    """md5 bucket of seed:id in [0,100) -> train / validation / test."""
    b = hash_bucket(seed, "id")
    return df.withColumn(
        "split",
        F.when(b < train_pct, "train").when(b < train_pct + validation_pct, "validation").otherwise("test"),
    )


def subsample(df: DataFrame, n: int, seed: int) -> DataFrame:
    """Seeded uniform sample of exactly min(n, rows) rows; n <= 0 keeps all."""
    if n <= 0:
        return df
    return take_smallest(df, hash_rank_key(seed, "id"), n)


def stratified_fraction(df: DataFrame, frac: float, seed: int, by: str = "label") -> DataFrame:
    """Per stratum keep floor(count * frac) rows (exact size), when 0 < frac < 1."""
    if not 0 < frac < 1:
        return df
    return take_smallest(df, hash_rank_key(seed, "id"), lambda total: F.floor(total * F.lit(frac)), by=[by])


def low_resource_ladder(df: DataFrame, seed: int, ratios=LADDER, base: int = 0) -> DataFrame:
    """P5: nested samples of size max(1, floor(base * ratio)) for every ratio.

    base = train_samples when > 0, else the full row count. All ratios share
    one key order, so the samples are nested."""
    def size(total: Column) -> Column:
        b = F.lit(base) if base > 0 else total
        return F.least(total, F.greatest(F.lit(1), F.floor(b * F.col("ratio"))))
    return take_smallest_each(df, hash_rank_key(seed, "id"), "ratio", [float(r) for r in ratios], size)


def low_resource_stratified(df: DataFrame, seed: int, ratios=LADDER, by: str = "label") -> DataFrame:
    """The ladder ratios applied through P4 (per-stratum floor) on the full set."""
    def size(total: Column) -> Column:
        return F.when(F.col("ratio") < 1.0, F.floor(total * F.col("ratio"))).otherwise(total)
    return take_smallest_each(df, hash_rank_key(seed, "id"), "ratio", [float(r) for r in ratios], size, by=[by])


def target_label(df: DataFrame) -> DataFrame:
    """The flipped label."""
    return df.withColumn("target_label", (1 - F.col("label")).cast("int"))


# Length-bin edges declared by the reference's selector rules.
LENGTH_EDGES = (0, 20, 50, 200, 1000)


def length_bins(df: DataFrame, edges=LENGTH_EDGES) -> DataFrame:
    """Whitespace word count -> bin label, with per-bin row count and means."""
    words = F.size(F.filter(F.split(F.col("text"), r"\s+"), lambda w: F.length(w) > 0))
    expr = None
    for lo, hi in zip(edges[:-1], edges[1:]):
        cond = (words >= lo) & (words < hi)
        expr = F.when(cond, F.lit(f"{lo}-{hi}")) if expr is None else expr.when(cond, F.lit(f"{lo}-{hi}"))
    expr = expr.otherwise(F.lit(f"{edges[-1]}+"))
    return (
        df.withColumn("n_words", words).withColumn("length_bin", expr)
        .groupBy("length_bin")
        .agg(F.count(F.lit(1)).alias("n_rows"),
             F.round(F.avg("n_words"), 4).alias("mean_words"),
             F.round(F.avg("label"), 4).alias("positive_rate"))
    )


def domain_split(df: DataFrame, in_domain_lang: str = "en") -> DataFrame:
    """In-domain (lang) rows keep their split; all others form one OOD test set."""
    is_id = F.col("lang") == F.lit(in_domain_lang)
    return (
        df.withColumn("domain", F.when(is_id, "id").otherwise("ood"))
        .withColumn("split", F.when(is_id, F.col("split")).otherwise(F.lit("ood_test")))
    )


def prepared_samples(spark, root: str, p: Params) -> DataFrame:
    """S1 -> P1 -> P2 -> P9: every labelled sample with split and domain."""
    from ..sources.tables import load_samples
    df = preprocess(load_samples(spark, root, p.label_col))
    df = assign_split(df, p.split_seed, p.train_pct, p.validation_pct)
    return domain_split(df, p.in_domain_lang)


def train_samples(spark, root: str, p: Params) -> DataFrame:
    """In-domain train split, optionally cut to p.train_samples rows."""
    df = prepared_samples(spark, root, p)
    train = df.filter((F.col("domain") == "id") & (F.col("split") == "train"))
    return subsample(train, p.train_samples, p.seed)
