"""The registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flipside.llm import (
    context_mixing, decontaminate, exact_dedup, lang_kernel, lexical_search, minhash, pieces_codec, quality, records, spelling, token_counts,
    toxic_spans, warc)
from flipside.llm.common import documents, fold


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded ratings of labelled documents: 0 low quality, 1 good but toxic, 2 good and not toxic."""
    grade = F.col("quality") * F.when(F.col("toxic") == 1, 1).otherwise(2)
    return labels(spark, sf_dir).where(fold("doc_id", 5) != 0).select("doc_id", grade.alias("grade"))


def quality_model(spark: SparkSession, sf_dir: str):
    return quality.fit(documents(spark, sf_dir), ratings(spark, sf_dir), grades=3)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, expected_grade (0 to 2), p_good (grade 1 or more), p_best (grade 2), kept."""
    scored = quality.tail_probabilities(documents(spark, sf_dir), quality_model(spark, sf_dir), keep=["doc_id"])
    return scored.select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), quality.expected_grade().alias("expected_grade"),
        F.element_at("tails", 1).alias("p_good"), F.element_at("tails", 2).alias("p_best"), quality.selected().alias("kept"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces_codec.round_trip(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.find_hits(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    field = toxic_spans.fit(docs, labels(spark, sf_dir), fold("doc_id", 5) != 0)
    return toxic_spans.tag(docs, field).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def op5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = records.write_records(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))
    return records.read_records(manifest, folder)


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = lang_kernel.fit(docs, fold("doc_id", 4) != 2)
    return lang_kernel.predict(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = warc.write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return warc.read_warc(manifest, folder, columns=("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


def op11_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = context_mixing.score_texts(documents(spark, sf_dir), fold("doc_id", 10) != 0)
    return scored.select("doc_id", (fold("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score",
                         "bits_per_byte")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_decontamination": op3_decontamination,
    "op4_toxicity": op4_toxicity,
    "op5_records": op5_records,
    "op6_minhash": op6_minhash,
    "op7_language": op7_language,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_warc": op10_warc,
    "op11_context_mixing": op11_context_mixing,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_lexical_search": op13_lexical_search,
}
