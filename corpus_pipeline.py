"""The corpus pipeline: four filters over documents, then their token ids; each stage is written as Parquet and read again."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from flipside.llm import decontaminate, exact_dedup, minhash, pieces_codec, quality
from flipside.llm.common import documents, free_name, stored
from flipside.llm.queries import quality_model, tokenizer_path


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a unique number a row, and its column. A stored table's rows have a file and a place in it, the
    same at each reading; others are written first, so that each reading finds the same numbers."""
    row, path, number = (free_name(docs, x) for x in ("row", "path", "number"))
    try:
        if "_metadata" in docs.columns or not docs._jdf.queryExecution().analyzed().children().isEmpty():
            raise AnalysisException("not a table as read")
        placed = docs.withColumns({path: F.col("_metadata.file_path"), row: F.col("_metadata.row_index")})
    except AnalysisException:
        return stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row
    paths = sorted(r[0] for r in placed.select(path).distinct().collect())
    files = docs.sparkSession.createDataFrame(list(enumerate(paths)), f"`{number}` long, `{path}` string")
    placed = placed.join(F.broadcast(files), path)
    return placed.select(*[F.col(f"`{c}`") for c in docs.columns], (F.shiftleft(number, 40) + F.col(row)).alias(row)), row


def only(rows: DataFrame, kept: DataFrame, row: str) -> DataFrame:
    """The rows whose number is among the kept ones, without it."""
    # numbers are slim beside texts, which need no sorting
    return rows.join(kept.select(row).hint("shuffle_hash"), row, "left_semi").drop(row)


def order(row: str) -> list:
    """What decides between rows: the smallest doc_id, none at the end, then the row."""
    return [F.col("doc_id").isNull(), F.col("doc_id"), F.col(row)]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of a grade above the lowest is a half or more."""
    tails = free_name(docs, "tails")
    scored = quality.tail_probabilities(docs, quality_model(spark, sf_dir), out_col=tails)
    return scored.where(quality.selected(tails=tails)).drop(tails)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the longest, then by ``order``."""
    rows, row = numbered(docs)
    key = free_name(rows, "key")
    found = exact_dedup.exact_groups(rows.withColumn(key, F.struct(*order(row))), id_col=key)
    return only(rows, found.where("kept").select(F.col(f"{key}.{row}").alias(row)), row)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates, the first by ``order``; links from a similarity of 0.80."""
    rows, row = numbered(docs)
    found = minhash.near_duplicates(rows, id_col=row, percent=80).select(row, "component_id")
    first = found.join(rows.select(row, "doc_id"), row).groupBy("component_id").agg(F.min(F.struct(*order(row))).alias("first"))
    return only(rows, first.select(F.col(f"first.{row}").alias(row)), row)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text."""
    rows, row = numbered(docs)
    hits = decontaminate.find_hits(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=row)
    return only(rows, hits.where(~decontaminate.contaminated()), row)


#: Segments that a task of the last stage remembers: fewer than alone, since executors still hold what the stages before took.
MEMO = 300_000


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text."""
    return pieces_codec.round_trip(docs, tokenizer_path("piece_bpe_32k.model"), memo=MEMO)


STAGES = [
    ("quality", good),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontamination", decontaminated),
    ("sentencepiece", encoded),
]

#: The classifier and the encoder are beyond SQL; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
