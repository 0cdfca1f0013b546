"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

Texts are equal when they are identical without white space. Each normalised text is cut where its own
characters say so, each chunk becomes (length, 64-bit hash, SHA-256), and a document becomes the ordered
list of its chunks: its recipe. Recipes that agree on lengths and 64-bit hashes are candidates; for these
the chunks are deduplicated to identifiers, verified by length, hash and SHA-256 together, and documents
are equal when their ordered identifier lists are. After the first pass over the texts only recipes move.

Defined cases: a null text is empty, and empty texts are equal to one another; ties in length go to the
smallest id, null after all others; rows that share an id, null too, are one document and get a row each; an
empty table gives an empty one. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flipside.llm.common import stored

#: [\x20\x09-\x0D]
WHITE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    for ch in WHITE:
        text = F.replace(text, F.lit(ch), F.lit(""))
    return text


def chunk_pattern(least: int, most: int) -> str:
    """A chunk ends after three characters of a fixed quarter of the code points below U+0100, which a regular
    expression tells by a bitmap; scripts beyond them are cut at ``most`` code points. Where a cut falls depends on
    the text since the last cut alone."""
    cuts = "".join(f"\\u{c:04x}" for c in range(0x21, 0x100) if c * 2654435761 % 2**32 >> 29 < 2)
    return f"(?s).{{{least},{most}}}?(?<=[{cuts}]{{3}})|.{{1,{most}}}"


def recipes(df: DataFrame, id_col: str, text_col: str, least: int, most: int) -> DataFrame:
    """One slim row a document: code points of the original, SHA-256 of the normalised text, chunks."""
    out = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = out.select("id", F.length("text").cast("long").alias("size"), normalised(F.col("text")).alias("norm"))
    chunk = lambda c: F.struct(
        F.length(c).alias("len"), F.xxhash64(c).alias("hash"), F.unhex(F.sha2(c, 256)).alias("sha"))
    return out.select(
        F.monotonically_increasing_id().alias("row"), "id", "size", F.sha2("norm", 256).alias("text_sha256"),
        F.transform(F.regexp_extract_all("norm", F.lit(chunk_pattern(least, most)), F.lit(0)), chunk).alias("chunks"),
    ).withColumn("weak", F.xxhash64(F.transform("chunks", lambda c: F.struct(c["len"], c["hash"]))))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 least: int = 128, most: int = 4096) -> DataFrame:
    """id, keep_id, group_size, kept, text_sha256: one row for each row of ``df``. Of equal texts the one with
    the most code points before normalisation stays, then the smallest id."""
    slim = stored(recipes(df, id_col, text_col, least, most), "recipes")
    repeated = slim.groupBy("weak").count().where("count > 1").select("weak")
    candidates = slim.join(repeated, "weak", "left_semi")

    chunks = candidates.select("row", F.posexplode("chunks").alias("pos", "chunk")).select("row", "pos", "chunk.*")
    identifiers = chunks.groupBy("len", "hash", "sha").agg(F.min(F.struct("row", "pos")).alias("ident"))
    lists = (
        chunks.join(identifiers, ["len", "hash", "sha"])
        .groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "ident"))).alias("recipe"))
        .select("row", F.transform("recipe", lambda x: x["ident"]).alias("recipe"))
    )
    empty = F.array().cast(lists.schema["recipe"].dataType)
    listed = stored(
        candidates.select("row", "id", "size").join(lists, "row", "left")
        .select("row", "id", "size", F.coalesce("recipe", empty).alias("recipe")), "recipe-lists")
    groups = listed.groupBy("recipe").agg(
        F.min(F.struct((-F.col("size")).alias("less"), F.col("id").isNull().alias("absent"), F.col("id").alias("keep_id"))).alias("best"),
        F.count("*").alias("group_size"))
    found = listed.join(groups, "recipe").select("row", "best.keep_id", "group_size")
    kept = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))  # a group's may be null
    return slim.join(found, "row", "left").select(
        F.col("id").alias(id_col), kept.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.col("id").eqNullSafe(kept).alias("kept"), "text_sha256")
