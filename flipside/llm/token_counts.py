"""Token counts of whole documents by overlap resynchronisation.

A document of more than ``chunk`` characters is cut into chunks that overlap, and the chunks, spread over all
tasks, are encoded with offsets. The pre-tokenizer reads left to right and looks at nothing behind it, so where a
pre-token starts at the same character in both encodings of an overlap, the later chunk's encoding is the
document's own from there on, as the earlier one's is up to there: a proven boundary to splice at. Starts in
the last ``guard`` characters of a chunk are not used, since a special token's string may be cut there. Where an
overlap has no common boundary, the document is cut again with wider overlaps, until it is one chunk.

Shorter documents are encoded whole, segment by segment, with recurring segments remembered.

Defined cases: null and empty texts have 0 tokens; documents without any boundary end as one chunk; rows that
share an id get a row each; an empty table gives an empty one. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from flipside.llm.common import map_arrow, raw_texts, stored, texts
from flipside.llm.token_memo import token_memo


def _count(path: str, memo: int, chunk: int):
    encoder = token_memo(path, memo)

    def step(batch):
        found = texts(batch, "text")
        short = [len(t) <= chunk for t in found]
        counts = iter(len(x) // 4 for x in encoder.ids([t for t, s in zip(found, short) if s]))
        return {"row": batch["row"], "id": batch["id"], "n_bytes": [len(t) for t in raw_texts(batch, "text")],
                "n_tokens": [next(counts) if s else None for s in short],
                "text": [None if s else t for t, s in zip(found, short)]}

    return step


def _cut(chunk: int, overlap: int):
    def step(batch):
        for row, text in zip(batch["row"].to_pylist(), batch["text"].to_pylist()):
            starts = range(0, max(1, len(text) - overlap), chunk - overlap)
            for number, at in enumerate(starts):
                yield {"row": [row], "number": [number], "start": [at], "last": [at == starts[-1]], "text": [text[at:at + chunk]]}

    return step


def _encode(path: str, overlap: int, guard: int):
    tokenizer = token_memo(path, 0).tokenizer

    def step(batch):
        out = {k: [] for k in ("n", "head", "head_n", "tail", "tail_n")}
        for start, last, text in zip(batch["start"].to_pylist(), batch["last"].to_pylist(), batch["text"].to_pylist()):
            found = tokenizer.encode(text, add_special_tokens=False)
            owner = np.array([-1 if w is None else w for w in found.word_ids])
            at = np.array([a for a, _ in found.offsets], np.int64)
            first = np.ones(len(owner), bool)
            first[1:] = (owner[1:] != owner[:-1]) | (owner[1:] < 0)
            before = np.flatnonzero(first)  # tokens before each start of a pre-token
            at = at[before]
            head = at < overlap if start else np.zeros(len(at), bool)
            tail = (at >= len(text) - overlap) & (at < len(text) - guard) if not last else np.zeros(len(at), bool)
            for k, v in (("n", len(owner)), ("head", at[head] + start), ("head_n", before[head]), ("tail", at[tail] + start), ("tail_n", before[tail])):
                out[k].append(v)
        return {"row": batch["row"], "number": batch["number"]} | out

    return step


def splice(chunks: DataFrame) -> DataFrame:
    """row, n_tokens: null where an overlap has no common boundary."""
    earlier = chunks.select("row", (F.col("number") + 1).alias("number"), F.col("n").alias("n_before"), "tail", "tail_n")
    joined = chunks.drop("tail", "tail_n").join(earlier, ["row", "number"], "left")
    at = F.array_min(F.array_intersect("tail", "head"))
    reach = lambda places, counts: F.element_at(counts, F.array_position(places, at).cast("int"))
    own = F.when(F.col("number") == 0, F.col("n")).when(
        at.isNotNull(), F.col("n") + reach(F.col("tail"), F.col("tail_n")) - F.col("n_before") - reach(F.col("head"), F.col("head_n")))
    return joined.withColumn("own", own).groupBy("row").agg(
        F.when(F.count("own") == F.count("*"), F.sum("own")).alias("n_tokens"))


def count_tokens(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 chunk: int = 32_768, overlap: int = 512, guard: int = 64, memo: int = 1_000_000) -> DataFrame:
    """id, n_bytes, n_tokens."""
    docs = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    counted = stored(map_arrow(docs, f"row long, id {kind}, n_bytes long, n_tokens long, text string",
                               _count, tokenizer_path, memo, chunk), "counts")
    out = counted.where("n_tokens IS NOT NULL").select("id", "n_bytes", "n_tokens")
    pending = counted.where("n_tokens IS NULL")
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while not pending.isEmpty():
        cut = map_arrow(pending.select("row", "text"), "row long, number long, start long, last boolean, text string", _cut, chunk, overlap)
        chunks = map_arrow(cut.repartition(slices), "row long, number long, n long, head array<long>, head_n array<long>, tail array<long>, tail_n array<long>",
                           _encode, tokenizer_path, overlap, guard)
        spliced = stored(splice(stored(chunks, "chunks")), "spliced")
        done = pending.drop("n_tokens").join(spliced.where("n_tokens IS NOT NULL"), "row")
        out = out.union(done.select("id", "n_bytes", "n_tokens"))
        pending = pending.join(spliced.where("n_tokens IS NULL").select("row"), "row", "left_semi").select(*counted.columns)
        overlap *= 8
        chunk = max(chunk, 4 * overlap)
    return out.withColumnRenamed("id", id_col)
