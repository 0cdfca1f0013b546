"""Ranked lexical search with pair-bound MaxScore.

Documents are indexed in blocks of whole texts. For the terms asked for, a block has posting lists (place of the
document in the block, occurrences). Before it answers a query, a task computes each list's impacts and its
greatest one, and for pairs of terms that queries have in common use, frequent ones above all, the intersection
list with the greatest joint impact. What a pair can add to a document is then bounded by the greater of that
joint maximum and the two single maxima, which is less than their sum wherever the best documents of one term
lack the other.

A query's terms are dealt into pairs. Pairs are set aside, lowest bound first, as long as the sum of their bounds
stays below the score of the k-th document so far: a document with none but those terms can't get in. Only
lists of the other terms give candidates; the pairs set aside are then added, greatest bound first, to the
candidates that the bounds left over can still lift to the k-th score, by looking these up in the lists. Scores
are exact 64-bit integers.

A term's weight is floor(1000 * ln((2N + 2) / (2df + 1))); a document of n terms, of N documents with L terms in
all, has m = 75 + (25 * n * N) div L; its score sums weight * ((10^9 * tf) div (1000 * tf + 12 * m)) over the
query's terms, repeats included.

Queries go in blocks of about ``query_bytes`` of text (one query at least) through the driver and to the tasks, so
what is broadcast is bounded however many there are. Tasks keep k documents a query; the k best of all tasks'
are ranked by Spark.

Defined cases: null texts and texts without terms match nothing and don't count in N; queries without terms, or
with terms that no document has, give no rows, as do documents with score 0; rows that share an id are
documents, or queries, of their own; equal scores go by id, a null id last; empty tables give an empty result.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from flipside.llm.common import map_arrow, raw_texts, stored
from flipside.llm.decontaminate import words_of


def _index(vocabulary):
    known = {term: i for i, term in enumerate(vocabulary.value)}

    def step(batch):
        """One row for the block: ids, terms of each document, and the posting lists end to end."""
        sizes, rows, terms, counts = [], [], [], []
        for row, text in enumerate(raw_texts(batch, "text")):
            words = words_of(text)
            sizes.append(len(words))
            found = Counter(known[w] for w in words if w in known)
            rows += [row] * len(found)
            terms += found
            counts += found.values()
        term = np.array(terms, np.int64)
        order = np.argsort(term, kind="stable")
        which, lengths = np.unique(term, return_counts=True)
        return {"ids": [batch["id"].to_pylist()], "sizes": [sizes], "terms": [which], "lengths": [lengths],
                "rows": [np.array(rows, np.int32)[order]], "tf": [np.array(counts, np.int64)[order]]}

    return step


def build_index(df: DataFrame, vocabulary: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The blocks of all rows of ``df`` with the posting lists of the terms of ``vocabulary``, written as a table."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    schema = f"ids array<{kind}>, sizes array<long>, terms array<long>, lengths array<long>, rows array<int>, tf array<long>"
    return stored(map_arrow(docs, schema, _index, df.sparkSession.sparkContext.broadcast(vocabulary)), "lexical-index")


class Block:
    """A block's lists for the units (term, times in the query) of a query block."""

    def __init__(self, n_docs: int, sizes: list[int], terms, lengths, rows, tf, docs: int, total: int):
        self.n_docs = n_docs
        m = np.array([75 + 25 * n * docs // max(1, total) for n in sizes], np.int64)
        ends = np.cumsum(lengths)
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for term, start, end in zip(terms.tolist(), (ends - lengths).tolist(), ends.tolist()):
            place, n = rows[start:end], tf[start:end]
            self.lists[term] = place, 1_000_000_000 * n // (1000 * n + 12 * m[place])
        self.units: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, int]] = {}
        self.pairs: dict[tuple[tuple[int, int], tuple[int, int]], int] = {}

    def unit(self, unit: tuple[int, int], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Places, what the unit adds to each, and the most it adds."""
        if unit not in self.units:
            place, impact = self.lists[unit[0]]
            gain = impact * int(weights[unit[0]]) * unit[1]
            self.units[unit] = place, gain, int(gain.max())
        return self.units[unit]

    def pair(self, one: tuple[int, int], other: tuple[int, int], weights: np.ndarray) -> int:
        """The most that two units add to one document: the greatest joint impact over the intersection of their
        lists, or the greatest single one."""
        if (one, other) not in self.pairs:
            (a, x, most), (b, y, more) = self.unit(one, weights), self.unit(other, weights)
            if len(a) > len(b):
                a, x, b, y = b, y, a, x
            at = np.minimum(np.searchsorted(b, a), len(b) - 1)
            both = b[at] == a
            joint = int((x[both] + y[at[both]]).max()) if both.any() else 0
            self.pairs[one, other] = max(joint, most, more)
        return self.pairs[one, other]


def dealt_pairs(units: list[tuple[int, int]], weights: np.ndarray) -> list[tuple]:
    """A query's units in pairs, the most frequent terms first (they have the least weight and the longest lists), so
    that queries share pairs; a last one may be alone."""
    ordered = sorted(units, key=lambda u: (int(weights[u[0]]), u))
    return [tuple(ordered[i:i + 2]) for i in range(0, len(ordered), 2)]


def candidates(block: Block, groups: list[tuple], weights: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact scores of the documents of the block that can have a score of ``least`` or more (above 0)."""
    bounded = []
    for group in groups:
        here = [u for u in group if u[0] in block.lists and weights[u[0]] > 0]
        if here:
            bound = block.unit(here[0], weights)[2] if len(here) == 1 else block.pair(*here, weights)
            bounded.append((bound, here))
    bounded.sort(key=lambda b: (b[0], b[1]))
    aside, left = 0, 0  # the pairs set aside, and the sum of their bounds
    while aside < len(bounded) and left + bounded[aside][0] < least:
        left += bounded[aside][0]
        aside += 1
    scores = np.zeros(block.n_docs, np.int64)
    for _, group in bounded[aside:]:
        for unit in group:
            place, gain, _ = block.unit(unit, weights)
            scores[place] += gain
    places = np.flatnonzero(scores)
    scores = scores[places]
    for bound, group in reversed(bounded[:aside]):
        keep = scores + left >= least
        places, scores = places[keep], scores[keep]
        if not len(places):
            break
        for unit in group:
            place, gain, _ = block.unit(unit, weights)
            at = np.minimum(np.searchsorted(place, places), len(place) - 1)
            scores += np.where(place[at] == places, gain[at], 0)
        left -= bound
    keep = scores >= max(least, 1)
    return places[keep], scores[keep]


def _first(rows: list[tuple], k: int) -> list[tuple]:
    """The k best of (score, id) rows."""
    return sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1]) if r[1] is not None else (-r[0], True, 0))[:k]


def _answer(queries, weights, docs: int, total: int, k: int, arrow: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = [dealt_pairs(units, weights.value) for _, units in queries.value]
        best: list[list[tuple]] = [[] for _ in groups]
        for batch in batches:
            for at in range(batch.num_rows):
                column = lambda name: batch[name][at].values  # noqa: E731, B023
                ids = column("ids")
                block = Block(len(ids), column("sizes").to_pylist(), *(column(c).to_numpy() for c in ("terms", "lengths", "rows", "tf")), docs, total)
                for number, pairs in enumerate(groups):
                    so_far = best[number]
                    least = so_far[-1][0] if len(so_far) == k else 1
                    places, scores = candidates(block, pairs, weights.value, least)
                    if len(places) > k:
                        keep = scores >= np.partition(scores, -k)[-k]
                        places, scores = places[keep], scores[keep]
                    if len(places):
                        best[number] = _first(so_far + list(zip(scores.tolist(), ids.take(pa.array(places)).to_pylist())), k)
        rows = [(queries.value[q][0], q, i, s) for q, found in enumerate(best) for s, i in found]
        columns = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return run


def search(df: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", query_col: str = "item_id",
           query_text_col: str = "text", k: int = 20, query_bytes: int = 4 << 20) -> DataFrame:
    """query id, rank (from 1), id, score: the k documents of the highest score for each row of ``queries``."""
    spark = df.sparkSession
    asked = queries.select(F.col(query_col).alias("query"), F.coalesce(query_text_col, F.lit("")).alias("text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = -(-size // query_bytes) or 1
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query", "text"), F.lit(n_blocks)))
    kinds = asked.schema["query"].dataType, df.schema[id_col].dataType
    schema = StructType().add("query", kinds[0]).add("number", "long").add("id", kinds[1]).add("score", "long")
    out = None
    for number in range(n_blocks):
        some = [(r.query, words_of(r.text.encode())) for r in asked.where(F.col("block") == number).collect()]
        vocabulary = sorted({w for _, words in some for w in words})
        numbers = {w: i for i, w in enumerate(vocabulary)}
        units = [(query, sorted(Counter(numbers[w] for w in words).items())) for query, words in some]
        index = build_index(df, vocabulary, id_col, text_col)
        docs, total = index.agg(F.sum(F.size(F.filter("sizes", lambda n: n > 0))),
                                F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, n: a + n))).first()
        holders = index.select(F.explode(F.arrays_zip("terms", "lengths")).alias("t")).groupBy("t.terms").agg(F.sum("t.lengths").alias("df"))
        weights = np.zeros(len(vocabulary), np.int64)
        for term, df_ in holders.collect():
            weights[term] = np.floor(1000 * np.log((2 * docs + 2) / (2 * df_ + 1)))
        share = spark.sparkContext.broadcast
        found = index.mapInArrow(_answer(share(units), share(weights), docs or 0, total or 0, k, to_arrow_schema(schema)), schema)
        best = Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
        found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        found = found.select(F.col("query").alias(query_col), "rank", F.col("id").alias(id_col), "score")
        out = found if out is None else out.unionByName(found)
    return out
