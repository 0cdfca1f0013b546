"""Benchmark decontamination: Wu-Manber search for many word patterns at once.

Patterns are windows of ``width`` consecutive item words (a shorter item is one window). They are grouped
by length; in each group a shift table over blocks of words tells how far the search may jump when the
block under its end occurs in no pattern, or not at a pattern's end. Where the shift is zero, the block is the
suffix that selects a bucket of test windows, and comparing all words confirms an occurrence.

The benchmark is read in blocks of at most ``block_words`` words, so what a task holds is bounded however
long the benchmark is: documents pass each block's tables in turn, carrying the word spans hit so far.

Defined cases: null or empty texts have no words, so no hits; items without words have no windows; rows
without an item id are left out; rows that share an item id are one item, rows that share a document id get
a row each; an empty benchmark hits nothing. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window, functions as F

from flipside.llm.common import map_arrow, raw_texts, stored

#: Bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z; all others part words.
_WORD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
              for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD).split()


class WuManber:
    """Search tables for word windows of one length."""

    def __init__(self, windows: dict[tuple[bytes, ...], list[str]], length: int, block: int = 2):
        self.length, self.block = length, min(block, length)
        self.leap = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], list[tuple[tuple[bytes, ...], list[str]]]] = defaultdict(list)
        for window, items in windows.items():
            for end in range(self.block, length + 1):
                key = window[end - self.block:end]
                self.shift[key] = min(self.shift.get(key, self.leap), length - end)
            self.buckets[window[-self.block:]].append((window, items))

    def search(self, words: list[bytes]):
        """(first word, items) of each occurrence."""
        length, block, leap, shift, buckets = self.length, self.block, self.leap, self.shift, self.buckets
        at, n = length, len(words)
        while at <= n:
            key = tuple(words[at - block:at])
            jump = shift.get(key, leap)
            if jump:
                at += jump
                continue
            found = tuple(words[at - length:at])
            for window, items in buckets[key]:
                if window == found:
                    yield at - length, items
            at += 1


def windows_of(items: list[tuple[str, bytes]], width: int) -> list[WuManber]:
    """One search for each window length of these items."""
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        words = words_of(text)
        n = min(width, len(words))
        for at in range(len(words) - n + 1) if n else ():
            by_length[n][tuple(words[at:at + n])].add(item)
    return [WuManber({w: sorted(i) for w, i in found.items()}, n) for n, found in sorted(by_length.items())]


def _scan(items: list[tuple[str, bytes]], width: int, last: bool):
    searches = windows_of(items, width)

    def step(batch):
        n_words, spans, names, hit = [], [], [], []
        for text, before, known in zip(raw_texts(batch, "text"), batch["spans"].to_pylist(), batch["items"].to_pylist()):
            words = words_of(text)
            found, mine = [(x["start"], x["end"]) for x in before], set(known)
            for search in searches:
                for at, which in search.search(words):
                    found.append((at, at + search.length))
                    mine.update(which)
            merged: list[list[int]] = []
            for start, end in sorted(found):
                if merged and start <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], end)
                else:
                    merged.append([start, end])
            n_words.append(len(words))
            spans.append([{"start": a, "end": b} for a, b in merged])
            names.append(sorted(mine))
            hit.append(sum(b - a for a, b in merged))
        out = {"id": batch["id"], "n_words": n_words, "n_hit": hit, "spans": spans, "items": names}
        return out if last else out | {"text": batch["text"]}

    return step


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> DataFrame:
    """Items with the number of their block; a running sum of their sizes deals blocks of about
    ``block_words`` words, one item at least."""
    size = F.greatest(F.lit(1), F.ceil(F.octet_length(F.coalesce(text_col, F.lit(""))) / 2))
    return benchmark.where(F.col(item_col).isNotNull()).select(
        F.col(item_col).cast("string").alias("item"), F.coalesce(text_col, F.lit("")).alias("text"),
        F.floor((F.sum(size).over(Window.orderBy(F.col(item_col).cast("string"), text_col)) - size) / block_words).alias("block"))


def find_hits(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              item_col: str = "item_id", item_text_col: str = "text", width: int = 13,
              block_words: int = 2_000_000) -> DataFrame:
    """id, n_words, n_hit, spans (disjoint word ranges hit), items (ids whose windows occur, sorted)."""
    blocks = benchmark_blocks(benchmark, item_col, item_text_col, block_words)
    numbers = [r.block for r in blocks.select("block").distinct().orderBy("block").collect()] or [0]
    span = "array<struct<start:long,end:long>>"
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                     F.array().cast(span).alias("spans"), F.array().cast("array<string>").alias("items"))
    kind = docs.schema["id"].dataType.simpleString()
    for number in numbers:
        last = number == numbers[-1]
        items = [(r.item, r.text.encode()) for r in blocks.where(F.col("block") == number).select("item", "text").collect()]
        schema = f"id {kind}, n_words long, n_hit long, spans {span}, items array<string>" + ("" if last else ", text string")
        docs = map_arrow(docs, schema, _scan, items, width, last)
        docs = docs if last else stored(docs, "decontaminate")
    return docs.withColumnRenamed("id", id_col)


def contaminated() -> Column:
    """True where at least a twentieth of the words, and at least one, are hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
