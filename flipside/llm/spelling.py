"""Spelling variants of corpus words, found with a variable-length gram index.

The words of all documents are counted; two are near if one inserted, deleted or replaced character parts them. A
word's form is its near word of the greatest count, where that is ``ratio`` times its own or more, and its root is
where the chain of forms ends.

The gram dictionary is pruned by frequency: a gram is extended by the next character as long as it is frequent
among the words (and short enough), so rare sequences stand as short grams and common ones as long grams. In a
word, whose end is marked, one such gram starts at each place; which one follows from its own characters alone,
so an edit leaves all grams that it doesn't touch. For each word the number of grams that one edit can affect
bounds how many it must share with a near word. Lists are taken shortest first until one edit can't affect all
of them: two lists that don't overlap, since grams have at most half the word's length. A near word is in one
of these lists, at the same place or, beyond an inserted character, one further. Lists are keyed by gram,
place and lengths; their members are merged by a join, and confirmed by an exact comparison inside it.

Frequent means above 1 in ``most`` of all gram places, so that of each length at most ``most`` grams are frequent:
that bounds what is broadcast. Nothing else is, whatever size Spark estimates; there is no cap on words, lists or near
words.

Defined cases: null and empty texts have no words; a null id reads as empty; rows that share an id are documents of
their own; ties in count go to the first in code-point order; words without near words get 0 and nulls, and are
their own roots; an empty table gives an empty one. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from flipside.llm.common import map_arrow, raw_texts, stored

END = "$"


def _count(least: int, noise: int):
    find = re.compile(f"[a-zÀ-ÿ]{{{least},}}").findall

    def step(batch):
        total = Counter()
        for name, raw in zip(batch["id"].to_pylist(), raw_texts(batch, "text")):
            runs = Counter(find(raw.lower().decode()))  # of bytes, only A-Z are lowered
            start = crc32(f"{name or ''}:".encode())
            for run, n in runs.items():
                h = crc32(run.encode(), start)
                if noise and not h % noise:
                    at = h % len(run)
                    run = run[:at] + run[at + 1:]
                    if len(run) < least:
                        continue
                total[run] += n
        return {"word": list(total), "n": list(total.values())}

    return step


def corpus_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, occurrences: int = 5,
                 noise: int = 199) -> DataFrame:
    """word, n: distinct words of at least ``least`` characters and ``occurrences`` occurrences. In a document, a word whose
    crc32 with the id is divisible by ``noise`` lacks one character (0: none does)."""
    docs = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    counts = map_arrow(docs, "word string, n long", _count, least, noise)
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def _grams(longest: int):
    def step(batch):
        total = Counter()
        for word in batch["word"].to_pylist():
            marked = word + END
            for size in range(2, longest):
                total.update(marked[at:at + size] for at in range(len(marked) - size + 1))
        return {"gram": list(total), "f": list(total.values())}

    return step


def frequent_grams(words: DataFrame, longest: int = 6, most: int = 1 << 18, floor: int = 8) -> tuple[dict[str, int], int]:
    """The grams that the dictionary extends, with their frequency, and the frequency that they exceed."""
    places = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    limit = max(floor, places // most)
    counts = map_arrow(words.select("word"), "gram string, f long", _grams, longest)
    table = counts.groupBy("gram").agg(F.sum("f").alias("f")).where(F.col("f") > limit).toArrow()
    return dict(zip(table["gram"].to_pylist(), table["f"].to_pylist())), limit


class GramDictionary:
    def __init__(self, frequent: dict[str, int], limit: int, longest: int = 6):
        self.frequent, self.limit, self.longest = frequent, limit, longest

    def at_most(self, length: int) -> int:
        """The longest gram for queries of this length: half of it, so that a word has grams that don't overlap."""
        return min(self.longest, length // 2)

    def decompose(self, word: str, most: int) -> list[tuple[int, int]]:
        """Start and end of the gram at each place of the marked word."""
        marked, frequent, out = word + END, self.frequent, []
        n = len(marked)
        for start in range(n - 1):
            end = start + 2
            while end - start < most and end < n and marked[start:end] in frequent:
                end += 1
            out.append((start, end))
        return out

    def lists(self, word: str) -> list[tuple[int, int]]:
        """The grams whose lists hold all near words that are as long as the word or longer: shortest lists first, until
        one edit can't affect all; lists without which that still holds are left out."""
        marked = word + END
        grams = self.decompose(word, self.at_most(len(word)))
        size = lambda g: self.frequent.get(marked[g[0]:g[1]], self.limit // 2)
        taken: list[tuple[int, int]] = []
        for gram in sorted(grams, key=lambda g: (size(g), g)):
            for other in taken:
                if affected([gram, other]) < 2:
                    return [other, gram]
            taken.append(gram)
        raise ValueError("words need 4 characters at least")


def affected(grams: list[tuple[int, int]]) -> int:
    """The most grams that one edit can affect: they have a character in common, or a gap strictly inside."""
    return max(sum(a <= place < b for a, b in grams) for place in range(max(b for _, b in grams)))


def parity(word: str) -> int:
    """64 bits, of which one edit changes two at most."""
    bits = 0
    for c in word:
        bits ^= 1 << (ord(c) & 63)
    return bits - (1 << 64) if bits >> 63 else bits


def _key(gram: str, place: int, length: int, asked: int) -> int:
    return xxhash.xxh3_64_intdigest(f"{length} {asked} {place} {gram}")


def _lists(dictionary, least: int, asking: bool):
    grams: GramDictionary = dictionary.value

    def step(batch):
        keys, words, bits = [], [], []
        for word in batch["word"].to_pylist():
            n, marked = len(word), word + END
            if asking:  # a replaced character, then an inserted one behind and before the gram
                own = [_key(marked[a:b], a + shift, n + longer, n) for a, b in grams.lists(word)
                       for longer, shift in ((0, 0), (1, 0), (1, 1))]
            else:
                own = [_key(marked[a:b], a, n, asked) for asked in (n, n - 1) if asked >= least
                       for a, b in grams.decompose(word, grams.at_most(asked))]
            keys += own
            words += [word] * len(own)
            bits += [parity(word)] * len(own)
        return {"key": np.array(keys, np.uint64).view(np.int64), "word": words, "bits": bits}

    return step


def near_pairs(words: DataFrame, least: int = 6, longest: int = 6, most: int = 1 << 18, floor: int = 8) -> DataFrame:
    """a, b: each two words that one inserted, deleted or replaced character parts, once."""
    if least < 4:
        raise ValueError("words need 4 characters at least")
    dictionary = GramDictionary(*frequent_grams(words, longest, most, floor), longest)
    shared = words.sparkSession.sparkContext.broadcast(dictionary)
    schema = "key long, word string, bits long"
    asked, held = (map_arrow(words.select("word"), schema, _lists, shared, least, asking) for asking in (True, False))
    asked = asked.select("key", F.col("word").alias("a"), F.col("bits").alias("a_bits"))
    held = held.select("key", F.col("word").alias("b"), F.col("bits").alias("b_bits"))
    one = (F.bit_count(F.col("a_bits").bitwiseXOR(F.col("b_bits"))) <= 2) & (F.levenshtein("a", "b", 1) == 1)
    # of two words of a length either finds the other; once is enough
    once = (F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))
    # merged, never broadcast: Spark sizes a side by the words it is made from, and a word gives many keys
    pairs = asked.join(held.hint("merge"), (asked["key"] == held["key"]) & (F.col("a") != F.col("b")) & once & one)
    return pairs.select("a", "b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root from (word, form): chains are halved until none is left. Counts grow ``ratio``-fold along a chain, so
    that's a few rounds."""
    out = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        after = out.select(F.col("word").alias("root"), F.col("root").alias("next")).hint("merge")
        out = stored(out.join(after, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if out.where("moved").isEmpty():
            return out.select("word", "root")
        out = out.select("word", "root")


def variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, occurrences: int = 5,
             noise: int = 199, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n."""
    words = stored(corpus_words(df, id_col, text_col, least, occurrences, noise), "words")
    pairs = stored(near_pairs(words, least), "near")
    both = pairs.union(pairs.select("b", "a"))
    # tables of words are sized by their compressed files, a fraction of what they take as a broadcast
    both = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("b_n")).hint("merge"), "b")
    near = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("b_n"), F.col("b"))).alias("top"))
    near = near.select("word", "n_near", F.col("top.b").alias("form"), (-F.col("top.col1")).alias("form_n"))
    found = words.join(near.hint("merge"), "word", "left").withColumn("has", F.coalesce(F.col("form_n") >= ratio * F.col("n"), F.lit(False)))
    found = stored(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                F.when(F.col("has"), F.col("form")).alias("form"), F.when(F.col("has"), F.col("form_n")).alias("form_n")), "forms")
    ends = roots(found.where("form IS NOT NULL"))
    return found.join(ends.hint("merge"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
