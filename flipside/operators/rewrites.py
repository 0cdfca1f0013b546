"""E1 with F3, F5 and F6: the different rewrites of a sample and what its texts give, made a sample at a time.

A sample's text goes to Python once; of its rewrites only scores and changed tokens come back, whatever their number and
length. Texts of rewrites that a step reads later are made anew from (text, id, round, ordinal, lexicon). F1 and F7 to F9
follow in ``score.verify``, which takes the columns ``_own`` and ``_made`` in place of the rewrites' texts.
"""

from __future__ import annotations

import difflib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType

from ..functions.editdist import distances
from .generate import TURN, UNCHANGED_CLAUSE, pairs_of_target, turns_by_text
from .score import CHANGE, WORDS, preserve_tokens

_TOKEN = StructType().add("token", StringType()).add("tf", IntegerType())
_REWRITE = (StructType().add("turns", ArrayType(TURN)).add("changed", ArrayType(CHANGE)).add("ss", DoubleType())
            .add("ms", DoubleType()).add("cs", ArrayType(DoubleType())))
_SCORED = StructType().add("own", ArrayType(_TOKEN)).add("made", ArrayType(_REWRITE))


def _struct(kind: pa.DataType, columns: list) -> pa.StructArray:
    return pa.StructArray.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, kind)], fields=list(kind))


def _lists(kind: pa.DataType, sizes: list[int], values: pa.Array) -> pa.ListArray:
    ends = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, type=kind)


def changes(words: list[str], own: Counter, text: str, rewrite: str) -> dict[str, int]:
    """token -> how many more the rewrite has than its text (none of 0). Tokens hold no space, so where both have as many
    words (``words``, the text split at spaces), only those that differ are looked into."""
    others = rewrite.split(" ")
    if len(words) == len(others):
        gone, new = Counter(), Counter()
        for a, b in zip(words, others):
            if a != b:
                gone.update(WORDS(a.lower()))
                new.update(WORDS(b.lower()))
    else:
        gone, new = own, Counter(WORDS(rewrite.lower()))
    return {t: d for t in gone.keys() | new.keys() if (d := new[t] - gone[t])}


def cosine(own: Counter, changed: dict[str, int]) -> float:
    """Cosine of the token sets of a text and of its rewrite."""
    shared = len(own) - sum(1 for t, d in changed.items() if t in own and own[t] + d == 0)
    size = math.sqrt(float(len(own)) * float(shared + sum(1 for t in changed if t not in own)))
    return float(shared) / size if size > 0 else 0.0


def _consistency(text: str, rewrite: str, items: list[str]) -> float:
    return min(1.0, max(0.0, float(sum(1 for t in items if t in text and t in rewrite)) / len(items))) if items else 0.8


@F.arrow_udf(_SCORED)
def _scored(ids: pa.Array, texts: pa.Array, targets: pa.Array, sets: pa.Array, n: pa.Array, rounds: pa.Array, k: pa.Array,
            preserve: pa.Array, method: pa.Array) -> pa.Array:
    kind = to_arrow_type(_SCORED)
    if not len(ids):
        return pa.array([], kind)
    fixed = [x[0].as_py() for x in (n, rounds, k)]
    tokens, tfs, n_own, n_made = [], [], [], []                 # of samples
    n_turns, n_changed, semantic, longest, kept, n_kept = [], [], [], [], [], []   # of rewrites
    turns, changed = ([], [], []), ([], [])

    def pairs():
        for id_, text, target, one, lists in zip(ids, texts, targets, sets, preserve):
            text, lists = text.as_py(), lists.as_py()
            if text is None:
                n_own.append(0)
                n_made.append(0)
                continue
            words, low = text.split(" "), text.lower()
            own = Counter(WORDS(low))
            tokens.extend(own)
            tfs.extend(own.values())
            n_own.append(len(own))
            found = turns_by_text(id_.as_py(), text, one.as_py(), *fixed)
            n_made.append(len(found))
            for rewrite, _, _, at in found:
                if rewrite == text:
                    rewrite = text + UNCHANGED_CLAUSE[0 if target.as_py() == 0 else 1]
                diff = changes(words, own, text, rewrite)
                changed[0].extend(diff)
                changed[1].extend(diff.values())
                n_changed.append(len(diff))
                semantic.append(cosine(own, diff))
                for column, values in zip(turns, zip(*at)):
                    column.extend(values)
                n_turns.append(len(at))
                other = rewrite.lower()
                kept.extend(_consistency(low, other, items) for items in lists)
                n_kept.append(len(lists))
                longest.append(max(len(text), len(rewrite)))
                yield text, rewrite

    if method[0].as_py() == "ratcliff":
        edits = [float(difflib.SequenceMatcher(a=a, b=b).ratio()) for a, b in pairs()]
    else:
        edits = [1.0 if size == 0 else 1.0 - float(d) / float(size) for d, size in zip(distances(pairs()), longest)]
    own_kind, made_kind = kind.field("own").type, kind.field("made").type
    row = made_kind.value_type
    lists = lambda name, sizes, columns: _lists(row.field(name).type, sizes, _struct(row.field(name).type.value_type, columns))
    made = _struct(row, [lists("turns", n_turns, turns), lists("changed", n_changed, changed), semantic, edits,
                         _lists(row.field("cs").type, n_kept, pa.array(kept, pa.float64()))])
    return _struct(kind, [_lists(own_kind, n_own, _struct(own_kind.value_type, [tokens, tfs])), _lists(made_kind, n_made, made)])


def scored_of_sets(samples: DataFrame, sets: Column, n: int, rounds: int, k: int, preserve: list[Column], method: str = "levenshtein") -> DataFrame:
    """``samples`` (id, text, target_label, ...) with ``_own``, the text's tokens as (token, tf), and ``_made``, a row for each
    different rewrite: its turns (run, round, ordinal) in all ``sets`` (see ``generate.rewrites_of_sets``), the tokens
    it changes as (token, d), and the unrounded scores ss, ms, and cs for each of the lists ``preserve``."""
    items = F.array(*[preserve_tokens(items) for items in preserve])
    out = _scored(F.col("id").cast("string"), F.col("text"), F.col("target_label"), sets, F.lit(n), F.lit(rounds), F.lit(k), items, F.lit(method))
    return samples.select("*", F.inline(F.array(out)).alias("_own", "_made"))   # one call a row, whatever is read of it


def scored_candidates(samples: DataFrame, lexicon: DataFrame, n: int, seed: int, rounds: int = 1, k: int = 4,
                      preserve_col: str = "elements_to_preserve", method: str = "levenshtein") -> DataFrame:
    """E1 as ``generate.distinct_candidates``, with ``_own`` and ``_made`` in place of the texts."""
    base = pairs_of_target(samples.withColumn("target_label", (1 - F.col("label")).cast("int")), lexicon)
    sets = F.array(F.struct(F.lit(0).alias("run"), F.lit(str(seed)).alias("seed"), F.col("_pairs").alias("pairs")))
    return scored_of_sets(base, sets, n, rounds, k, [F.col(preserve_col)], method).drop("text", "_pairs")
