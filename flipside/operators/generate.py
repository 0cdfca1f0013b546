"""Candidate generation.

All rewrites are map-side expressions: the lexicon (bounded by its k pairs per
target) is folded into one array per target and inlined as a scalar subquery
(computed once, shipped as a literal), so a sample's
candidates are produced in the partition that holds the sample, with no
shuffle and without carrying text through an exchange.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, StructType

from ..functions.keys import hash_hex, hash_rank_key
from ..functions.sampling import take_smallest
from ..functions.text import capitalize, once

# Clause appended when no lexicon word occurs (our wording; depends on target).
UNCHANGED_CLAUSE = {0: " but it reads calmer overall.", 1: " but it reads harsher overall."}


def _pairs_both(lexicon: DataFrame) -> Column:
    """Both targets' pair lists from ONE scalar subquery (one lexicon pass)."""
    pair = F.struct("ordinal", "src", "dst")
    return lexicon.agg(F.struct(
        F.array_sort(F.collect_list(F.when(F.col("target_label") == 0, pair))).alias("t0"),
        F.array_sort(F.collect_list(F.when(F.col("target_label") == 1, pair))).alias("t1"),
    )).scalar()


def _swap(acc: Column, p: Column) -> Column:
    """str.replace(src, dst) then str.replace(Src, Dst), as chained in the reference."""
    return F.replace(F.replace(acc, p["src"], p["dst"]), capitalize(p["src"]), capitalize(p["dst"]))


def rewritten(df: DataFrame, pairs: Column, seed, k: int = 4) -> DataFrame:
    """Adds cand_text: the rewrite of one (id, round, ordinal) by at most k of ``pairs`` (an array of ordinal, src, dst),
    a pure function of text, target_label, id, round, ordinal and seed (a number or a column). Being
    deterministic, it can be recomputed after a shuffle instead of shipping the text through it."""
    return df.withColumn("cand_text", _rewrite(pairs, seed, F.col("round"), F.col("ordinal"), k))


def _rewrite(pairs: Column, seed, turn: Column, ordinal: Column, k: int) -> Column:
    keyed = F.transform(
        pairs,
        lambda p: F.struct(hash_hex(seed, F.col("id"), turn, ordinal, p["src"]).alias("k"),
                           p["src"].alias("src"), p["dst"].alias("dst")),
    )
    return _applied(F.slice(F.array_sort(keyed), 1, k))


def _applied(picked: Column) -> Column:
    """text with the pairs swapped one after the other, or with the target's clause where nothing changes."""
    clause = F.when(F.col("target_label") == 0, F.lit(UNCHANGED_CLAUSE[0])).otherwise(F.lit(UNCHANGED_CLAUSE[1]))
    return once(F.aggregate(picked, F.col("text"), _swap),
                lambda changed: F.when(changed == F.col("text"), F.concat(F.col("text"), clause)).otherwise(changed))


TURN = StructType().add("run", IntegerType()).add("round", IntegerType()).add("ordinal", IntegerType())
_MADE = ArrayType(StructType().add("set", IntegerType()).add("order", ArrayType(IntegerType())).add("turns", ArrayType(TURN)))


@F.arrow_udf(_MADE)
def _distinct_turns(ids: pa.Array, texts: pa.Array, sets: pa.Array, n: pa.Array, rounds: pa.Array, k: pa.Array) -> pa.Array:
    rows = zip(ids, texts, sets, n, rounds, k)
    return pa.array([_turns_of(*(x.as_py() for x in row)) for row in rows], to_arrow_type(_MADE))


def _turns_of(id_: str | None, text: str | None, sets: list[dict], n: int, rounds: int, k: int) -> list[dict]:
    """The different results of ``_rewrite`` for all sets, rounds and ordinals: the set and the places of its pairs, in
    order, that give one, and all turns that do. Nothing is copied out; the few texts are made where they are read."""
    found = turns_by_text(id_, text, sets, n, rounds, k) if text is not None else []
    return [{"set": number, "order": list(order), "turns": [dict(zip(TURN.names, t)) for t in at]} for _, number, order, at in found]


def turns_by_text(id_: str | None, text: str, sets: list[dict], n: int, rounds: int, k: int) -> list[tuple]:
    """(text with the pairs swapped, set, places of its pairs, [(run, round, ordinal)]) of each different result. A swap that
    was made in a text is remembered for all turns and sets; a set whose pairs change nothing needs no keys."""
    places, made = {text: 0}, [text]
    steps: dict[tuple, int] = {}

    def step(at: int, pair: tuple[str, str]) -> int:
        then = steps.get((at, pair))
        if then is None:
            src, dst = pair
            swapped = made[at].replace(src, dst).replace(src[:1].upper() + src[1:].lower(), dst[:1].upper() + dst[1:].lower())
            then = steps[at, pair] = places.setdefault(swapped, len(made))
            if then == len(made):
                made.append(swapped)
        return then

    found: dict[int, tuple] = {}
    for number, one in enumerate(sets):
        pairs = [(p["src"], p["dst"]) for p in one["pairs"] or []]
        if not any(step(0, pair) for pair in pairs):
            turns = found.setdefault(0, (text, number, (), []))[3]
            turns.extend((one["run"], turn, ordinal) for turn in range(1, rounds + 1) for ordinal in range(1, n + 1))
            continue
        start = ":".join([one["seed"]] + ([] if id_ is None else [id_]) + [""])
        ends = [(src.encode(), src, dst, i) for i, (src, dst) in enumerate(pairs)]
        for turn in range(1, rounds + 1):
            for ordinal in range(1, n + 1):
                head = f"{start}{turn}:{ordinal}:".encode()
                keyed = sorted((hashlib.md5(head + end).digest(), src, dst, i) for end, src, dst, i in ends)
                order = tuple(x[3] for x in keyed[:k])
                at = 0
                for i in order:
                    at = step(at, pairs[i])
                found.setdefault(at, (made[at], number, order, []))[3].append((one["run"], turn, ordinal))
    return list(found.values())


def rewrites_of_sets(samples: DataFrame, sets: Column, n: int, rounds: int = 1, k: int = 4) -> DataFrame:
    """``distinct_rewrites`` (with target_label) for several lexicons and seeds at once: ``sets`` is an array of (run, seed as text, pairs), turns are
    (run, round, ordinal), and a rewrite that several sets give is one row."""
    made = _distinct_turns(F.col("id").cast("string"), F.col("text"), sets, F.lit(n), F.lit(rounds), F.lit(k))
    pairs = lambda r: F.transform(r["order"], lambda i: F.get(F.get(sets, r["set"])["pairs"], i))
    return samples.withColumn("_r", F.explode(made)).select(
        *samples.columns, _applied(pairs(F.col("_r"))).alias("cand_text"), F.col("_r.turns").alias("turns"))


def distinct_rewrites(samples: DataFrame, pairs: Column, seed, n: int, rounds: int = 1, k: int = 4) -> DataFrame:
    """The rewrites of ``rewritten`` for all rounds and ordinals, equal ones of a sample once: cand_text and turns, the
    (round, ordinal) that give it, in place of round and ordinal. What is worked out of the two texts is then worked
    out once for all its turns; ``each_turn`` gives a row for each again. ``samples`` have target_label; their rewrites
    meet within the row."""
    every = F.transform(F.sequence(F.lit(0), F.lit(rounds * n - 1)), lambda i: F.struct(
        F.floor(i / n + 1).cast("int").alias("round"), (i % n + 1).cast("int").alias("ordinal")))
    made = F.transform(every, lambda t: F.struct(
        t["round"].alias("round"), t["ordinal"].alias("ordinal"), _rewrite(pairs, seed, t["round"], t["ordinal"], k).alias("cand_text")))
    grouped = once(made, lambda m: F.transform(F.array_distinct(m["cand_text"]), lambda text: F.struct(
        text.alias("cand_text"),
        F.transform(F.filter(m, lambda x: x["cand_text"] == text), lambda x: F.struct(x["round"].alias("round"), x["ordinal"].alias("ordinal"))).alias("turns"))))
    return samples.withColumn("_r", F.explode(grouped)).select(
        *samples.columns, F.col("_r.cand_text").alias("cand_text"), F.col("_r.turns").alias("turns"))


def each_turn(df: DataFrame) -> DataFrame:
    """A row for each (round, ordinal) of turns, with its candidate_id."""
    return df.withColumn("_turn", F.explode("turns")).drop("turns").select("*", "_turn.*").drop("_turn").withColumn(
        "candidate_id", F.concat(F.lit("c"), F.col("ordinal").cast("string")))


def pairs_of_target(df: DataFrame, lexicon: DataFrame) -> DataFrame:
    both = _pairs_both(lexicon)
    return df.withColumn("_pairs", F.when(F.col("target_label") == 0, both.getField("t0")).otherwise(both.getField("t1")))


def with_candidate_text(df: DataFrame, lexicon: DataFrame, seed: int, k: int = 4) -> DataFrame:
    """``rewritten`` with the pairs of one lexicon."""
    return rewritten(pairs_of_target(df, lexicon), F.col("_pairs"), seed, k).drop("_pairs")


def lexicon_candidates(samples: DataFrame, lexicon: DataFrame, n: int, seed: int,
                       rounds: int = 1, k: int = 4) -> DataFrame:
    """N candidates per sample and round. Each picks <= k lexicon pairs for
    its target (order = md5(seed:id:round:ordinal:src)), replaces them in that
    order, and appends a fixed clause when nothing changed.

    Output keeps every input column and adds round, ordinal, candidate_id,
    target_label, cand_text."""
    return each_turn(distinct_candidates(samples, lexicon, n, seed, rounds, k))


def distinct_candidates(samples: DataFrame, lexicon: DataFrame, n: int, seed: int,
                        rounds: int = 1, k: int = 4) -> DataFrame:
    """E1 with equal candidates of a sample in one row, see ``distinct_rewrites``."""
    base = samples.withColumn("target_label", (1 - F.col("label")).cast("int"))
    return distinct_rewrites(pairs_of_target(base, lexicon), F.col("_pairs"), seed, n, rounds, k).drop("_pairs")


def synonym_augment(samples: DataFrame, synonyms: DataFrame, ratio: float, seed: int,
                    keys_per_row: int = 3) -> DataFrame:
    """Sample int(n * ratio) rows (capped at n), then per row take
    keys_per_row synonym keys in seeded order and replace each one only if it
    occurs in the lower-cased current text. Labels are unchanged."""
    picked_rows = take_smallest(
        samples, hash_rank_key(seed, F.lit("synonym"), "id"),
        lambda total: F.least(total, F.floor(total * F.lit(float(ratio)))))
    # bounded list (k pairs) attached as an uncorrelated scalar subquery
    pairs = synonyms.agg(F.array_sort(F.collect_list(F.struct("ordinal", "src", "dst")))).scalar()
    return picked_rows.withColumn("_syn", pairs).select(
        "id", synonyms_replaced(F.col("text"), F.col("_syn"), seed, keys_per_row).alias("text"), "label", F.lit("synonym").alias("source"))


def synonyms_replaced(text: Column, pairs: Column, seed, keys_per_row: int = 3) -> Column:
    """``text`` with keys_per_row of ``pairs`` in seeded order, each replaced if it occurs in the lower-cased text so far."""
    keyed = F.transform(
        pairs,
        lambda p: F.struct(hash_hex(seed, F.col("id"), p["src"]).alias("k"), p["src"].alias("src"), p["dst"].alias("dst")),
    )
    chosen = F.slice(F.array_sort(keyed), 1, keys_per_row)

    def step(acc: Column, p: Column) -> Column:
        return F.when(F.lower(acc).contains(p["src"]), _swap(acc, p)).otherwise(acc)

    return F.aggregate(chosen, text, step)


def first_pass(verified: DataFrame, source: str = "single", texts=lambda rows: rows) -> tuple[DataFrame, DataFrame]:
    """Candidates are checked in ordinal order and the first `pass` wins. ``texts`` adds cand_text to the winners
    where ``verified`` has none.

    Returns (augmented rows, verifications up to and including the hit)."""
    w = Window.partitionBy("id")
    marked = verified.withColumn("_hit", F.min(F.when(F.col("status") == "pass", F.col("ordinal"))).over(w))
    ver = marked.filter(F.col("_hit").isNull() | (F.col("ordinal") <= F.col("_hit"))).drop("_hit")
    rows = texts(marked.filter(F.col("ordinal") == F.col("_hit"))).select(
        "id", F.col("cand_text").alias("text"), F.col("target_label").alias("label"), F.lit(source).alias("source"))
    return rows, ver


def single_shot(samples: DataFrame, lexicon: DataFrame, seed: int,
                responses_text: DataFrame | None = None) -> DataFrame:
    """One candidate per sample. A parsed model answer (id, first_text) wins
    when present and non-blank; otherwise the first rule candidate is used."""
    cands = lexicon_candidates(samples, lexicon, n=1, seed=seed, rounds=1)
    if responses_text is not None:
        cands = cands.join(responses_text.select("id", "first_text"), "id", "left").withColumn(
            "cand_text",
            F.coalesce(F.when(F.length(F.trim("first_text")) > 0, F.trim("first_text")), F.col("cand_text")),
        ).drop("first_text")
    return cands.filter(F.length(F.trim("cand_text")) > 0)
