"""Scoring and verification.

Every score but the label's is a map-side expression over one candidate row.
The label scorer is a Naive Bayes model kept as a table of token weights, which
rows meet by a join on their tokens: exact at any vocabulary size.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType

from ..functions.editdist import edit_similarity, levenshtein
from ..functions.text import TOKEN_PATTERN, once, set_cosine, tokens
from ..params import CRITIQUE_LIMITS, Params

@dataclass
class TextModel:
    """A fitted two-class Naive Bayes scorer, as lazy as any plan.

    ``weights``: one row per training token, w = log P(token|1) - log P(token|0);
    ``prior``: scalar, log P(1) - log P(0)."""

    weights: DataFrame
    prior: Column


def fit_text_classifier(train: DataFrame, text_col: str = "text") -> TextModel:
    """Multinomial Naive Bayes (smoothing 1) on (text, label) as a table of
    token weights: every token of the training texts has its row, however many
    there are. Token counts combine map-side, so a token of every document is
    one row per task before the shuffle; nothing comes to the driver."""
    toks = train.select(F.col("label").cast("int").alias("label"), F.explode(tokens(F.col(text_col))).alias("token"))
    counts = toks.groupBy("token").agg(F.sum("label").alias("c1"), F.sum(1 - F.col("label")).alias("c0"))
    total = counts.select(F.struct(F.sum("c1").alias("t1"), F.sum("c0").alias("t0"), F.count(F.lit(1)).alias("v"))).scalar()
    weights = counts.withColumn("_t", total).select(
        "token", (F.log(F.col("c1") + 1.0) - F.log(F.col("_t.t1") + F.col("_t.v") * 1.0)
                  - F.log(F.col("c0") + 1.0) + F.log(F.col("_t.t0") + F.col("_t.v") * 1.0)).alias("w"))
    docs = train.select(F.coalesce(F.log(F.sum("label") + 1.0) - F.log(F.sum(1 - F.col("label")) + 1.0), F.lit(0.0))).scalar()
    return TextModel(weights, docs)


def with_logit(model: TextModel, df: DataFrame, text_col: str, out: str) -> DataFrame:
    """log P(1 | text) - log P(0 | text) per row, by joining the row's tokens
    with the weights. Rows are known by id, and by round and ordinal where they
    have them; the sums of an id (a handful) come back as one list joined on
    id alone, so that rows partitioned by id, texts and all, stay where they are."""
    rest = [c for c in ("round", "ordinal") if c in df.columns]
    toks = df.select("id", *rest, F.explode(tokens(F.col(text_col))).alias("token"))
    sums = toks.join(model.weights, "token").groupBy("id", *rest).agg(F.sum("w").alias("_z"))
    sums = sums.groupBy("id").agg(F.collect_list(F.struct(*rest, "_z")).alias("_zs"))
    same = lambda z: [z[c] == F.col(c) for c in rest]
    own = F.filter("_zs", lambda z: reduce(lambda x, y: x & y, same(z), F.lit(True)))
    z = F.coalesce(F.try_element_at(own, F.lit(1))["_z"], F.lit(0.0))
    return df.join(sums, "id", "left").withColumn("_prior", model.prior).withColumn(out, z + F.col("_prior")).drop("_zs", "_prior")


def changed_tokens(text: Column, rewrite: Column) -> Column:
    """What a rewrite does to a text's tokens: array of (token, d), d = -1 for a token gone and 1 for a new one. Swapped
    words leave the others at their places, so comparing place by place finds few; any alignment is right, since
    what is listed on both sides cancels out."""
    return _changes(tokens(text), tokens(rewrite))


def _changes(mine: Column, theirs: Column) -> Column:
    both = F.zip_with(mine, theirs, lambda a, b: F.when(a.eqNullSafe(b), F.lit(None)).otherwise(
        F.array(F.struct(a.alias("token"), F.lit(-1).alias("d")), F.struct(b.alias("token"), F.lit(1).alias("d")))))
    return F.filter(F.flatten(F.filter(both, lambda p: p.isNotNull())), lambda t: t["token"].isNotNull())


#: Up to so many distinct changed tokens are looked up one by one; beyond, the token sets are compared whole.
FEW = 64


def token_diff(text: Column, rewrite: Column) -> Column:
    """(changed, semantic): ``changed_tokens`` and the cosine of the token sets, from one pass over each text. A token
    that only one of the two sets has is among the changed ones, so the few of these give both sets' sizes and overlap."""
    def sizes(t: Column, changed: Column) -> Column:
        def cosine(found: Column) -> Column:
            gone = F.size(F.filter(found, lambda x: ~F.array_contains(t["b"], x)))
            new = F.size(F.filter(found, lambda x: ~F.array_contains(t["a"], x)))
            of = once(F.struct(F.size(F.array_distinct(t["a"])).alias("n"), gone.alias("gone"), new.alias("new")), lambda s: _cosine(
                s["n"] - s["gone"], s["n"], s["n"] - s["gone"] + s["new"]))
            return F.when(F.size(found) <= FEW, of).otherwise(set_cosine(F.array_distinct(t["a"]), F.array_distinct(t["b"])))
        return once(F.array_distinct(changed["token"]), cosine)

    return once(F.struct(tokens(text).alias("a"), tokens(rewrite).alias("b")), lambda t: once(
        _changes(t["a"], t["b"]), lambda c: F.struct(c.alias("changed"), sizes(t, c).alias("semantic"))))


def _cosine(shared: Column, n: Column, m: Column) -> Column:
    denom = F.sqrt(n.cast("double") * m.cast("double"))
    return F.when(denom > 0, shared.cast("double") / denom).otherwise(F.lit(0.0))


WORDS = re.compile(TOKEN_PATTERN).findall
CHANGE = StructType().add("token", StringType()).add("d", IntegerType())
_DIFF = StructType().add("changed", ArrayType(CHANGE)).add("semantic", DoubleType())


@F.arrow_udf(_DIFF)
def token_changes(texts: pa.Array, rewrites: pa.Array) -> pa.Array:
    """``token_diff`` in one counting pass over each text, for many rewrites of long texts: the tokens that a rewrite
    has more (d > 0) or fewer (d < 0) of than its text, and the cosine of the two token sets."""
    out, last, own = [], None, None
    for text, rewrite in zip(texts, rewrites):
        text, rewrite = text.as_py(), rewrite.as_py()
        if text is None or rewrite is None:
            out.append({"changed": None, "semantic": 0.0})
            continue
        if text != last:   # a text's rewrites follow one another
            last, own = text, Counter(WORDS(text.lower()))
        new = Counter(WORDS(rewrite.lower()))
        changed = [{"token": t, "d": new[t] - c} for t, c in own.items() if new[t] != c] + [
            {"token": t, "d": c} for t, c in new.items() if t not in own]
        size = math.sqrt(float(len(own)) * float(len(new)))
        out.append({"changed": changed, "semantic": float(len(own.keys() & new.keys())) / size if size > 0 else 0.0})
    return pa.array(out, to_arrow_type(_DIFF))


def label_logits(samples: DataFrame, cands: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """``cands`` with logit: the summed weights of the rewrite's tokens. A sample's own tokens meet the weights once;
    a rewrite adds the weights of the tokens that it changes, which come back with its sample's sum, so that
    rewrites' tokens are neither shuffled nor joined, however many rewrites there are.

    ``samples``: keys, text; ``cands``: keys, text and cand_text, or _changed; ``weights``: (keys but id,) token, w."""
    if "_made" in cands.columns:
        return _logits_of_made(cands, weights)
    if "_changed" not in cands.columns:
        cands = cands.withColumn("_changed", changed_tokens(F.col("text"), F.col("cand_text")))
    own = samples.select(*keys, F.explode(tokens(F.col("text"))).alias("token"), F.lit(1).alias("tf"))
    new = cands.select(*keys, F.explode(F.array_distinct(F.transform("_changed", lambda t: t["token"]))).alias("token"), F.lit(0).alias("tf"))
    met = own.unionByName(new).join(weights, [*[k for k in keys if k != "id"], "token"])
    touched = F.when(F.col("tf") == 0, F.struct("token", "w"))
    met = met.groupBy(*keys).agg(F.sum(F.col("tf") * F.col("w")).alias("_own"), F.map_from_entries(F.collect_set(touched)).alias("_w"))
    moved = F.aggregate("_changed", F.lit(0.0), lambda z, t: z + t["d"] * F.coalesce(F.try_element_at("_w", t["token"]), F.lit(0.0)))
    return cands.join(met, keys, "left").withColumn("logit", F.coalesce("_own", F.lit(0.0)) + moved).drop("_changed", "_own", "_w")


#: In place of a token, with the sample's id after it: the row that carries what a sample holds besides tokens.
CARRIER = "\u0000of "


def _logits_of_made(cands: DataFrame, weights: DataFrame) -> DataFrame:
    """``label_logits`` of samples with ``_own`` and ``_made`` (operators.rewrites): a row for each different rewrite, with
    turns, _ss, _ms and _cs. Tokens and what else a sample holds take the way through the join in one table, so that
    the rewrites are made once; a row of its own, dealt by the id, carries the latter. Slim rows are dealt by id
    once, for the sums here and for the selection's windows."""
    rest = [c for c in cands.columns if c not in ("id", "_own", "_made")]
    touched = F.array_distinct(F.flatten(F.transform("_made", lambda m: m["changed"]["token"])))
    carrier = F.struct(F.concat(F.lit(CARRIER), F.coalesce(F.col("id").cast("string"), F.lit(""))).alias("token"), F.lit(None).cast("int").alias("tf"))
    rows = F.concat("_own", F.transform(touched, lambda t: F.struct(t.alias("token"), F.lit(0).alias("tf"))), F.array(carrier))
    held = F.struct(*rest, "_made")
    each = cands.select("id", held.alias("_held"), F.explode(rows).alias("_t")).select(
        "id", F.when(F.col("_t.tf").isNull(), F.col("_held")).alias("_held"), "_t.token", "_t.tf")
    known = F.col("id").isNotNull() & F.col("w").isNotNull()   # as by a join, a sample without id meets no weights
    new = F.when((F.col("tf") == 0) & known, F.struct("token", "w"))
    met = each.join(weights, "token", "left").repartition("id").groupBy("id").agg(
        F.coalesce(F.sum(F.when(known, F.col("tf") * F.col("w"))), F.lit(0.0)).alias("_sum"), F.map_from_entries(F.collect_set(new)).alias("_w"),
        F.collect_list("_held").alias("_held"))
    moved = F.aggregate("_m.changed", F.col("_sum"), lambda z, t: z + t["d"] * F.coalesce(F.try_element_at("_w", t["token"]), F.lit(0.0)))
    met = met.select("id", "_sum", "_w", F.explode("_held").alias("_held"))
    return met.select("id", *[F.col(f"_held.{c}").alias(c) for c in rest], "_sum", "_w", F.explode("_held._made").alias("_m")).select(
        "id", *rest, F.col("_m.turns").alias("turns"), F.col("_m.ss").alias("_ss"), F.col("_m.ms").alias("_ms"),
        F.get("_m.cs", F.lit(0)).alias("_cs"), moved.alias("logit"))


def probability_of(logit: Column, cls: Column) -> Column:
    """P(cls) of a two-class log-odds."""
    return 1 / (1 + F.exp(F.when(cls == 1, -logit).otherwise(logit)))


def predict(model: TextModel, df: DataFrame, text_col: str = "text") -> DataFrame:
    """Argmax class (0 on a tie) and P(class 1) for every row."""
    scored = with_logit(model, df, text_col, "_logit")
    return (scored.withColumn("prediction", (F.col("_logit") > 0).cast("int"))
            .withColumn("probability", 1 / (1 + F.exp(-F.col("_logit")))).drop("_logit"))


def label_score(model: TextModel, cands: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """P(target_label | candidate text) from the fitted classifier. ``samples`` (id, text) has each text
    that was rewritten once; without it, the candidates' own texts are taken, one of each id."""
    if "_made" not in cands.columns:
        samples = cands.select("id", "text").dropDuplicates(["id"]) if samples is None else samples.select("id", "text")
    scored = label_logits(samples, cands, model.weights, ["id"]).withColumn("_prior", model.prior)
    return scored.withColumn("label_score", probability_of(F.col("logit") + F.col("_prior"), F.col("target_label"))).drop("logit", "_prior")


def semantic_score(a: Column, b: Column) -> Column:
    """F3 (default plug): cosine of the two texts' binary token-set vectors."""
    return token_diff(a, b)["semantic"]


def embedding_cosine(a: Column, b: Column) -> Column:
    """cosine of two equal-length vectors (array<float|double>)."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    na = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    nb = F.sqrt(F.aggregate(b, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return F.when((na > 0) & (nb > 0), dot / (na * nb)).otherwise(F.lit(0.0))


def cue_score(cand: Column, target_words: Column, source_words: Column) -> Column:
    """F2: share of cue tokens that belong to the target label (0.5 if none)."""
    toks = tokens(cand)
    n_t = F.size(F.filter(toks, lambda t: F.array_contains(target_words, t))).cast("double")
    n_s = F.size(F.filter(toks, lambda t: F.array_contains(source_words, t))).cast("double")
    return F.when(n_t + n_s > 0, n_t / (n_t + n_s)).otherwise(F.lit(0.5))


def preserve_tokens(preserve: Column) -> Column:
    """First word of each non-blank preserve item, lower-cased."""
    items = F.filter(preserve, lambda x: F.length(F.trim(x)) > 0)
    return F.transform(items, lambda x: F.split(F.lower(F.trim(x)), r"\s+")[0])


def consistency_score(orig: Column, cand: Column, preserve: Column) -> Column:
    """share of preserve items whose first word occurs (as a substring) in
    both lower-cased texts; 0.8 when the plan has no items."""
    toks = preserve_tokens(preserve)
    both = F.struct(F.lower(orig).alias("o"), F.lower(cand).alias("c"))   # once a row, not once an item
    kept = F.size(once(both, lambda b: F.filter(toks, lambda t: b["o"].contains(t) & b["c"].contains(t)))).cast("double")
    n = F.size(toks)
    return F.when(n == 0, F.lit(0.8)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), kept / n)))


def final_score(p: Params) -> Column:
    """weighted sum of the four unrounded scores."""
    return (F.lit(p.w_label) * F.col("_ls") + F.lit(p.w_semantic) * F.col("_ss")
            + F.lit(p.w_minimality) * F.col("_ms") + F.lit(p.w_consistency) * F.col("_cs"))


# Critique texts (our wording); limits are the fixed ones, not the thresholds.
ISSUE_LABEL = "label flip too weak"
ISSUE_SEMANTIC = "meaning drifted too far"
ISSUE_EDIT = "too many edits"
GENERIC_CRITIQUE = "tighten fluency and keep the constraints"
DEFAULT_FEEDBACK = "strengthen the label flip with fewer edits"


def critique(ls: Column, ss: Column, ms: Column) -> Column:
    """failed axes against the fixed limits, or a generic line."""
    issues = F.concat_ws(
        "; ",
        F.when(ls < CRITIQUE_LIMITS["label"], F.lit(ISSUE_LABEL)),
        F.when(ss < CRITIQUE_LIMITS["semantic"], F.lit(ISSUE_SEMANTIC)),
        F.when(ms < CRITIQUE_LIMITS["minimality"], F.lit(ISSUE_EDIT)),
    )
    return F.when(issues == "", F.lit(GENERIC_CRITIQUE)).otherwise(issues)


def verify(cands: DataFrame, model: TextModel, p: Params, preserve_col: str = "elements_to_preserve",
           samples: DataFrame | None = None) -> DataFrame:
    """F1+F3+F5+F6 -> F7 -> F8 gate (unrounded) -> F9; stored scores rounded to 4 dp.

    Input columns: id, text (original), cand_text, target_label, preserve list. ``samples``: see label_score. What the
    two texts give is worked out before the join with the label weights, so that texts nobody reads later never
    reach its sorts. Samples with ``_own`` and ``_made`` (operators.rewrites) are taken in place of candidates' texts;
    then the rows are the different rewrites, with turns."""
    scored = cands
    if "_made" not in cands.columns:
        if samples is None:
            samples = cands.select("id", "text").dropDuplicates(["id"])
        scored = (
            cands.withColumn("_d", token_diff(F.col("text"), F.col("cand_text")))
            .withColumn("_ms", edit_similarity(F.col("text"), F.col("cand_text"), p.edit_method))
            .withColumn("_cs", consistency_score(F.col("text"), F.col("cand_text"), F.col(preserve_col)))
            .withColumn("_ss", F.col("_d.semantic")).withColumn("_changed", F.col("_d.changed")).drop("_d")
        )
    scored = label_score(model, scored, samples).withColumnRenamed("label_score", "_ls")
    scored = scored.withColumn("_fs", final_score(p))
    ok = ((F.col("_ls") >= p.th_label) & (F.col("_ss") >= p.th_semantic)
          & (F.col("_ms") >= p.th_minimality) & (F.col("_fs") >= p.th_final))
    return (
        scored.withColumn("status", F.when(ok, "pass").otherwise("reject"))
        .withColumn("critique", F.when(ok, F.lit("")).otherwise(critique(F.col("_ls"), F.col("_ss"), F.col("_ms"))))
        .withColumn("label_score", F.round("_ls", 4))
        .withColumn("semantic_score", F.round("_ss", 4))
        .withColumn("minimality_score", F.round("_ms", 4))
        .withColumn("consistency_score", F.round("_cs", 4))
        .withColumn("final_score", F.round("_fs", 4))
        .drop("_ls", "_ss", "_ms", "_cs", "_fs")
    )


@pandas_udf(DoubleType())
def _mean_pairwise_distance(texts: pd.Series) -> pd.Series:
    out = []
    for arr in texts:
        items = [] if arr is None else list(arr)
        if len(items) <= 1:
            out.append(0.0)
            continue
        vals = []
        for i in range(len(items)):
            for j in range(i + 1, len(items)):
                a, b = items[i], items[j]
                longest = max(len(a), len(b))
                vals.append(0.0 if longest == 0 else levenshtein(a, b) / longest)
        out.append(float(np.mean(vals)))
    return pd.Series(out, dtype="float64")


def diversity(cands: DataFrame, group=("id", "round")) -> DataFrame:
    """mean of 1 - edit similarity over unordered candidate pairs of a
    group (0 for a single candidate). A group's list is bounded by the number
    of candidates asked of the generator; pairs stay inside one row."""
    lists = cands.groupBy(*group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "cand_text"))), lambda s: s["cand_text"]).alias("_texts"),
        F.count(F.lit(1)).alias("n_candidates"))
    return lists.select(*group, "n_candidates", F.round(_mean_pairwise_distance("_texts"), 4).alias("diversity"))
