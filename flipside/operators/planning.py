"""Planning, prompt building, lexicons and call usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import token_set, whitespace_words

# Constant plan lists (our own wording; the reference fills the same five
# fields with constant lists in its rule planner).
CAUSAL = ["subject entities", "main event"]
SPURIOUS = ["tone words", "emotional register"]
PRESERVE = ["core entities", "event sequence"]
CONSTRAINTS = ["minimal edits", "keep entities unless needed", "stay fluent"]
# Planner ablated / single-generator baselines: fixed preserve lists.
DEFAULT_PRESERVE = ["topic", "event"]
SINGLE_PRESERVE = ["topic"]

# A token no [a-z']+ match can produce: counts documents per class.
DOC_SENTINEL = "\u0000doc"

# Fixed value: punctuation stripped from both ends of a change word.
STRIP_CHARS = ".,!?;:"


def _str_array(items) -> Column:
    return F.array(*[F.lit(x) for x in items]).cast("array<string>")


def rule_plan(samples: DataFrame) -> DataFrame:
    """change = first 4 whitespace words with raw length > 5, punctuation
    stripped from both ends after the length test; constant lists otherwise."""
    strip = "^[" + STRIP_CHARS + "]+|[" + STRIP_CHARS + "]+$"
    change = F.transform(
        F.slice(F.filter(whitespace_words(F.col("text")), lambda w: F.length(w) > 5), 1, 4),
        lambda w: F.regexp_replace(w, strip, ""),
    )
    return samples.select(
        "id",
        (1 - F.col("label")).cast("int").alias("target_label"),
        _str_array(CAUSAL).alias("causal_features"),
        _str_array(SPURIOUS).alias("spurious_features"),
        change.alias("elements_to_change"),
        _str_array(PRESERVE).alias("elements_to_preserve"),
        _str_array(CONSTRAINTS).alias("editing_constraints"),
    )


def default_plan(samples: DataFrame, preserve=DEFAULT_PRESERVE) -> DataFrame:
    """Planner ablated -- constant preserve list, nothing to change."""
    empty = F.array().cast("array<string>")
    return samples.select(
        "id",
        (1 - F.col("label")).cast("int").alias("target_label"),
        empty.alias("causal_features"),
        empty.alias("spurious_features"),
        empty.alias("elements_to_change"),
        _str_array(preserve).alias("elements_to_preserve"),
        empty.alias("editing_constraints"),
    )


# Prompt templates (our own wording). Placeholders are replaced column-wise.
PLANNER_TEMPLATE = (
    "Return one JSON object only. Plan a minimal edit of the text so that its label "
    "becomes {target_label}. Fields: id, target_label, causal_features, spurious_features, "
    "elements_to_change, elements_to_preserve, editing_constraints.\n"
    "id={id}\nlabel={label}\ntarget_label={target_label}\ntext={text}"
)
GENERATOR_TEMPLATE = (
    "Return one JSON object only: {\"candidates\": [{\"candidate_id\": \"c1\", \"text\": \"...\"}]}. "
    "Write {num_candidates} rewrites with label {target_label}, following the plan and fixing "
    "the feedback first.\nid={id}\ntext={text}\nplan={plan_json}\nfeedback={feedback}"
)
SINGLE_TEMPLATE = (
    "Return one JSON object with a field text: rewrite the text minimally so that its label "
    "becomes {target_label}.\nlabel={label}\ntext={text}"
)
TEMPLATES = {"planner": PLANNER_TEMPLATE, "generator": GENERATOR_TEMPLATE, "single": SINGLE_TEMPLATE}


def render_prompts(samples: DataFrame, plans: DataFrame | None, stage: str,
                   num_candidates: int = 3, template: str | None = None) -> DataFrame:
    """Fill a template per sample (plan joined on id; feedback column optional)."""
    template = template or TEMPLATES[stage]
    df = samples
    if plans is not None:
        plan_cols = [c for c in plans.columns if c not in ("id",)]
        df = df.join(plans.select("id", F.to_json(F.struct(*plan_cols)).alias("plan_json")), "id", "left")
    else:
        df = df.withColumn("plan_json", F.lit("{}"))
    if "feedback" not in df.columns:
        df = df.withColumn("feedback", F.lit(""))
    if "round" not in df.columns:
        df = df.withColumn("round", F.lit(1))
    values = {
        "{id}": F.col("id").cast("string"),
        "{label}": F.col("label").cast("string"),
        "{target_label}": (1 - F.col("label")).cast("string"),
        "{num_candidates}": F.lit(str(num_candidates)),
        "{plan_json}": F.coalesce(F.col("plan_json"), F.lit("{}")),
        "{feedback}": F.coalesce(F.col("feedback"), F.lit("")),
        "{text}": F.col("text"),   # last: text may itself contain braces
    }
    prompt = F.lit(template)
    for key, val in values.items():
        prompt = F.replace(prompt, F.lit(key), val)
    return df.select(
        F.concat_ws(":", F.lit(stage), F.col("id").cast("string"), F.col("round").cast("string")).alias("request_id"),
        "id", F.lit(stage).alias("stage"), F.col("round").cast("int").alias("round"),
        prompt.alias("prompt"),
    )


def token_label_stats(samples: DataFrame) -> DataFrame:
    """Per token: number of label-1 and label-0 documents containing it, plus
    the class document counts n1 / n0. One pass and one shuffle on token with
    map-side partial aggregation (hot tokens such as 'the' collapse before the
    exchange). Every document also emits a sentinel token (never a
    [a-z']+ match) whose counts are the class sizes; they are read back from
    the same aggregate as one scalar subquery."""
    sentinel = F.lit(DOC_SENTINEL)
    docs = samples.select("label", F.explode(F.array_union(token_set(F.col("text")), F.array(sentinel))).alias("token"))
    stats = docs.groupBy("token").agg(
        F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).cast("long").alias("df1"),
        F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).cast("long").alias("df0"),
    )
    n = stats.filter(F.col("token") == sentinel).select(F.struct("df1", "df0").alias("n")).scalar()
    return (stats.filter(F.col("token") != sentinel)
            .withColumn("n1", n.getField("df1")).withColumn("n0", n.getField("df0")))


def log_odds(alpha: float = 0.5) -> Column:
    """Smoothed log-odds of a token's document frequency, label 1 against 0, from df1, df0, n1, n0."""
    a = F.lit(alpha)
    return (F.log((F.col("df1") + a) / (F.col("n1") - F.col("df1") + a))
            - F.log((F.col("df0") + a) / (F.col("n0") - F.col("df0") + a)))


def cue_words(samples: DataFrame, k: int = 8, min_df: int = 2, alpha: float = 0.5) -> DataFrame:
    """Top-k cue tokens per label by smoothed log-odds of document frequency.

    ``row_number() <= k`` per label is planned as a WindowGroupLimit: each map
    partition keeps its own top k before the exchange."""
    scored = token_label_stats(samples).withColumn("lo", log_odds(alpha))
    pos = scored.filter(F.col("df1") >= min_df).select(F.lit(1).alias("cue_label"), "token", F.col("lo").alias("score"))
    neg = scored.filter(F.col("df0") >= min_df).select(F.lit(0).alias("cue_label"), "token", (-F.col("lo")).alias("score"))
    w = Window.partitionBy("cue_label").orderBy(F.col("score").desc(), F.col("token"))
    return (
        pos.unionByName(neg)
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
        .withColumn("score", F.round("score", 4))
    )


def mine_lexicon(samples: DataFrame, k: int = 8, min_df: int = 2) -> DataFrame:
    """C4: lexicon (target_label, ordinal, src, dst) mined from labelled text.

    For target t, the rank-i cue word of label 1-t is replaced by the rank-i
    cue word of label t. At most k rows per target: safe to broadcast."""
    cues = cue_words(samples, k, min_df).select("cue_label", "rank", "token")
    c1 = cues.filter("cue_label = 1").select("rank", F.col("token").alias("w1"))
    c0 = cues.filter("cue_label = 0").select("rank", F.col("token").alias("w0"))
    pairs = c1.join(c0, "rank")
    to0 = pairs.select(F.lit(0).alias("target_label"), F.col("rank").cast("int").alias("ordinal"),
                       F.col("w1").alias("src"), F.col("w0").alias("dst"))
    to1 = pairs.select(F.lit(1).alias("target_label"), F.col("rank").cast("int").alias("ordinal"),
                       F.col("w0").alias("src"), F.col("w1").alias("dst"))
    return to0.unionByName(to1)


def mine_synonyms(samples: DataFrame, k: int = 7, min_df: int = 2, min_len: int = 4) -> DataFrame:
    """Label-neutral swap pairs: the 2k most frequent tokens (length >= min_len)
    among those whose document frequency is balanced across labels (|log-odds|
    under 0.1), paired 1<->2, 3<->4, ... Returns (ordinal, src, dst)."""
    neutral = (
        token_label_stats(samples)
        .filter((F.length("token") >= min_len) & (F.col("df0") + F.col("df1") >= min_df) & (F.abs(log_odds()) < 0.1))
        .select("token", (F.col("df0") + F.col("df1")).alias("df"))
    )
    w = Window.partitionBy(F.lit(1)).orderBy(F.col("df").desc(), F.col("token"))
    top = neutral.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= 2 * k)
    a_side = top.filter(F.col("rank") % 2 == 1).select(((F.col("rank") + 1) / 2).cast("int").alias("ordinal"), F.col("token").alias("src"))
    b_side = top.filter(F.col("rank") % 2 == 0).select((F.col("rank") / 2).cast("int").alias("ordinal"), F.col("token").alias("dst"))
    return a_side.join(b_side, "ordinal")


def call_usage(log: DataFrame, ts: str = "ts", stage: str = "stage", model: str = "model",
               every: str = "1 hour") -> DataFrame:
    """Calls per (hour window, stage, model)."""
    return (
        log.groupBy(F.window(ts, every).alias("w"), F.col(stage).alias("stage"), F.col(model).alias("model"))
        .agg(F.count(F.lit(1)).alias("calls"))
        .select(F.col("w.start").alias("window_start"), "stage", "model", "calls")
    )
