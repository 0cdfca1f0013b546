"""E5: the multi-stage augmentation rounds, planned as one Catalyst job.

The reference loops: plan -> generate -> verify -> select, retrying a sample
with feedback until its selection is non-empty. With rule generation a
round's candidates do not depend on the previous round (feedback is only text
for a model), so every round is generated up front and the first round with a
non-empty selection is found with a window per sample:

* candidates = samples x rounds x ordinals (map-side explode), equal rewrites of a
  sample scored once;
* verification and scoring are map-side, but for the label weights (operators.rewrites);
* selection marks rows with windows over (id, round), the stop round is
  ``min(round) where selected`` over id -- all within the id hash partitioning
  of the label scores, so no further exchange is planned;
* verifications keep every round up to the stop round (all rounds if none),
  like the reference; selected rows come from the stop round only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.sampling import spread
from ..operators.generate import each_turn, with_candidate_text
from ..operators.planning import DEFAULT_PRESERVE, PRESERVE, rule_plan
from ..operators.rewrites import scored_candidates
from ..operators.score import DEFAULT_FEEDBACK, TextModel, verify
from ..operators.select import passes_thresholds
from ..params import Params


@dataclass
class RoundsResult:
    plans: DataFrame
    verifications: DataFrame
    selected: DataFrame
    feedback: DataFrame
    marked: DataFrame | None = None   # verifications + selected / stop_round flags


def split_marked(marked: DataFrame, source: str = "multi_stage") -> tuple[DataFrame, DataFrame]:
    """(selected rows, verifications) from the flagged verification table."""
    selected = marked.filter(F.col("selected") & (F.col("round") == F.col("stop_round"))).select(
        "id", F.col("cand_text").alias("text"), F.col("target_label").alias("label"),
        F.lit(source).alias("source"), "candidate_id", "final_score", "round", "ordinal")
    return selected, marked.drop("stop_round", "selected")


def _with_plan(samples: DataFrame, p: Params) -> DataFrame:
    preserve = PRESERVE if p.use_planner else DEFAULT_PRESERVE
    return samples.withColumn("elements_to_preserve", F.array(*[F.lit(x) for x in preserve]))


def mark_selected(ver: DataFrame, p: Params) -> DataFrame:
    """G4 (or G5 when the selector is ablated) as a boolean column per row,
    computed with windows over (id, round) only -- no join back, so rows and
    their text never leave their partition."""
    if not p.use_selector:
        return ver.withColumn("selected", F.col("status") == "pass")
    w = Window.partitionBy("id", "round")
    t = passes_thresholds(p)
    out = ver.withColumn("_t", t)
    if p.filtering_mode == "dynamic_percentile":
        q = max(0.0, min(1.0, 1.0 - float(p.percentile_keep)))
        out = (out.withColumn("_n", F.count(F.when(F.col("_t"), 1)).over(w))
               .withColumn("_cut", F.percentile(F.when(F.col("_t"), F.col("final_score")), F.lit(q)).over(w))
               .withColumn("_q", F.col("_t") & ((F.col("_n") <= p.keep_top_k) | (F.col("final_score") >= F.col("_cut")))))
    else:
        out = out.withColumn("_q", F.col("_t"))
    rank_w = w.orderBy(F.col("_q").desc(), F.col("final_score").desc(), F.col("ordinal"))
    return (out.withColumn("selected", F.col("_q") & (F.row_number().over(rank_w) <= p.keep_top_k))
            .drop("_t", "_n", "_cut", "_q"))


def augment_rounds(samples: DataFrame, lexicon: DataFrame, model: TextModel, p: Params,
                   source: str = "multi_stage", keep: Callable[[DataFrame], DataFrame] = lambda scores: scores) -> RoundsResult:
    """``keep`` may write the score rows (without texts), where several jobs read the result."""
    base = _with_plan(samples.select("id", "text", "label"), p)
    cands = scored_candidates(spread(base, "id"), lexicon, p.num_candidates, p.seed, p.rounds, p.pairs_per_candidate, method=p.edit_method)
    ver = each_turn(verify(cands, model, p).drop("elements_to_preserve", "label"))
    # The label scorer's partitioning on id, which only slim rows cross, serves
    # the (id, round) and (id) windows alike.
    marked = mark_selected(ver, p)
    stop = marked.withColumn(
        "stop_round", F.min(F.when(F.col("selected"), F.col("round"))).over(Window.partitionBy("id")))
    kept = keep(stop.filter(F.col("stop_round").isNull() | (F.col("round") <= F.col("stop_round"))))
    # Text comes back through a join on id with the samples (already hash
    # partitioned on id) and the rewrite is recomputed map-side.
    verifications = with_candidate_text(kept.join(base.select("id", "text"), "id"), lexicon, p.seed,
                                        p.pairs_per_candidate)
    selected, _ = split_marked(verifications, source)
    feedback = (
        kept.groupBy("id", "round")
        .agg(F.min_by(F.col("critique"), F.when(F.col("status") == "reject", F.col("ordinal"))).alias("_c"),
             F.max("stop_round").alias("_stop"))
        .filter(F.col("_stop").isNull() | (F.col("round") < F.col("_stop")))
        .select("id", (F.col("round") + 1).alias("round"),
                F.coalesce(F.col("_c"), F.lit(DEFAULT_FEEDBACK)).alias("feedback"))
        .filter(F.col("round") <= p.rounds)
    )
    plans = rule_plan(samples) if p.use_planner else None
    return RoundsResult(plans=plans, verifications=verifications.drop("stop_round", "selected"),
                        selected=selected, feedback=feedback, marked=verifications)


def variant_selection(ver: DataFrame, variants: dict[str, Params]) -> DataFrame:
    """J1 (selector-side variants): one verification set, every variant's
    selection in the same pass. The (bounded) variant list is exploded as a
    literal array on each row -- no join -- and windows run per
    (variant, id, round), still inside the id hash partitioning."""
    structs = []
    for name, p in variants.items():
        structs.append(F.struct(
            F.lit(name).alias("variant"), F.lit(float(p.th_label)).alias("th_label"),
            F.lit(float(p.th_semantic)).alias("th_semantic"), F.lit(float(p.th_final)).alias("th_final"),
            F.lit(p.filtering_mode == "dynamic_percentile").alias("dynamic"),
            F.lit(max(0.0, min(1.0, 1.0 - float(p.percentile_keep)))).alias("q"),
            F.lit(int(p.keep_top_k)).alias("k"), F.lit(bool(p.use_selector)).alias("use_selector")))
    v = ver.withColumn("_v", F.explode(F.array(*structs))).select("*", "_v.*").drop("_v")
    w = Window.partitionBy("variant", "id", "round")
    t = ((F.col("label_score") >= F.col("th_label")) & (F.col("semantic_score") >= F.col("th_semantic"))
         & (F.col("final_score") >= F.col("th_final")))
    # percentage must be a literal: one window column per distinct q (bounded by the variant list)
    qs = sorted({max(0.0, min(1.0, 1.0 - float(p.percentile_keep))) for p in variants.values()})
    cut = None
    for qv in qs:
        col = F.percentile(F.when(F.col("_t"), F.col("final_score")), F.lit(qv)).over(w)
        cut = F.when(F.col("q") == qv, col) if cut is None else cut.when(F.col("q") == qv, col)
    v = (v.withColumn("_t", t)
         .withColumn("_n", F.count(F.when(F.col("_t"), 1)).over(w))
         .withColumn("_cut", cut)
         .withColumn("_q", F.col("_t") & (~F.col("dynamic") | (F.col("_n") <= F.col("k"))
                                          | (F.col("final_score") >= F.col("_cut")))))
    rank_w = w.orderBy(F.col("_q").desc(), F.col("final_score").desc(), F.col("ordinal"))
    sel = F.when(F.col("use_selector"), F.col("_q") & (F.row_number().over(rank_w) <= F.col("k"))).otherwise(
        F.col("status") == "pass")
    return v.withColumn("selected", sel).drop("_t", "_n", "_cut", "_q", "th_label", "th_semantic", "th_final",
                                              "dynamic", "q", "k", "use_selector")


def augment_rounds_with_model(samples: DataFrame, factory, model: TextModel, p: Params,
                              source: str = "multi_stage", max_retries: int = 3, backoff: float = 1.0,
                              partitions: int | None = None, plan_with_model: bool = False) -> RoundsResult:
    """E5 with a completion function.

    ``plan_with_model``: the model is asked for a plan of each sample first; what it says replaces the rule plan's
    lists, those to preserve included, which the scores look at.

    Round r prompts every still-pending sample (with the previous round's
    feedback) and writes the replies once, as a stage table: each prompt is one
    call. Replies are parsed (D1); unreadable ones are asked for again in JSON
    (C6), then salvaged (D2), then asked for anew (``complete_candidates``);
    then scored and selected. Samples with a selection leave the pending set
    (left anti join). Rounds depend on each other through the feedback text, so
    this is a driver loop over rounds; the written tables cut the lineage."""
    from ..operators import responses as D
    from ..operators.planning import render_prompts
    from ..sources.stages import written

    base = _with_plan(samples.select("id", "text", "label"), p)
    plans = rule_plan(samples) if p.use_planner else None
    if plans is not None and plan_with_model:
        call = dict(max_retries=max_retries, backoff=backoff, partitions=partitions)
        parsed = written(D.extract_json(D.batch_complete(render_prompts(base, None, "planner"), factory, **call)), "plan-replies")
        repaired = written(D.extract_json(D.batch_complete(D.repair_requests(parsed), factory, **call)), "plan-repaired")
        plans = written(D.plans_from_replies(D.merge_repaired(parsed, repaired), plans), "plans")
        base = base.drop("elements_to_preserve").join(plans.select("id", "elements_to_preserve"), "id")
        plans = plans.drop("plan_source")
    pending = base
    feedback = None
    vers, sels, fbs = [], [], []
    for r in range(1, p.rounds + 1):
        req = pending.withColumn("round", F.lit(r))
        if feedback is not None:
            req = req.join(feedback.select("id", "feedback"), "id", "left")
        prompts = render_prompts(req, plans, "generator", num_candidates=p.num_candidates)
        cands = D.complete_candidates(prompts, factory, max_retries, backoff, partitions)
        cands = (cands.withColumn("ordinal", (F.col("pos") + 1).cast("int"))
                 .select("id", "round", "ordinal", "candidate_id", F.col("text").alias("cand_text"))
                 .join(pending.select("id", "text", "label", "elements_to_preserve"), "id")
                 .withColumn("target_label", (1 - F.col("label")).cast("int")))
        marked = written(mark_selected(verify(cands, model, p, samples=pending), p), "marked")
        sel = marked.filter("selected")
        vers.append(marked.drop("selected"))
        sels.append(sel.select("id", F.col("cand_text").alias("text"), F.col("target_label").alias("label"),
                               F.lit(source).alias("source"), "candidate_id", "final_score", "round", "ordinal"))
        done = sel.select("id").distinct()
        feedback = (marked.join(done, "id", "left_anti").groupBy("id")
                    .agg(F.min_by(F.col("critique"), F.when(F.col("status") == "reject", F.col("ordinal"))).alias("_c"))
                    .select("id", F.coalesce("_c", F.lit(DEFAULT_FEEDBACK)).alias("feedback")))
        # samples without any parsed candidate also retry with the default line
        pending = written(pending.join(done, "id", "left_anti"), "pending")
        feedback = written(pending.select("id").join(feedback, "id", "left").select(
            "id", F.coalesce("feedback", F.lit(DEFAULT_FEEDBACK)).alias("feedback")), "feedback")
        if r < p.rounds:
            fbs.append(feedback.withColumn("round", F.lit(r + 1)))
    union = lambda dfs: dfs[0] if len(dfs) == 1 else dfs[0].unionByName(union(dfs[1:]))
    fb = union(fbs).select("id", "round", "feedback") if fbs else None
    return RoundsResult(plans=plans, verifications=union(vers), selected=union(sels), feedback=fb)
