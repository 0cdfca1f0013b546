"""Registered queries: one per operator of the inventory, each reading the
given tables at ``root`` (whole tables, whole texts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.keys import hash_bucket
from ..operators import planning as C
from ..operators import sampling as S
from ..operators import score as SC
from ..operators import select as G
from ..functions.sampling import spread
from ..operators.generate import (distinct_candidates, each_turn, first_pass, lexicon_candidates, single_shot, synonym_augment,
                                  with_candidate_text)
from ..operators.rewrites import scored_candidates
from ..params import MULTI_STAGE, Params
from ..sources.stages import written
from ..sources.tables import load_samples, read_table
from .rounds import augment_rounds

P = MULTI_STAGE


def _train(spark, root, p: Params = P) -> DataFrame:
    """The in-domain train split (recomputed per use: a cached copy per query
    would register one more plan with the cache manager for every query)."""
    return S.train_samples(spark, root, p)


def _train_once(spark, root, p: Params = P) -> DataFrame:
    """The same as a table written once, where lexicon, model, rewrites and texts all read it."""
    return written(_train(spark, root, p).select("id", "text", "label"), "train")


def _lexicon(spark, root, p: Params = P, train: DataFrame | None = None) -> DataFrame:
    return C.mine_lexicon(_train(spark, root, p) if train is None else train, p.lexicon_size, p.lexicon_min_df)


def _model(spark, root, p: Params = P, train: DataFrame | None = None):
    return SC.fit_text_classifier(_train(spark, root, p) if train is None else train)


def _round1(spark, root, p: Params = P, preserve=C.PRESERVE, samples: DataFrame | None = None) -> DataFrame:
    """E1 candidates (one round, num_candidates each) for the train samples, or others."""
    base = (_train(spark, root, p) if samples is None else samples).select("id", "text", "label").withColumn(
        "elements_to_preserve", F.array(*[F.lit(x) for x in preserve]))
    return lexicon_candidates(base, _lexicon(spark, root, p), p.num_candidates, p.seed, 1, p.pairs_per_candidate)


def _distinct1(spark, root, p: Params = P, preserve=C.PRESERVE, samples: DataFrame | None = None) -> DataFrame:
    """The same with equal candidates of a sample in one row."""
    base = (_train(spark, root, p) if samples is None else samples).select("id", "text", "label").withColumn(
        "elements_to_preserve", F.array(*[F.lit(x) for x in preserve]))
    return distinct_candidates(base, _lexicon(spark, root, p), p.num_candidates, p.seed, 1, p.pairs_per_candidate)


def _scored1_all(spark, root, name: str, score) -> DataFrame:
    """``score`` (a column) of the candidates of all prepared samples, whatever their split and language."""
    cands = _distinct1(spark, root, samples=S.prepared_samples(spark, root, P))
    return each_turn(cands.select("id", "turns", F.round(score, 4).alias(name))).select("id", "ordinal", name)


def _verified1(spark, root, p: Params = P, preserve=C.PRESERVE):
    """The verified E1 candidates of one round, as score rows, and what adds cand_text to rows of them."""
    train = _train_once(spark, root, p)
    lexicon = written(_lexicon(spark, root, p, train), "lexicon")
    base = spread(train.withColumn("elements_to_preserve", F.array(*[F.lit(x) for x in preserve])), "id")
    cands = scored_candidates(base, lexicon, p.num_candidates, p.seed, 1, p.pairs_per_candidate, method=p.edit_method)
    ver = each_turn(SC.verify(cands, _model(spark, root, p, train), p))
    return ver, lambda rows: with_candidate_text(rows.join(train.select("id", "text"), "id"), lexicon, p.seed, p.pairs_per_candidate)


SCORES = ["label_score", "semantic_score", "minimality_score", "consistency_score", "final_score"]
VER_COLS = ["id", "round", "ordinal", "candidate_id", "target_label", *SCORES, "status", "critique"]


# ---- sources and sample preparation ---------------------------------------------------------------

def s1_load_samples(spark, root):
    return load_samples(spark, root, P.label_col)


def p1_preprocess(spark, root):
    return S.preprocess(load_samples(spark, root, P.label_col))


def p2_assign_split(spark, root):
    return S.assign_split(S.preprocess(load_samples(spark, root, P.label_col)), P.split_seed).select("id", "split")


def p3_subsample(spark, root):
    return S.subsample(S.prepared_samples(spark, root, P), 100, P.seed).select("id", "label")


def p4_stratified_fraction(spark, root):
    return S.stratified_fraction(_train(spark, root), 0.3, P.seed).select("id", "label")


def p5_low_resource_ladder(spark, root):
    return S.low_resource_ladder(_train(spark, root), P.seed).select("ratio", "id")


def p6_low_resource_stratified(spark, root):
    return S.low_resource_stratified(_train(spark, root), P.seed).select("ratio", "id", "label")


def p7_target_label(spark, root):
    return S.target_label(S.prepared_samples(spark, root, P)).select("id", "label", "target_label")


def p8_length_bins(spark, root):
    return S.length_bins(S.prepared_samples(spark, root, P))


def p9_domain_split(spark, root):
    return S.prepared_samples(spark, root, P).select("id", "domain", "split")


# ---- planning ---------------------------------------------------------------------------------------

def c1_rule_plan(spark, root):
    return C.rule_plan(S.prepared_samples(spark, root, P)).select(
        "id", "target_label", F.concat_ws("|", "elements_to_change").alias("elements_to_change"),
        F.concat_ws("|", "elements_to_preserve").alias("elements_to_preserve"),
        F.concat_ws("|", "causal_features").alias("causal_features"))


def c2_default_plan(spark, root):
    return C.default_plan(S.prepared_samples(spark, root, P)).select(
        "id", "target_label", F.concat_ws("|", "elements_to_preserve").alias("elements_to_preserve"),
        F.size("elements_to_change").alias("n_change"))


def c3_render_prompts(spark, root):
    return C.render_prompts(S.prepared_samples(spark, root, P), None, "planner").select("request_id", "id", "stage", "round", "prompt")


def c4_cue_lexicon(spark, root):
    return _lexicon(spark, root)


def c7_call_usage(spark, root):
    ev = read_table(spark, root, "events").select("ts", F.col("event_type").alias("stage"),
                                                  F.lit("rule").alias("model"))
    return C.call_usage(ev)


# ---- generation ---------------------------------------------------------------------------------------

def e1_lexicon_candidates(spark, root):
    return _round1(spark, root).select("id", "round", "ordinal", "candidate_id", "target_label", "cand_text")


def e2_synonym_augment(spark, root):
    tr = _train(spark, root)
    return synonym_augment(tr, C.mine_synonyms(tr), P.ratio, P.seed)


def _single_verified(spark, root, p: Params = P):
    return _verified1(spark, root, p, C.SINGLE_PRESERVE)


def e3_first_pass(spark, root):
    ver, texts = _single_verified(spark, root)
    rows, _ = first_pass(ver, texts=texts)
    return rows


def e3_first_pass_verifications(spark, root):
    _, ver = first_pass(_single_verified(spark, root)[0], texts=lambda rows: rows.withColumn("cand_text", F.lit("")))
    return ver.select(*VER_COLS)


def e4_single_shot(spark, root):
    base = _train(spark, root).select("id", "text", "label").withColumn(
        "elements_to_preserve", F.array(*[F.lit(x) for x in C.SINGLE_PRESERVE]))
    cands = single_shot(base, _lexicon(spark, root), P.seed)
    ver = SC.verify(cands, _model(spark, root), P)
    return ver.filter(F.col("status") == "pass").select(
        "id", F.col("cand_text").alias("text"), F.col("target_label").alias("label"), F.lit("single").alias("source"))


def _rounds(spark, root, p: Params = P, train: DataFrame | None = None, **more):
    tr = _train_once(spark, root, p) if train is None else train
    return augment_rounds(tr, written(_lexicon(spark, root, p, tr), "lexicon"), _model(spark, root, p, tr), p, **more)


def e5_augment_rounds(spark, root):
    return _rounds(spark, root).selected.select("id", "round", "ordinal", "candidate_id", "text", "label",
                                               "source", "final_score")


def e5_verifications(spark, root):
    return _rounds(spark, root).verifications.select(*VER_COLS)


def e5_feedback(spark, root):
    return _rounds(spark, root).feedback


# ---- scoring -----------------------------------------------------------------------------------------

def f1_label_score(spark, root):
    c = SC.label_score(_model(spark, root), _round1(spark, root))
    return c.select("id", "ordinal", F.round("label_score", 4).alias("label_score"))


def f3_semantic_score(spark, root):
    return _scored1_all(spark, root, "semantic_score", SC.semantic_score(F.col("text"), F.col("cand_text")))


def f4_embedding_cosine(spark, root):
    emb = read_table(spark, root, "embeddings")
    cent = (emb.select("label", F.posexplode("embedding").alias("pos", "v"))
            .groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
            .groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))),
                                              lambda s: s["v"]).alias("centroid")))
    return emb.join(cent, "label").select(
        "vec_id", "label", F.round(SC.embedding_cosine(F.col("embedding"), F.col("centroid")), 4).alias("cosine"))


def f5_edit_similarity(spark, root):
    from ..functions.editdist import levenshtein_similarity
    return _scored1_all(spark, root, "minimality_score", levenshtein_similarity(F.col("text"), F.col("cand_text")))


def f6_consistency(spark, root):
    return _scored1_all(spark, root, "consistency_score",
                        SC.consistency_score(F.col("text"), F.col("cand_text"), F.col("elements_to_preserve")))


def f8_verify(spark, root):
    return _verified1(spark, root)[0].select(*VER_COLS)


def f10_diversity(spark, root):
    return SC.diversity(_round1(spark, root))


def f2_cue_score(spark, root):
    lex = _lexicon(spark, root)
    t0 = lex.filter("target_label = 0").agg(F.collect_set("dst")).scalar()   # label-0 cue words
    t1 = lex.filter("target_label = 1").agg(F.collect_set("dst")).scalar()   # label-1 cue words
    c = _distinct1(spark, root, samples=S.prepared_samples(spark, root, P)).withColumn("_w0", t0).withColumn("_w1", t1)
    tgt = F.when(F.col("target_label") == 1, F.col("_w1")).otherwise(F.col("_w0"))
    srcw = F.when(F.col("target_label") == 1, F.col("_w0")).otherwise(F.col("_w1"))
    return each_turn(c.select("id", "turns", F.round(SC.cue_score(F.col("cand_text"), tgt, srcw), 4).alias("cue_score"))).select(
        "id", "ordinal", "cue_score")


# ---- selection ---------------------------------------------------------------------------------------

SEL_COLS = ["id", "round", "ordinal", "candidate_id", "text", "label", "source", "final_score"]


def g1_threshold_filter(spark, root):
    return G.threshold_filter(_verified1(spark, root)[0], P).select(*VER_COLS)


def g2_dynamic_percentile(spark, root):
    return G.dynamic_percentile(G.threshold_filter(_verified1(spark, root)[0], P), P).select(*VER_COLS)


def g3_top_k(spark, root):
    return G.top_k(_verified1(spark, root)[0], P.keep_top_k).select(*VER_COLS)


def g4_select(spark, root):
    ver, texts = _verified1(spark, root)
    return G.select(ver, P, texts=texts).select(*SEL_COLS)


def g5_select_pass_only(spark, root):
    ver, texts = _verified1(spark, root)
    return G.select_pass_only(ver, texts=texts).select(*SEL_COLS)


def g6_post_filter(spark, root):
    ver, texts = _single_verified(spark, root)
    rows, fver = first_pass(ver, texts=texts)
    aug, _ = G.post_filter(rows, fver, P)
    return aug


QUERIES = {
    "s1_load_samples": s1_load_samples,
    "p1_preprocess": p1_preprocess,
    "p2_assign_split": p2_assign_split,
    "p3_subsample": p3_subsample,
    "p4_stratified_fraction": p4_stratified_fraction,
    "p5_low_resource_ladder": p5_low_resource_ladder,
    "p6_low_resource_stratified": p6_low_resource_stratified,
    "p7_target_label": p7_target_label,
    "p8_length_bins": p8_length_bins,
    "p9_domain_split": p9_domain_split,
    "c1_rule_plan": c1_rule_plan,
    "c2_default_plan": c2_default_plan,
    "c3_render_prompts": c3_render_prompts,
    "c4_cue_lexicon": c4_cue_lexicon,
    "c7_call_usage": c7_call_usage,
    "e1_lexicon_candidates": e1_lexicon_candidates,
    "e2_synonym_augment": e2_synonym_augment,
    "e3_first_pass": e3_first_pass,
    "e3_first_pass_verifications": e3_first_pass_verifications,
    "e4_single_shot": e4_single_shot,
    "e5_augment_rounds": e5_augment_rounds,
    "e5_verifications": e5_verifications,
    "e5_feedback": e5_feedback,
    "f1_label_score": f1_label_score,
    "f2_cue_score": f2_cue_score,
    "f3_semantic_score": f3_semantic_score,
    "f4_embedding_cosine": f4_embedding_cosine,
    "f5_edit_similarity": f5_edit_similarity,
    "f6_consistency": f6_consistency,
    "f8_verify": f8_verify,
    "f10_diversity": f10_diversity,
    "g1_threshold_filter": g1_threshold_filter,
    "g2_dynamic_percentile": g2_dynamic_percentile,
    "g3_top_k": g3_top_k,
    "g4_select": g4_select,
    "g5_select_pass_only": g5_select_pass_only,
    "g6_post_filter": g6_post_filter,
}


# ---- assembly ----------------------------------------------------------------------------------------

from ..operators import assemble as H  # noqa: E402
from ..operators import evaluate as I  # noqa: E402
from ..operators import responses as D  # noqa: E402
from ..operators import rollup as J  # noqa: E402
from . import experiment as X  # noqa: E402
from .grid import SEEDS as GRID_SEEDS  # noqa: E402


def _rounds_written(spark, root, train=None):
    """E5 with its score rows written once, as the assembly step reads stage
    tables: the exact sampling and the counters scan them several times without
    recomputing the pipeline. Texts of rewrites aren't written; those that a
    step reads are made anew."""
    from .rounds import split_marked
    return split_marked(_rounds(spark, root, train=train, keep=lambda scores: written(scores, "rounds")).marked)


def h1_merge_train(spark, root):
    tr = _train_once(spark, root)
    sel, _ = _rounds_written(spark, root, tr)
    return H.merge_train(tr, sel, P.ratio, P.seed).select("id", "source", "label", "text")


def h2_sample_stats(spark, root):
    sel, ver = _rounds_written(spark, root)
    return H.sample_stats("multi_stage", sel, ver)


def h3_run_counters(spark, root):
    tr = _train_once(spark, root)
    sel, ver = _rounds_written(spark, root, tr)
    return H.run_counters(tr, ver, sel)


def h4_resume(spark, root):
    """Second run over the same input after recording the first: 0 pending rows,
    reported per run next to the first run's pending count."""
    from ..session import checkpoint_dir
    import uuid
    base = checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/flipside-processed-{uuid.uuid4().hex}"
    tr = _train(spark, root)
    first = H.pending(spark, tr, path)
    n_first = first.count()
    H.record_processed(first, path, "run1")
    second = H.pending(spark, tr, path)
    return second.agg(F.count(F.lit(1)).alias("pending_second")).select(
        F.lit(n_first).cast("long").alias("pending_first"), "pending_second")


def _fitted(spark, root):
    """The lexicon and the label model as tables written once, for augmentations that run several times."""
    model = _model(spark, root)
    prior = written(spark.range(1).select(model.prior.alias("prior")), "prior")
    return written(_lexicon(spark, root), "lexicon"), SC.TextModel(written(model.weights, "weights"), prior.agg(F.max("prior")).scalar())


def h4_resumed_augment(spark, root):
    """E5 in two attempts after one that broke off before its commit: the samples of label 1 are committed, all
    others written and not committed, then the whole is started again; equals the unbroken run."""
    from ..sources.stages import new_folder
    from . import resume
    base = new_folder(spark, "resume")
    tr = _train(spark, root)
    lexicon, model = _fitted(spark, root)
    augment = lambda rows: augment_rounds(rows, lexicon, model, P)
    resume.augment_resumable(tr.where("label = 1"), augment, base)
    resume.write_attempt(tr, augment, base)
    return resume.augment_resumable(tr, augment, base)


def h5_stream_augment(spark, root):
    """Streams the train samples (written as files, and once more after the first
    run) through E5 and reads the sink back; equals the batch result on the same rows."""
    from ..session import checkpoint_dir
    from ..streaming.augment_stream import stream_augment
    import uuid
    base = f"{checkpoint_dir(spark).rstrip('/')}/flipside-stream-{uuid.uuid4().hex}"
    tr = _train(spark, root).select("id", "text", "label")
    lexicon, model = _fitted(spark, root)
    for _ in range(2):   # the second time, every id comes late and again
        tr.write.mode("append").parquet(f"{base}/in")
        q = stream_augment(spark, f"{base}/in", f"{base}/out", f"{base}/chk", lexicon, model, P)
        q.awaitTermination()
    out_schema = ("id bigint, text string, label int, source string, candidate_id string, final_score double, "
                  "round int, ordinal int, batch_id long")
    if not H.path_exists(spark, f"{base}/out"):
        return spark.createDataFrame([], out_schema).drop("batch_id")
    return spark.read.schema(out_schema).parquet(f"{base}/out").drop("batch_id").select(
        "id", "round", "ordinal", "candidate_id", "text", "label", "source", "final_score")


# ---- evaluation --------------------------------------------------------------------------------------

def _predictions(spark, root):
    prepared = S.prepared_samples(spark, root, P)
    evalset = prepared.filter(F.col("split").isin("validation", "test", "ood_test")).select(
        "id", "text", "label", "split", "domain")
    return SC.predict(_model(spark, root), evalset)


def _linear(spark, root):
    from ..operators.linear import fit_linear
    return fit_linear(_train(spark, root), S.prepared_samples(spark, root, P).where("split = 'validation'"))


def i1_train_epochs(spark, root):
    """I1, the linear kind: loss and validation metrics after every epoch, and which epoch's weights stay."""
    return _linear(spark, root).history.select(
        "epoch", F.round("train_loss", 4).alias("train_loss"), F.round("val_acc", 4).alias("val_acc"), F.round("val_f1", 4).alias("val_f1"), "kept")


def i2_predict_linear(spark, root):
    """I2 with the linear kind, on the rows that training hasn't seen."""
    from ..operators.linear import predict_linear
    rows = S.prepared_samples(spark, root, P).where("split IN ('test', 'ood_test')").select("id", "text", "label", "split")
    return predict_linear(_linear(spark, root), rows).select("id", "split", "prediction", F.round("probability", 4).alias("probability"))


def i2_predict(spark, root):
    return _predictions(spark, root).select("id", "split", "prediction",
                                            F.round("probability", 4).alias("probability"))


def i3_classification_metrics(spark, root):
    return I.classification_metrics(_predictions(spark, root), ["split"])


def i5_quality_report(spark, root):
    return I.quality_report(_rounds(spark, root).verifications)


def i6_ood_report(spark, root):
    pr = _predictions(spark, root).filter(F.col("split").isin("test", "ood_test")).withColumn("method", F.lit("none"))
    return I.ood_report(I.classification_metrics(pr, ["method", "domain"]))


def i6_ood_by_method(spark, root):
    """I6 for every method, preset and seed of the grid."""
    return X.main_runs(spark, root).select(
        "preset", "seed", "method", F.col("test_acc").alias("id_acc"), F.col("test_f1").alias("id_f1"), "ood_acc", "ood_f1", "gap")


def i4_method_report(spark, root):
    return X.main_runs(spark, root).select(
        "preset", "seed", "method", "test_acc", "test_f1", "val_acc", "val_f1", "train_size", "generated", "selected")


# ---- roll-ups ----------------------------------------------------------------------------------------

def j1_variant_selection(spark, root):
    from ..params import variant_params
    from .rounds import variant_selection
    variants = {v: variant_params(P, v) for v in ("full", "no_selector", "fixed_threshold")}
    marked = variant_selection(_verified1(spark, root)[0], variants)
    return marked.groupBy("variant").agg(F.sum(F.col("selected").cast("int")).alias("selected"),
                                         F.count(F.lit(1)).alias("verified"))


def j2_ablation_report(spark, root):
    return X.ablation_runs(spark, root)


def j3_method_grid(spark, root):
    return X.main_runs(spark, root)


def j4_repeat_grid(spark, root):
    return X.method_runs(spark, root)


def j5_mean_std(spark, root):
    return J.mean_std(X.main_runs(spark, root), ["method"], ["test_acc", "val_acc", "ood_acc"])


def j6_summarize_main(spark, root):
    return J.summarize_main(X.main_runs(spark, root))


def j6_summarize_quality(spark, root):
    return J.summarize_quality(X.quality_runs(spark, root))


def j7_summarize_low_resource(spark, root):
    return J.summarize_low_resource(X.method_runs(spark, root))


def j8_summarize_ablation(spark, root):
    return J.summarize_ablation(X.ablation_runs(spark, root))


def j9_summarize_ood(spark, root):
    return J.summarize_ood(X.main_runs(spark, root))


def j10_ratio_pivot(spark, root):
    return J.ratio_pivot(X.method_runs(spark, root).where("task = 'low_resource'"))


def j11_best_per_group(spark, root):
    return J.best_per_group(J.summarize_low_resource(X.method_runs(spark, root)))


def j12_delta_vs(spark, root):
    return J.delta_vs(J.summarize_low_resource(X.method_runs(spark, root)), "none")


# ---- model calls and responses ------------------------------------------------------------------------

REPLY_KINDS = 10


def responses_from_conversations(spark, root):
    """A reply per conversation turn around its text, in one of ten shapes by
    md5 bucket: clean, fenced, in prose, truncated, string list, other key,
    prediction only, no JSON, failed call, after a broken block."""
    turns = read_table(spark, root, "conversations").select(
        F.concat_ws(":", F.lit("generator"), "conv_id", "turn").alias("request_id"), F.col("conv_id").alias("id"),
        F.coalesce("text", F.lit("")).alias("_t"))
    kind = hash_bucket(7, "request_id", buckets=REPLY_KINDS)
    one, two = F.concat("_t", F.lit(" (one)")), F.concat("_t", F.lit(" (two)"))
    whole = F.to_json(F.struct(F.array(
        F.struct(F.lit("c1").alias("candidate_id"), one.alias("text")),
        F.struct(F.lit("c2").alias("candidate_id"), two.alias("text"))).alias("candidates")))
    shapes = [
        whole, F.concat(F.lit("```json\n"), whole, F.lit("\n```")), F.concat(F.lit("Here it is: "), whole, F.lit(" -- done.")),
        F.expr("left(_w, length(_w) - 7)"), F.to_json(F.struct(F.array(one, F.lit(""), two).alias("candidates"))),
        F.to_json(F.struct(F.array(F.struct(one.alias("output"))).alias("candidates"))),
        F.to_json(F.struct(one.alias("prediction"))), F.concat(F.lit("no json here: "), F.regexp_replace("_t", "[{}]", "")),
        F.lit(None).cast("string"), F.concat(F.lit("{oops} "), whole)]
    content = F.element_at(F.array(*shapes), F.col("_k") + 1)
    return turns.withColumn("_k", kind).withColumn("_w", whole).select(
        "request_id", "id", F.lit("generator").alias("stage"), F.lit(1).alias("round"), content.alias("content"),
        F.when(F.col("_k") == 8, "RuntimeError: down").alias("error"), F.lit(1).alias("attempts"))


def plan_replies(samples: DataFrame) -> DataFrame:
    """A planner reply per sample around its first and longest words, in one of five shapes by md5 bucket: lists of
    strings, lists of mixed items, wrong kinds, empty lists and no JSON."""
    first = F.try_element_at(F.split("text", " "), F.lit(1))
    q = lambda c: F.to_json(F.array(c))
    obj = lambda key, c: F.to_json(F.struct(c.alias(key)))
    shapes = [
        F.concat(F.lit('{"elements_to_preserve": '), q(first), F.lit(', "elements_to_change": '), F.to_json("elements_to_change"), F.lit("}")),
        F.concat(F.lit('{"elements_to_preserve": [5, null, ["x"], " ", '), obj("text", first), F.lit(", "), obj("token", F.concat(first, F.lit(" two"))),
                 F.lit(', {"text": "", "name": "named"}, {"text": 7, "name": "no"}, "plain "], "elements_to_change": {"text": "x"}}')),
        F.lit('{"elements_to_preserve": "all", "elements_to_change": 3, "causal_features": null, "target_label": 9}'),
        F.lit('{"elements_to_preserve": [], "causal_features": [" a ", ""], "score": NaN}'),
        F.lit("no plan")]
    content = F.element_at(F.array(*shapes), hash_bucket(11, "id", buckets=len(shapes)) + 1)
    rows = samples.join(C.rule_plan(samples).select("id", "elements_to_change"), "id")
    return rows.select(F.concat_ws(":", F.lit("planner"), "id").alias("request_id"), "id", F.lit("planner").alias("stage"),
                       F.lit(1).alias("round"), content.alias("content"), F.lit(None).cast("string").alias("error"), F.lit(1).alias("attempts"))


def c6_reply_plans(spark, root):
    """Planner replies of all prepared samples as plans, and the share of preserve items (F6) that each sample's own text holds."""
    samples = S.prepared_samples(spark, root, P)
    plans = D.plans_from_replies(D.extract_json(plan_replies(samples)), C.rule_plan(samples))
    kept = SC.consistency_score(F.col("text"), F.col("text"), F.col("elements_to_preserve"))
    # a step before the lists are joined into strings of the same names: lambdas would read those
    scored = plans.join(samples.select("id", "text"), "id").withColumn("consistency_score", F.round(kept, 4))
    return scored.select(
        "id", "target_label", "plan_source", *[F.concat_ws("|", c).alias(c) for c in ("causal_features", "elements_to_change", "elements_to_preserve")],
        "consistency_score")


def d1_extract_json(spark, root):
    return D.extract_json(responses_from_conversations(spark, root)).select("request_id", "parse_status", "json")


def d2_salvage_candidates(spark, root):
    return D.salvage_candidates(responses_from_conversations(spark, root))


def d3_normalize_candidates(spark, root):
    return D.normalize_candidates(D.extract_json(responses_from_conversations(spark, root)))


def d4_first_text(spark, root):
    return D.first_text(D.extract_json(responses_from_conversations(spark, root)))


def d5_parse_report(spark, root):
    return D.parse_report(D.extract_json(responses_from_conversations(spark, root)))


def s2_stage_roundtrip(spark, root):
    """Writes E5 verifications as a stage table and reads them back."""
    from ..session import checkpoint_dir
    from ..sources.stages import read_stage, write_stage
    import uuid
    base = f"{checkpoint_dir(spark).rstrip('/')}/flipside-stages-{uuid.uuid4().hex}"
    ver = _rounds(spark, root).verifications.select(*VER_COLS)
    write_stage(ver, base, "verifications", "r1")
    schema = ("id bigint, round int, ordinal int, candidate_id string, target_label int, label_score double, "
              "semantic_score double, minimality_score double, consistency_score double, final_score double, "
              "status string, critique string, run_id string")
    return read_stage(spark, base, "verifications", schema).drop("run_id")


def s5_collect_runs(spark, root):
    """Writes the method grid as per-seed CSV trees and collects them back."""
    from ..session import checkpoint_dir
    from ..sources.stages import collect_runs, write_results
    import uuid
    base = f"{checkpoint_dir(spark).rstrip('/')}/flipside-runs-{uuid.uuid4().hex}"
    runs = X.method_runs(spark, root).where("preset = 'multi_stage'")
    cols = ["method", "test_acc", "test_f1", "val_acc", "val_f1", "train_size", "generated", "selected"]
    for task, ratio, seed in [("main", "100pct", s) for s in GRID_SEEDS] + [("low_resource", "10pct", s) for s in GRID_SEEDS]:
        own = runs.where((F.col("task") == task) & (F.col("ratio") == ratio) & (F.col("seed") == seed))
        write_results(own.select(*cols), f"{base}/{task}/{ratio}/seed_{seed}/main")
    schema = ("method string, test_acc double, test_f1 double, val_acc double, val_f1 double, "
              "train_size long, generated long, selected long")
    return collect_runs(spark, base, schema)


QUERIES.update({
    "h1_merge_train": h1_merge_train,
    "h2_sample_stats": h2_sample_stats,
    "h3_run_counters": h3_run_counters,
    "h4_resume": h4_resume,
    "h4_resumed_augment": h4_resumed_augment,
    "h5_stream_augment": h5_stream_augment,
    "i1_train_epochs": i1_train_epochs,
    "i2_predict": i2_predict,
    "i2_predict_linear": i2_predict_linear,
    "i3_classification_metrics": i3_classification_metrics,
    "i4_method_report": i4_method_report,
    "i5_quality_report": i5_quality_report,
    "i6_ood_report": i6_ood_report,
    "i6_ood_by_method": i6_ood_by_method,
    "j1_variant_selection": j1_variant_selection,
    "j2_ablation_report": j2_ablation_report,
    "j3_method_grid": j3_method_grid,
    "j4_repeat_grid": j4_repeat_grid,
    "j5_mean_std": j5_mean_std,
    "j6_summarize_main": j6_summarize_main,
    "j6_summarize_quality": j6_summarize_quality,
    "j7_summarize_low_resource": j7_summarize_low_resource,
    "j8_summarize_ablation": j8_summarize_ablation,
    "j9_summarize_ood": j9_summarize_ood,
    "j10_ratio_pivot": j10_ratio_pivot,
    "j11_best_per_group": j11_best_per_group,
    "j12_delta_vs": j12_delta_vs,
    "c6_reply_plans": c6_reply_plans,
    "d1_extract_json": d1_extract_json,
    "d2_salvage_candidates": d2_salvage_candidates,
    "d3_normalize_candidates": d3_normalize_candidates,
    "d4_first_text": d4_first_text,
    "d5_parse_report": d5_parse_report,
    "s2_stage_roundtrip": s2_stage_roundtrip,
    "s5_collect_runs": s5_collect_runs,
})

