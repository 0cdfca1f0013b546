"""Physical-plan checks: no cartesian / nested-loop joins, text kept out of
the selection exchange, top-k pushed below the exchange."""

from conftest import SF001


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cartesian_products(spark):
    from flipside.plans import queries as Q
    for name in ("e5_augment_rounds", "h1_merge_train", "p5_low_resource_ladder", "g4_select", "e2_synonym_augment",
                 "p6_low_resource_stratified", "j1_variant_selection"):
        plan = _plan(Q.QUERIES[name](spark, SF001))
        assert "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name


def test_lexicon_topk_is_window_group_limit(spark):
    from flipside.plans import queries as Q
    plan = _plan(Q.c4_cue_lexicon(spark, SF001))
    assert "WindowGroupLimit" in plan


def test_selection_exchange_carries_no_text(spark):
    from flipside.plans import queries as Q
    plan = Q.e5_augment_rounds(spark, SF001)._jdf.queryExecution().executedPlan()
    text = plan.toString()
    # the user repartition on id (slim rows) is the only REPARTITION_BY_COL exchange
    lines = [l for l in text.splitlines() if "REPARTITION_BY_COL" in l]
    assert len(lines) == 1


def test_ladder_shuffles_no_text(spark):
    """The ladder's cut is found on slim rows; rows themselves pass a filter."""
    from flipside.operators import sampling as S
    df = spark.range(1000).selectExpr("id", "cast(id % 2 as int) AS label", "repeat('x', 50) AS text")
    for out in (S.low_resource_ladder(df, 1), S.low_resource_stratified(df, 1), S.subsample(df, 100, 1), S.stratified_fraction(df, 0.3, 1)):
        plan = _plan(out)
        main = plan[:plan.find("Subquery")] if "Subquery" in plan else plan
        assert "Exchange" not in main and "SortMergeJoin" not in main, main


def test_rewrites_tokens_are_not_shuffled(spark):
    """Of tokens, those of samples and the changed ones of rewrites meet the weights; scores equal those of a plain pass."""
    from pyspark.sql import functions as F

    from flipside.functions.text import tokens
    from flipside.operators import score as SC
    texts = [(1, "Alpha beta's gamma beta", 1), (2, "delta ALPHA alphabet gamma", 0), (3, "", 0), (4, "zeta", 1)]
    rewrites = [(1, 1, "Omega beta's gamma beta"), (1, 2, "Alpha beta's gamma beta and more words"), (2, 1, "delta ALPHA omegabet gamma"),
                (2, 2, "gamma"), (3, 1, "alpha"), (4, 1, "zeta"), (4, 2, "")]
    samples = spark.createDataFrame(texts, "id long, text string, label int")
    cands = spark.createDataFrame(rewrites, "id long, ordinal int, cand_text string").join(samples, "id")
    model = SC.fit_text_classifier(samples)
    weights = {r.token: r.w for r in model.weights.collect()}
    got = SC.label_logits(samples.select("id", "text"), cands, model.weights, ["id"])
    for r in got.withColumn("all", tokens(F.col("cand_text"))).collect():
        assert abs(r.logit - sum(weights.get(t, 0.0) for t in r["all"])) < 1e-9, r
    changed = {(r.id, r.ordinal): len(r.d) for r in cands.withColumn("d", SC.changed_tokens(F.col("text"), F.col("cand_text"))).collect()}
    assert changed[1, 1] == 2 and changed[1, 2] == 3 and changed[2, 1] == 2 and changed[4, 1] == 0


def test_texts_do_not_reach_the_sorts_of_the_label_join(spark):
    """Scores that need both texts are worked out before the join with the weights, whose sorts then hold slim rows."""
    from flipside.plans import queries as Q
    for name in ("f8_verify", "e5_feedback"):
        plan = Q.QUERIES[name](spark, SF001)._jdf.queryExecution().optimizedPlan().toString()
        joins = [line for line in plan.splitlines() if "Project [" in line and "_changed#" in line and "cand_text#" in line and "_ms#" in line]
        assert not joins, (name, joins)


def test_kept_rounds_hold_no_texts(spark):
    """What h1 to h3 write of the rounds is score rows."""
    from flipside.plans import queries as Q
    seen = []
    Q._rounds(spark, SF001, keep=lambda scores: seen.append(scores.columns) or scores)
    assert len(seen) == 1 and not {"text", "cand_text"} & set(seen[0])


def test_fitted_tables_are_written_and_equal(spark):
    """Attempts and batches read one written lexicon and model, and don't fit them again."""
    from flipside.plans import queries as Q
    lexicon, model = Q._fitted(spark, SF001)
    assert "documents.parquet" not in _plan(lexicon) and "documents.parquet" not in _plan(model.weights)
    rows = lambda df: sorted(map(tuple, df.collect()))
    plain = Q._model(spark, SF001)
    assert rows(lexicon) == rows(Q._lexicon(spark, SF001)) and rows(model.weights) == rows(plain.weights)
    one = spark.range(1)
    assert one.select(model.prior).first()[0] == one.select(plain.prior).first()[0]
