"""The grouped grid against a loop over single runs."""

import grid_loop
import pytest
from conftest import SF001

from flipside.params import DEFAULT, MULTI_STAGE
from flipside.plans import grid

SAME = ["test_acc", "test_f1", "val_acc", "val_f1", "ood_acc", "ood_f1", "gap", "train_size", "generated", "selected"]


def rows(df, keys, cols):
    return {tuple(r[k] for k in keys): tuple(r[c] for c in cols) for r in df.collect()}


@pytest.fixture(scope="module")
def loose():
    """Thresholds that the small table's rewrites pass."""
    return {"default": DEFAULT.with_(th_label=0.05, th_final=0.3, w_label=0.1),
            "multi_stage": MULTI_STAGE.with_(th_label=0.02, th_final=0.3, keep_top_k=1)}


def test_methods_equal_the_loop(spark, loose):
    got = grid.method_runs(spark, SF001, seeds=(42, 43), ratios=(0.5, 1.0), presets=loose)
    for preset, seed, ratio in (("default", 43, 0.5), ("multi_stage", 42, 1.0)):   # the loop takes a minute a run
        runs, quality = grid_loop.run_grid(spark, SF001, loose[preset], seeds=(seed,), ratios=(ratio,))
        own = got.where((got.preset == preset) & (got.seed == seed) & (got.ratio == grid.ratio_name(ratio)))
        keys = ["ratio", "method"]
        assert rows(own, keys, SAME) == rows(runs, keys, SAME)
        cols = ["label_success", "semantic_sim", "edit_similarity", "final_score"]
        assert rows(own.where("label_success IS NOT NULL"), keys, cols) == rows(quality, keys, cols)
        assert any(r.selected for r in own.collect() if r.method == "multi_stage")


def test_variants_equal_the_loop(spark):
    got = grid.ablation_runs(spark, SF001, seeds=(42,))
    want = grid_loop.ablation_grid(spark, SF001, MULTI_STAGE, seeds=(42,))
    assert rows(got, ["method"], ["test_acc", "test_f1", "label_success"]) == rows(want, ["variant"], ["acc", "f1", "label_success"])


def test_jobs_do_not_grow_with_runs(spark):
    """The number of Spark jobs is that of the steps."""
    tracker = spark.sparkContext.statusTracker()

    def jobs(group, seeds, ratios):
        spark.sparkContext.setJobGroup(group, group)
        grid.method_runs(spark, SF001, seeds=seeds, ratios=ratios).collect()
        return len(tracker.getJobIdsForGroup(group))

    one, many = jobs("one run", (42,), (1.0,)), jobs("many runs", (42, 43, 44), (0.3, 0.5, 1.0))
    assert many <= one + 10   # adaptive execution splits a few more of them


def test_token_stats_by_hand(spark):
    rows = [("a b a it's", 1, [0, 2]), ("B b c", 0, [2]), ("", 1, [0]), ("A a", 1, [0, 2])]
    frame = spark.createDataFrame(rows, "text string, label int, runs array<int>")
    got = {(r.run, r.token): (r.c1, r.c0, r.df1, r.df0) for r in grid.token_stats(frame).collect()}
    assert got == {(0, "a"): (4, 0, 2, 0), (0, "b"): (1, 0, 1, 0), (0, "it's"): (1, 0, 1, 0),
                   (2, "a"): (4, 0, 2, 0), (2, "b"): (1, 2, 1, 1), (2, "it's"): (1, 0, 1, 0), (2, "c"): (0, 1, 0, 1)}


def test_predictions_of_models_side_by_side(spark, monkeypatch):
    """Models in rows of two weights; samples without tokens or known tokens have the prior's class; no row for each
    (token, model) is made."""
    monkeypatch.setattr(grid, "ABREAST", 2)
    samples = spark.createDataFrame([(1, "a a b", "test", 1), (2, "", "test", 0), (3, "zzz", "validation", 1)], "id long, text string, split string, label int")
    weights = spark.createDataFrame([(0, "a", 1.0), (0, "b", -1.5), (1, "a", -1.0), (2, "b", 2.0), (2, "a", -1.5)], "model int, token string, w double")
    sizes = spark.createDataFrame([(0, 1, 1), (1, 1, 1), (2, 9, 1)], "model int, n1 long, n0 long")
    got = {(r.model, r.split, r.label): r.prediction for r in grid.predictions(samples, weights, sizes, 3).collect()}
    assert got == {(0, "test", 1): 1, (1, "test", 1): 0, (2, "test", 1): 1, (0, "test", 0): 0, (1, "test", 0): 0, (2, "test", 0): 1,
                   (0, "validation", 1): 0, (1, "validation", 1): 0, (2, "validation", 1): 1}


def test_word_changes_equal_the_counts_of_both_texts(spark):
    from collections import Counter

    from pyspark.sql import functions as F

    from flipside.functions.text import tokens
    rows = [("a b a", "a c a"), ("Bad it's x-y", "good it's x-z"), ("a", "a b c"), ("a b c", ""), ("", ""), ("a\nb  c", "a\nd  c")]
    df = spark.createDataFrame(rows, "a string, b string").withColumn("d", grid.word_changes(F.col("a"), F.col("b")))
    for r in df.withColumn("x", tokens(F.col("a"))).withColumn("y", tokens(F.col("b"))).collect():
        got = Counter()
        for c in r.d:
            got[c.token] += c.d
        want = Counter(r.y)
        want.subtract(Counter(r.x))
        assert {t: n for t, n in got.items() if n} == {t: n for t, n in want.items() if n}, r
    assert df.where("a = 'a b a'").first().d and len(df.where("a = 'a b a'").first().d) == 2   # equal words aren't listed


def test_weights_abreast_equal_weights_one_by_one(spark, monkeypatch):
    """A token of a run stays one row for all configs; weights equal those of single models, missing ones included."""
    monkeypatch.setattr(grid, "ABREAST", 3)
    n_runs, counts = 2, {(0, "a"): [(1, 2), (3, 0)], (0, "b"): [(0, 0), (0, 5)], (1, "a"): [(4, 4), (4, 4)], (1, "c"): [(1, 0), (2, 0)]}
    wide = spark.createDataFrame([(r, t, *c[0], *c[1]) for (r, t), c in counts.items()], "run int, token string, c1_0 long, c0_0 long, c1_1 long, c0_1 long")
    long = spark.createDataFrame([(i * n_runs + r, t, *c) for (r, t), cs in counts.items() for i, c in enumerate(cs) if sum(c)], "model int, token string, c1 long, c0 long")
    want = {(r.token, r.model): r.w for r in grid.bayes_weights(long, "model").collect()}
    rows = grid.weights_abreast(wide, 2, n_runs).collect()
    assert len(rows) == 3 * 2
    got = {(r.token, r.part * 3 + i): r[f"w{i}"] for r in rows for i in range(3) if r[f"w{i}"] is not None}
    assert got == want


def test_weights_abreast_keep_no_lists(spark):
    """Plain maxima of a token's rows: lists are sorted once a task holds more than a few tokens."""
    wide = spark.createDataFrame([(0, "a", 1, 2, 3, 0)], "run int, token string, c1_0 long, c0_0 long, c1_1 long, c0_1 long")
    plan = grid.weights_abreast(wide, 2, 2)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
