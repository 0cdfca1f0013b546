from flipside.operators import rollup as J

RUNS = "method string, ratio string, preset string, seed int, task string, test_acc double, test_f1 double, ood_acc double, gap double"


def _runs(spark):
    return spark.createDataFrame([
        ("none", "10pct", "multi_stage", 1, "low_resource", 0.50, 0.4, 0.3, 0.20),
        ("none", "10pct", "default", 1, "low_resource", 0.60, 0.5, 0.3, 0.30),
        ("none", "10pct", "default", 2, "low_resource", 0.70, 0.6, 0.4, 0.30),
        ("multi_stage", "10pct", "multi_stage", 1, "low_resource", 0.80, 0.7, 0.5, 0.30),
        ("none", "100pct", "default", 1, "main", 0.90, 0.8, 0.5, 0.40),
        ("single", "100pct", "default", 1, "main", 0.90, 0.7, 0.6, 0.30)], RUNS)


def test_mean_std_of_one_run_has_no_std(spark):
    got = {r.method: (r.test_acc_mean, r.test_acc_std) for r in J.mean_std(_runs(spark).filter("ratio = '10pct'"), ["method"], ["test_acc"]).collect()}
    assert got == {"none": (0.6, 0.1), "multi_stage": (0.8, None)}


def test_summaries(spark):
    main = {r.method: (r.test_acc_mean, r.test_f1_mean) for r in J.summarize_main(_runs(spark)).collect()}
    assert main == {"none": (0.9, 0.8), "single": (0.9, 0.7)}
    low = {(r.method, r.ratio): r.test_acc_mean for r in J.summarize_low_resource(_runs(spark)).collect()}
    assert low == {("none", "10pct"): 0.6, ("multi_stage", "10pct"): 0.8}
    ood = {r.method: (r.ood_acc_mean, r.gap_mean) for r in J.summarize_ood(_runs(spark).filter("task = 'main'")).collect()}
    assert ood == {"none": (0.5, 0.4), "single": (0.6, 0.3)}


def test_pivot_takes_the_first_preset_and_keeps_the_order(spark):
    got = J.ratio_pivot(_runs(spark)).orderBy("row_order").collect()
    assert [r.method for r in got] == ["none", "synonym", "single", "single_filtered", "multi_stage"]
    assert (got[0].acc_10pct, got[0].acc_100pct, got[0].acc_30pct) == (60.0, 90.0, None)
    assert (got[4].acc_10pct, got[1].acc_10pct) == (80.0, None)


def test_best_and_delta(spark):
    summary = J.mean_std(_runs(spark), ["method", "ratio"], ["test_acc"])
    best = {r.ratio: (r.best_method, r.best_value, r.ours_value) for r in J.best_per_group(summary).collect()}
    assert best == {"10pct": ("multi_stage", 0.8, 0.8), "100pct": ("single", 0.9, None)}  # a tie goes by name
    delta = {(r.ratio, r.method): r.delta_points for r in J.delta_vs(summary, "none").collect()}
    assert delta == {("10pct", "none"): 0.0, ("10pct", "multi_stage"): 20.0, ("100pct", "none"): 0.0, ("100pct", "single"): 0.0}


def test_ladder_and_ablation_rollups_run_all_seeds(monkeypatch):
    """All of them ask the grid for three seeds, and the method grid for both presets and four ratios."""
    from unittest.mock import MagicMock

    from flipside.plans import queries as Q
    seen = []
    for name in ("method_runs", "ablation_runs"):
        monkeypatch.setattr(Q.X.grid, name, lambda spark, root, seeds, name=name: seen.append((name, seeds)))
    monkeypatch.setattr(Q.X, "_grid_folder", lambda *args: "")
    monkeypatch.setattr(Q.X, "_kept", lambda spark, path, make: make() or MagicMock())
    for name in ("summarize_low_resource", "summarize_ablation", "ratio_pivot", "best_per_group", "delta_vs"):
        monkeypatch.setattr(Q.J, name, lambda *args: None)
    monkeypatch.setattr(Q.X, "F", MagicMock())
    monkeypatch.setattr(Q, "F", MagicMock())
    for name in ("j7_summarize_low_resource", "j8_summarize_ablation", "j10_ratio_pivot", "j11_best_per_group", "j12_delta_vs"):
        Q.QUERIES[name](None, None)
    assert seen == [("ablation_runs" if i == 1 else "method_runs", (42, 43, 44)) for i in range(5)]
    assert list(Q.X.grid.PRESETS) == ["default", "multi_stage"] and len(Q.X.grid.LADDER) == 4
