"""The grid as a plain loop over runs and methods, each built from the single-run operators: what the grouped grid
(flipside.plans.grid) is held against.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flipside.operators import planning as C
from flipside.operators import sampling as S
from flipside.operators.assemble import AUG_COLS, merge_train
from flipside.operators.evaluate import classification_metrics, quality_report
from flipside.operators.generate import first_pass, lexicon_candidates, synonym_augment
from flipside.operators.score import fit_text_classifier, predict, verify
from flipside.operators.select import post_filter
from flipside.params import METHODS, Params
from flipside.plans.rounds import augment_rounds


def method_sets(train: DataFrame, p: Params, lexicon: DataFrame, scorer) -> dict:
    """method -> (augmented rows, verifications or None)."""
    out = {}
    empty = train.select(*AUG_COLS[:3]).withColumn("source", F.lit("none")).filter(F.lit(False))
    out["none"] = (empty, None)
    out["synonym"] = (synonym_augment(train, C.mine_synonyms(train), p.ratio, p.seed), None)
    base = train.select("id", "text", "label").withColumn(
        "elements_to_preserve", F.array(*[F.lit(x) for x in C.SINGLE_PRESERVE]))
    single_ver = verify(lexicon_candidates(base, lexicon, p.num_candidates, p.seed, 1, p.pairs_per_candidate), scorer, p)
    rows, ver = first_pass(single_ver)
    out["single"] = (rows, ver)
    rows_f, ver_f = post_filter(rows, ver, p)
    out["single_filtered"] = (rows_f.withColumn("source", F.lit("single_filtered")), ver_f)
    res = augment_rounds(train, lexicon, scorer, p)
    out["multi_stage"] = (res.selected.select(*AUG_COLS), res.verifications)
    return out


def run_grid(spark: SparkSession, root: str, p: Params, seeds=(42,), ratios=(1.0,),
             methods=METHODS, task: str = "main") -> tuple[DataFrame, DataFrame]:
    """Returns (runs, quality): one runs row per (ratio, seed, method) with
    test / validation / OOD accuracy and F1, sizes and counts.

    A run's intermediate tables (train split, lexicon, method sets, merged
    set, predictions) are written with a reliable checkpoint into
    spark.checkpoint.dir: later jobs read them back instead of recomputing
    them, and their lineage (and plan size) is cut, so planning cost does not
    grow across the grid. All predictions are measured in one grouped job."""
    prepared = S.prepared_samples(spark, root, p)
    full_train = prepared.filter((F.col("domain") == "id") & (F.col("split") == "train"))
    evalset = (prepared.filter(F.col("split").isin("validation", "test", "ood_test"))
               .select("id", "text", "label", "split").checkpoint())
    preds, quals, size_rows = [], [], []
    for ratio in ratios:
        rname = f"{int(round(ratio * 100))}pct"
        for seed in seeds:
            ps = p.with_(seed=seed)
            if ratio < 1.0:
                train = S.low_resource_ladder(full_train, seed, ratios=(ratio,), base=p.train_samples).drop("ratio")
            else:
                train = S.subsample(full_train, p.train_samples, seed)
            train = train.select("id", "text", "label").checkpoint()
            lexicon = C.mine_lexicon(train, ps.lexicon_size, ps.lexicon_min_df).checkpoint()
            scorer = fit_text_classifier(train)
            sets = {m: (a.checkpoint(), v.checkpoint() if v is not None else None)
                    for m, (a, v) in method_sets(train, ps, lexicon, scorer).items() if m in methods}
            tag = [F.lit(task).alias("task"), F.lit(rname).alias("ratio"), F.lit(seed).alias("seed")]
            for method in methods:
                aug, ver = sets[method]
                merged = merge_train(train, aug, ps.ratio, seed).checkpoint()
                model = fit_text_classifier(merged)
                pr = predict(model, evalset).select(*tag, F.lit(method).alias("method"), "split", "label",
                                                    "prediction").checkpoint()
                preds.append(pr)
                n_aug = aug.count()
                n_ver = ver.count() if ver is not None else None
                if method == "none":
                    gen, sel = 0, 0
                elif ver is None:
                    gen, sel = n_aug, n_aug
                else:
                    gen, sel = (n_ver if n_ver > 0 else n_aug), n_aug
                size_rows.append((task, rname, seed, method, merged.count(), gen, sel))
                if ver is not None:
                    q = quality_report(ver.select(*tag, F.lit(method).alias("method"), "label_score",
                                                  "semantic_score", "minimality_score", "final_score"),
                                       ["task", "ratio", "seed", "method"]).checkpoint()
                    quals.append(q)
    union = preds[0]
    for d in preds[1:]:
        union = union.unionByName(d)
    metrics = classification_metrics(union, ["task", "ratio", "seed", "method", "split"])
    keys = ["task", "ratio", "seed", "method"]
    wide = metrics.groupBy(*keys).agg(
        *[F.max(F.when(F.col("split") == s, F.col(m))).alias(f"{n}_{m}")
          for s, n in (("test", "test"), ("validation", "val"), ("ood_test", "ood")) for m in ("acc", "f1")])
    # per-run counts (a few integers per run, not data)
    size_df = spark.createDataFrame(size_rows, "task string, ratio string, seed int, method string, "
                                               "train_size long, generated long, selected long")
    runs = (wide.join(size_df, keys)
            .withColumn("gap", F.round(F.col("test_acc") - F.col("ood_acc"), 4))
            .withColumn("preset", F.lit("multi_stage")).withColumn("variant", F.lit("full")))
    quality = quals[0]
    for d in quals[1:]:
        quality = quality.unionByName(d)
    return runs, quality


def ablation_grid(spark: SparkSession, root: str, p: Params, seeds=(42,)) -> DataFrame:
    """J1/J2 generation-side variants: each of the six ablations produces its
    augmented set, is merged, fitted and scored on the test split; label
    success is the mean label score of its verifications."""
    from flipside.operators.generate import single_shot
    from flipside.params import VARIANTS, variant_params
    prepared = S.prepared_samples(spark, root, p)
    full_train = prepared.filter((F.col("domain") == "id") & (F.col("split") == "train"))
    test = prepared.filter(F.col("split") == "test").select("id", "text", "label", "split")
    preds, quals = [], []
    for seed in seeds:
        train = S.subsample(full_train, p.train_samples, seed).select("id", "text", "label").checkpoint()
        lexicon = C.mine_lexicon(train, p.lexicon_size, p.lexicon_min_df).checkpoint()
        scorer = fit_text_classifier(train)
        for variant in VARIANTS:
            pv = variant_params(p, variant).with_(seed=seed)
            if variant == "single_agent":
                base = train.withColumn("elements_to_preserve", F.array(*[F.lit(x) for x in C.SINGLE_PRESERVE]))
                ver = verify(single_shot(base, lexicon, seed), scorer, pv).checkpoint()
                aug = ver.filter(F.col("status") == "pass").select(
                    "id", F.col("cand_text").alias("text"), F.col("target_label").alias("label"),
                    F.lit("single_agent").alias("source"))
            else:
                res = augment_rounds(train, lexicon, scorer, pv)
                ver = res.verifications.checkpoint()
                aug = res.selected.select(*AUG_COLS).checkpoint()
            merged = merge_train(train, aug, pv.ratio, seed).checkpoint()
            model = fit_text_classifier(merged)
            tag = [F.lit(variant).alias("variant"), F.lit(seed).alias("seed")]
            pr = predict(model, test).select(*tag, "label", "prediction").checkpoint()
            preds.append(pr)
            q = ver.groupBy().agg(F.avg("label_score").alias("label_score")).select(*tag, "label_score").checkpoint()
            quals.append(q)

    union = preds[0]
    for d in preds[1:]:
        union = union.unionByName(d)
    q = quals[0]
    for d in quals[1:]:
        q = q.unionByName(d)
    metrics = classification_metrics(union, ["variant", "seed"])
    ls = q.groupBy("variant", "seed").agg(F.round(F.first("label_score"), 4).alias("label_success"))
    out = metrics.join(ls, ["variant", "seed"], "left").select(
        "variant", "seed", "acc", "f1", F.coalesce("label_success", F.lit(0.0)).alias("label_success"))
    return out
