from conftest import SF001

from flipside.params import MULTI_STAGE

p = MULTI_STAGE.with_(th_label=0.0, th_semantic=0.3, th_minimality=0.3, th_final=0.0)   # low, so that most samples have a selection


def test_stream_equals_batch(spark):
    from flipside.plans.queries import e5_augment_rounds, h5_stream_augment
    a = sorted(tuple(r) for r in e5_augment_rounds(spark, SF001).collect())
    b = sorted(tuple(r) for r in h5_stream_augment(spark, SF001).collect())
    assert a == b


def _fitted(spark):
    """Small lexicon and model, written once: the stream's plans read them in every batch."""
    from flipside.operators.score import TextModel, fit_text_classifier
    from flipside.plans.queries import _lexicon, _train
    from flipside.sources.stages import written
    from pyspark.sql import functions as F
    train = written(_train(spark, SF001).select("id", "text", "label"), "train")
    model = fit_text_classifier(train)
    return train, written(_lexicon(spark, SF001), "lexicon"), TextModel(written(model.weights, "weights"), F.lit(0.0))


COLS = ["id", "text", "label", "source", "candidate_id", "final_score", "round", "ordinal"]


def _rows(df):
    return sorted(tuple(r) for r in df.select(*COLS).collect())


def test_ids_in_several_batches_are_augmented_once(spark, tmp_path):
    import os
    from pyspark.sql import functions as F
    from flipside.plans.rounds import augment_rounds
    from flipside.streaming.augment_stream import stream_augment, write_batch
    train, lexicon, model = _fitted(spark)
    want = _rows(augment_rounds(train, lexicon, model, p).selected)
    assert len(want) > 10
    part = lambda *which: train.where((F.col("id") % 3).isin(*which))
    changed = part(0).withColumn("text", F.concat("text", F.lit(" and changed")))
    for at, rows in enumerate([part(0), part(1).union(part(0)), part(2).union(part(1)).union(changed)]):
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for name in os.listdir(f"{tmp_path}/in"):   # files are taken by their time
            if name.endswith(".parquet") and not os.path.exists(f"{tmp_path}/{name}.seen"):
                open(f"{tmp_path}/{name}.seen", "w").close()
                os.utime(f"{tmp_path}/in/{name}", (1_700_000_000 + at, 1_700_000_000 + at))
    start = lambda: stream_augment(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/chk", lexicon, model, p, 1).awaitTermination()
    start()
    sink = spark.read.parquet(f"{tmp_path}/out")
    assert sink.select("batch_id").distinct().count() == 3 and _rows(sink) == want

    # a late file with ids of all batches, in a run started again
    train.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    start()
    assert _rows(spark.read.parquet(f"{tmp_path}/out")) == want

    # a batch that is run again
    write_batch(part(1), 1, f"{tmp_path}/out", lexicon, model, p)
    assert _rows(spark.read.parquet(f"{tmp_path}/out")) == want


def test_a_broken_run_started_again_equals_an_unbroken_one(spark, tmp_path):
    from flipside.plans import resume
    from flipside.plans.rounds import augment_rounds
    train, lexicon, model = _fitted(spark)
    augment = lambda rows: augment_rounds(rows, lexicon, model, p)
    want, base = _rows(augment(train).selected), f"{tmp_path}/runs"
    assert len(want) > 10
    assert resume.selections(spark, base).count() == 0 and resume.to_do(train, base).count() == train.count()

    class Broken(Exception):
        pass

    def broken(rows):   # fails between the two writes: the selections are there, the ids aren't
        found = augment(rows)
        found.selected.selectExpr("*", "'lost' AS attempt").write.partitionBy("attempt").parquet(f"{base}/selected")
        raise Broken

    try:
        resume.augment_resumable(train, broken, base)
    except Broken:
        pass
    assert resume.selections(spark, base).count() == 0
    resume.write_attempt(train.where("id % 2 = 0"), augment, base)   # both written, not committed
    assert resume.selections(spark, base).count() == 0
    resume.augment_resumable(train.where("id % 2 = 1"), augment, base)
    assert resume.to_do(train, base).where("id % 2 = 1").count() == 0
    assert _rows(resume.augment_resumable(train, augment, base)) == want
    assert _rows(resume.augment_resumable(train, augment, base)) == want   # nothing is pending
    assert resume.to_do(train, base).count() == 0
