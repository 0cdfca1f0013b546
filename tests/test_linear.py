import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001

from flipside.operators.linear import LinearParams, fit_linear, predict_linear

SCHEMA = "id long, text string, label int"
GOOD, BAD = "what a kind and lovely day", "you are a stupid stupid fool"


def rows(n, start=0):
    return [(start + i, f"{(BAD, GOOD)[i % 2]} w{i % 5} said x{chr(97 + i % 7)}", 1 - i % 2) for i in range(n)]


def plain(train, validation, p, slot_of):
    """Gradient descent in dictionaries, one text at a time."""
    import re

    def vector(text):
        counts = {}
        for t in re.findall("[a-z']+", (text or "").lower()):
            counts[slot_of(t)] = counts.get(slot_of(t), 0) + 1
        v = {s: 1 + math.log(c) for s, c in counts.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {s: x / norm for s, x in v.items()}

    w, m, history = {}, {}, []
    score = lambda v: sum(x * w.get(s, 0.0) for s, x in v.items()) + w.get(-1, 0.0)
    data = [(vector(t), y) for _, t, y in train]
    share = {c: len(data) / 2 / max(1, sum(y == c for _, y in data)) for c in (0, 1)}
    for _ in range(p.epochs):
        g = {}
        for v, y in data:
            err = share[y] * (1 / (1 + math.exp(-score(v))) - y)
            for s, x in [*v.items(), (-1, 1.0)]:
                g[s] = g.get(s, 0.0) + x * err / len(data)
        for s in g:
            m[s] = p.momentum * m.get(s, 0.0) - p.step * (g[s] + (p.penalty * w.get(s, 0.0) if s >= 0 else 0.0))
        for s in g:
            w[s] = w.get(s, 0.0) + m[s]
        loss = sum(share[y] * math.log(1 + math.exp(-score(v) if y else score(v))) for v, y in data) / len(data)
        right = sum((score(vector(t)) > 0) == bool(y) for _, t, y in validation) / max(1, len(validation))
        history.append((loss, right))
    return history


def test_epochs_against_plain_gradient_descent(spark):
    import hashlib
    p = LinearParams(buckets=64, epochs=5)   # so few that tokens share slots
    train, val = rows(40) + [(90, None, 0), (91, "", 1), (92, "stupid " * 50, 1)], rows(9, 200) + [(300, GOOD, 1)]
    model = fit_linear(spark.createDataFrame(train, SCHEMA), spark.createDataFrame(val, SCHEMA), p)
    got = [tuple(r) for r in model.history.orderBy("epoch").collect()]
    want = plain(train, val, p, lambda t: int(hashlib.md5(f"slot:{t}".encode()).hexdigest()[:8], 16) % 64)
    assert np.allclose([(loss, acc) for _, loss, acc, _, _ in got], want)
    best = max(f1 for _, _, _, f1, _ in got)
    assert [e for e, *_, kept in got if kept] == [min(e for e, _, _, f1, _ in got if f1 == best)]


def test_the_best_epochs_weights_predict(spark):
    val = spark.createDataFrame(rows(9, 200), SCHEMA)
    model = fit_linear(spark.createDataFrame(rows(40), SCHEMA), val, LinearParams(buckets=512, epochs=3))
    found = predict_linear(model, val.withColumn("slots", F.lit("x")))
    assert all(r.prediction == r.label and (r.probability > 0.5) == r.prediction for r in found.collect())
    assert found.columns == ["id", "text", "label", "slots", "prediction", "probability"]


def test_empty_tables_and_missing_labels(spark):
    none = spark.createDataFrame([], SCHEMA)
    model = fit_linear(none, none, LinearParams(buckets=8, epochs=2))
    assert not model.weights.any() and [r.kept for r in model.history.orderBy("epoch").collect()] == [True, False]
    got = predict_linear(model, spark.createDataFrame([(1, None, None), (2, "x", None)], SCHEMA)).collect()
    assert [(r.prediction, r.probability) for r in got] == [(0, 0.5)] * 2
    odd = spark.createDataFrame(rows(10) + [(77, GOOD, None)], SCHEMA)
    assert fit_linear(odd, none, LinearParams(buckets=8, epochs=1)).history.first().train_loss == pytest.approx(
        fit_linear(odd.where("label IS NOT NULL"), none, LinearParams(buckets=8, epochs=1)).history.first().train_loss)


def test_jobs_move_no_texts_and_no_rows(spark):
    """Vectors are written once; an epoch's only exchange carries sums by slot."""
    from flipside.operators.linear import _epoch, PART_SCHEMA, slots
    shared = spark.sparkContext.broadcast(np.zeros(9))
    df = spark.createDataFrame(rows(4), SCHEMA).select(slots(F.col("text"), 8).alias("slots"), "label", F.lit(True).alias("train"))
    plan = df.mapInArrow(_epoch(shared, 8, (1.0, 1.0)), PART_SCHEMA).groupBy("kind", "slot").agg(F.sum("value"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_sum" in plan


def test_registered_epochs_learn(spark):
    from flipside.plans.queries import i1_train_epochs
    found = i1_train_epochs(spark, SF001).orderBy("epoch").collect()
    loss = [r.train_loss for r in found]
    assert len(loss) == LinearParams().epochs and loss == sorted(loss, reverse=True)
    assert sum(r.kept for r in found) == 1


def test_batches_are_worked_on_in_bounded_parts():
    """However many rows a batch has, the vectors made at once are bounded; values are those of the whole batch."""
    import numpy as np
    import pyarrow as pa

    from flipside.operators import linear
    rng = np.random.default_rng(1)
    lists = [rng.integers(0, 50, n).tolist() for n in (0, 3, 40, 0, 7, 7, 90, 1, 0)]
    batch = pa.RecordBatch.from_arrays([pa.array([[9]] + lists, pa.list_(pa.int32()))], ["slots"]).slice(1)
    parts = list(linear._parts(batch, 16))
    assert sum((p["slots"].to_pylist() for p in parts), []) == lists
    assert all(p.num_rows == 1 or sum(map(len, p["slots"].to_pylist())) <= 16 for p in parts) and len(parts) == 5
    weights = rng.normal(size=51)
    whole = linear._scores(weights, batch)[0]
    assert np.allclose(np.concatenate([linear._scores(weights, p)[0] for p in parts]), whole, atol=1e-12)
