"""I1, the iterative kind: a linear text classifier trained in epochs.

Rows become sparse vectors: tokens are hashed into ``buckets`` slots, a slot's
value is 1 + ln(count), and a vector has length 1. They are written once. Each
epoch is one Spark job over them: tasks add up the gradient of their rows and
count right and wrong predictions on the validation rows, Spark sums the parts
by slot, and the driver, which holds two vectors of ``buckets`` numbers and no
rows, takes one step of gradient descent with momentum. The weights of the
epoch with the best validation macro F1 stay (ties: the earliest). Both classes
weigh the same, however many rows they have. A task lost is computed again from
the written vectors.

Nothing but the vector of weights grows with ``buckets``, and nothing on the
driver with the data; a slot that every row has is one number a task before
the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.keys import hash_bucket
from ..functions.text import tokens
from ..sources.stages import written

PART_SCHEMA = "kind string, slot int, value double"


@dataclass(frozen=True)
class LinearParams:
    buckets: int = 1 << 16
    epochs: int = 6
    step: float = 4.0
    momentum: float = 0.9
    penalty: float = 1e-4


@dataclass
class LinearModel:
    """``weights``: one a slot and the intercept last; ``history``: a row an epoch."""

    weights: np.ndarray
    history: DataFrame
    params: LinearParams


def slots(text: Column, buckets: int) -> Column:
    """The slot of every token of the whole text, in order; null has none."""
    return F.coalesce(F.transform(tokens(text), lambda t: hash_bucket("slot", t, buckets=buckets)), F.array().cast("array<int>"))


def _parts(batch: pa.RecordBatch, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most ``most`` tokens together, or one row: what is worked on at once is bounded
    by this and not by the rows of a batch."""
    ends = np.cumsum(np.diff(batch.column("slots").offsets.to_numpy()))
    start = 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


def _vectors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, slot and value of every entry of a batch's sparse vectors."""
    lists = batch.column("slots")
    sizes = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(batch.num_rows), sizes)
    slot = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    pair, count = np.unique(row << 32 | slot, return_counts=True)
    row, slot = pair >> 32, pair & 0xFFFFFFFF
    value = 1 + np.log(count)
    norm = np.sqrt(np.bincount(row, value * value, minlength=batch.num_rows))
    return row, slot, value / norm[row]


def _scores(weights: np.ndarray, batch: pa.RecordBatch) -> tuple[np.ndarray, tuple]:
    row, slot, value = entries = _vectors(batch)
    return np.bincount(row, value * weights[slot], minlength=batch.num_rows) + weights[-1], entries


def _epoch(shared, buckets: int, share: tuple[float, float]):
    """A task's part of an epoch: gradient and loss of train rows, counts of (label, prediction) of the others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        gradient, met = np.zeros(buckets + 1), np.zeros(buckets + 1, bool)
        loss, seen = 0.0, np.zeros(4)
        for batch in (part for whole in batches for part in _parts(whole)):
            z, (row, slot, value) = _scores(weights, batch)
            y = batch.column("label").to_numpy(zero_copy_only=False).astype(float)
            train = batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
            weight = np.where(train, np.where(y == 1, share[1], share[0]), 0.0)
            loss += (weight * np.logaddexp(0, np.where(y == 1, -z, z))).sum()
            error = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
            gradient[:-1] += np.bincount(slot, value * error[row], minlength=buckets)
            gradient[-1] += error.sum()
            met[slot[train[row]]] = True
            seen += np.bincount((2 * y + (z > 0))[~train].astype(int), minlength=4)
        met[-1] = True
        at = np.flatnonzero(met)
        yield pa.RecordBatch.from_pydict({
            "kind": ["gradient"] * len(at) + ["loss"] + ["seen"] * 4,
            "slot": pa.array(np.concatenate([at, [0], np.arange(4)]), pa.int32()),
            "value": np.concatenate([gradient[at], [loss], seen])})

    return run


def _quality(seen: np.ndarray) -> tuple[float, float]:
    """Accuracy and macro F1 of counts by 2 * label + prediction, as I3 defines them."""
    tn, fp, fn, tp = seen
    f1 = [2 * hit / (2 * hit + fp + fn) for hit in (tn, tp) if hit + fp + fn]
    return (tn + tp) / max(1.0, seen.sum()), sum(f1) / max(1, len(f1))


def fit_linear(train: DataFrame, validation: DataFrame, params: LinearParams = LinearParams(), text_col: str = "text") -> LinearModel:
    """Trains on (text, label) of ``train``; ``validation`` picks the epoch. Rows without a label are left out; an
    empty train table gives weights of 0, an empty validation table the first epoch."""
    spark = train.sparkSession
    rows = [df.where(F.col("label").isNotNull()).select(slots(F.col(text_col), params.buckets).alias("slots"), F.col("label").cast("int").alias("label"), F.lit(is_train).alias("train"))
            for df, is_train in ((train, True), (validation, False))]
    vectors = written(rows[0].unionByName(rows[1]), "vectors")
    of_class = {r.label: r["count"] for r in vectors.where("train").groupBy("label").count().collect()}
    n = sum(of_class.values())
    share = tuple(n / (2 * of_class[c]) if c in of_class else 0.0 for c in (0, 1))
    weights, move = np.zeros(params.buckets + 1), np.zeros(params.buckets + 1)
    best, history = (-1.0, weights), []
    for epoch in range(params.epochs + 1):
        shared = spark.sparkContext.broadcast(weights)
        parts = vectors.mapInArrow(_epoch(shared, params.buckets, share), PART_SCHEMA).groupBy("kind", "slot").agg(F.sum("value").alias("value")).toArrow()
        shared.unpersist()
        kind, slot, value = (parts.column(c).to_numpy() for c in ("kind", "slot", "value"))
        of = lambda name, size: np.bincount(slot[kind == name], value[kind == name], minlength=size)
        if epoch:   # the job has measured the weights that the epoch before it left
            acc, f1 = _quality(of("seen", 4))
            history.append((epoch, float(of("loss", 1)[0] / max(1, n)), float(acc), float(f1)))
            if f1 > best[0]:
                best = (f1, weights)
        shrunk = np.append(weights[:-1], 0.0) * params.penalty   # the intercept isn't held back
        move = params.momentum * move - params.step * (of("gradient", params.buckets + 1) / max(1, n) + shrunk)
        weights = weights + move
    kept = next(e for e, _, _, f1 in history if f1 == best[0])
    table = spark.createDataFrame([(*h, h[0] == kept) for h in history], "epoch int, train_loss double, val_acc double, val_f1 double, kept boolean")
    return LinearModel(best[1], table, params)


def predict_linear(model: LinearModel, df: DataFrame, text_col: str = "text") -> DataFrame:
    """I2 for this kind: ``df`` with prediction (0 on a tie) and probability of class 1; texts stay where they are."""
    shared = df.sparkSession.sparkContext.broadcast(model.weights)

    @F.arrow_udf("double")
    def logit(lists: pa.Array) -> pa.Array:
        parts = _parts(pa.RecordBatch.from_arrays([lists], ["slots"]))
        return pa.array(np.concatenate([np.zeros(0), *(_scores(shared.value, part)[0] for part in parts)]))

    scored = df.withColumn("_z", logit(slots(F.col(text_col), model.params.buckets)))
    return scored.withColumn("prediction", (F.col("_z") > 0).cast("int")).withColumn("probability", 1 / (1 + F.exp(-F.col("_z")))).drop("_z")
