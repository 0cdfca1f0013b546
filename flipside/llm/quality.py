"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w.x): all grades share the weights w over hashed text features and the
thresholds are ordered. The expected grade and the tail probability P(grade >= k) select documents.

Features of a whole text, hashed to ``2**bits`` slots: its lower-cased words, the shapes of its words (runs of
upper case, lower case, digits and each mark) and, by its share in tenths, repeats of the word before.
A slot's value is log(1 + count), and a text's vector has length 1.

Fitting uses at most ``max_rows`` rated documents, those whose ids hash lowest; everything else covers all rows.

Defined cases: null and empty texts have no features, so their grade follows from the thresholds alone; null
grades are not ratings; of several ratings of an id the least counts; without any ratings all thresholds
are 0 and every tail probability is a half, which keeps a document; ties at the cut are kept; rows that share
an id get a row each; an empty table gives an empty one. Other columns are carried or ignored, never read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from flipside.llm.common import free_name, lowest, map_arrow, texts, worker_memo

_RUNS = (re.compile("[^\\W\\d_a-zà-öø-ÿ]+"), re.compile("[a-zà-öø-ÿ]+"), re.compile(r"\d+"))


def shape(word: str) -> str:
    for run, sign in zip(_RUNS, "Xx9"):
        word = run.sub(sign, word)
    return word[:24]


class Features:
    """Slots of words and shapes; remembers words, at most ``memo`` of them."""

    def __init__(self, bits: int, memo: int = 300_000):
        self.mask, self.limit = (1 << bits) - 1, memo
        self.memo: dict[str, tuple[int, int]] = {}
        self.repeat = [self.slot(f"repeat:{tenth}") for tenth in range(11)]

    def slot(self, name: str) -> int:
        return xxhash.xxh3_64_intdigest(name) & self.mask

    def look(self, word: str) -> tuple[int, int]:
        if len(self.memo) >= self.limit:
            self.memo.clear()
        found = self.memo[word] = self.slot("w:" + word.lower()), self.slot("s:" + shape(word))
        return found

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Slots and values."""
        words = text.split()
        n = len(words)
        if not n:
            return np.empty(0, np.int64), np.empty(0)
        memo = self.memo
        both = np.array([memo.get(w) or self.look(w) for w in words], np.int64)
        again = sum(map(str.__eq__, words, words[1:]))
        slots, counts = np.unique(both, return_counts=True)
        values = np.log1p(counts)
        if again:
            slots, values = np.append(slots, self.repeat[10 * again // n]), np.append(values, 2 * np.log1p(again))
        return slots, values / np.sqrt(values @ values)


@worker_memo
def _features(bits: int) -> Features:
    return Features(bits)


def _vectors(bits: int):
    features = _features(bits)

    def step(batch):
        found = [features.vector(t) for t in texts(batch, "text")]
        return {"grade": batch["grade"], "slots": [s for s, _ in found], "vals": [v for _, v in found]}

    return step


def _fit(grades: int, bits: int, rounds: int, ridge: float):
    """One task's fit on the bounded sample: returns weights and thresholds."""
    rows: list[tuple[int, np.ndarray, np.ndarray]] = []

    def take(batch) -> None:
        rows.extend(zip(batch["grade"].to_pylist(), (np.array(x, np.int64) for x in batch["slots"].to_pylist()),
                        (np.array(x) for x in batch["vals"].to_pylist())))

    def done() -> tuple[np.ndarray, np.ndarray]:
        rows.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes(), r[2].tobytes()))
        weights, cuts = np.zeros(1 << bits), np.zeros(grades - 1)
        if not rows:
            return weights, cuts
        y = np.array([r[0] for r in rows])
        slots, values = np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows])
        owner = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
        for k in range(grades - 1):
            share = (np.count_nonzero(y <= k) + 0.5) / (len(y) + 1)
            cuts[k] = np.log(share / (1 - share))
        # thresholds as a first value and logarithms of the steps, so that they stay ordered
        steps = np.log(np.maximum(np.diff(cuts), 1e-2))
        free = np.concatenate([weights, cuts[:1], steps])
        mean, square = np.zeros_like(free), np.zeros_like(free)
        n = len(weights)
        for t in range(1, rounds + 1):
            cuts = free[n] + np.concatenate([[0.0], np.cumsum(np.exp(free[n + 1:]))])
            z = np.bincount(owner, values * free[slots], len(rows))
            edges = np.concatenate([[-np.inf], cuts, [np.inf]])
            upper, lower = _sigmoid(edges[y + 1] - z), _sigmoid(edges[y] - z)
            p = np.maximum(upper - lower, 1e-12)
            du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
            slope = (du - dl) / len(rows)  # of the loss, by z
            by_cut = np.array([np.sum(dl[y == k + 1]) - np.sum(du[y == k]) for k in range(grades - 1)]) / len(rows)
            gradient = np.concatenate([
                np.bincount(slots, values * slope[owner], n) + ridge * free[:n] / len(rows), [by_cut.sum()],
                np.exp(free[n + 1:]) * np.cumsum(by_cut[::-1])[::-1][1:]])
            mean = 0.9 * mean + 0.1 * gradient
            square = 0.99 * square + 0.01 * gradient**2
            free = free - 0.1 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
        return free[:n], free[n] + np.concatenate([[0.0], np.cumsum(np.exp(free[n + 1:]))])

    return take, done


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit(df: DataFrame, ratings: DataFrame, grades: int, id_col: str = "doc_id", text_col: str = "text",
        grade_col: str = "grade", max_rows: int = 6000, bits: int = 18, rounds: int = 300, ridge: float = 0.02
        ) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds, learned from at most ``max_rows`` rated documents."""
    rated = ratings.where(F.col(grade_col).isNotNull() & F.col(id_col).isNotNull())
    rated = rated.groupBy(F.col(id_col).alias("id")).agg(F.min(grade_col).cast("int").alias("grade"))
    rated = lowest(rated, "id", max_rows)
    sample = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(rated), "id")
    sample = sample.orderBy(F.xxhash64("id"), "id", F.xxhash64("text")).limit(max_rows).select("text", "grade")
    vectors = map_arrow(sample.repartition(8), "grade int, slots array<long>, vals array<double>", _vectors, bits)

    def learn(batches):
        take, done = _fit(grades, bits, rounds, ridge)
        for batch in batches:
            take(batch)
        weights, cuts = done()
        yield pa.RecordBatch.from_pydict({"weights": [weights.astype(np.float32).tobytes()], "cuts": [cuts.tobytes()]})

    found = vectors.coalesce(1).mapInArrow(learn, "weights binary, cuts binary").first()
    if found is None:
        return np.zeros(1 << bits, np.float32), np.zeros(grades - 1)
    return np.frombuffer(found.weights, np.float32), np.frombuffer(found.cuts)


def _score(model, bits: int, others: list[str], text: str, out: str):
    features, (weights, cuts) = _features(bits), model.value

    def step(batch):
        z = np.array([values @ weights[slots] for slots, values in map(features.vector, texts(batch, text))])
        return {c: batch[c] for c in others} | {out: list(_sigmoid(z[:, None] - cuts))}

    return step


def tail_probabilities(df: DataFrame, model: tuple[np.ndarray, np.ndarray], text_col: str = "text", keep: list[str] | None = None,
                       out_col: str = "tails") -> DataFrame:
    """The columns ``keep`` of ``df`` (all if not given) and ``out_col``, which none of them may be called:
    P(grade >= 1), P(grade >= 2), ..."""
    keep = df.columns if keep is None else keep
    text = free_name(df, "text")
    source = df.select(*(F.col(f"`{c}`") for c in keep), F.col(text_col).alias(text))
    schema = StructType([*source.schema.fields[:-1]]).add(out_col, ArrayType(DoubleType()))
    bits = len(model[0]).bit_length() - 1
    return map_arrow(source, schema, _score, df.sparkSession.sparkContext.broadcast(model), bits, keep, text, out_col)


def expected_grade(tails: str = "tails") -> Column:
    return F.aggregate(tails, F.lit(0.0), lambda total, p: total + p)


def selected(grade: int = 1, least: float = 0.5, tails: str = "tails") -> Column:
    return F.element_at(tails, grade) >= least
