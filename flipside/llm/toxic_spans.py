"""Toxic spans by a linear-chain conditional random field, aggregated to document scores.

Tokens of labelled documents get labels first: in a toxic document those words, or beginnings of words, that
labelled documents tie to toxicity (a likelihood-ratio test of document counts, and a ratio of rates); all
others are clean. A field of two states with hashed word, prefix and suffix features learns from them. Forward-backward
marginals of a whole text give each token's probability; a document's score is a logistic function of the two
greatest and of their sum, fitted on labelled documents that the field hasn't seen, and runs of tokens of a
half or more are the offending offsets.

The chain runs through all texts of a batch at once: a text's first token forgets what came before. It is cut
in blocks whose 2 x 2 products are taken side by side, and a scan over blocks joins them exactly.

Fitting uses at most ``max_rows`` labelled documents, half of each label where there are enough, those whose
ids hash lowest, and near copies among them once, since words of a text with copies would look significant;
everything else covers all rows.

Defined cases: null texts and texts without words score 0 and have no spans; null labels aren't learnt from; of
several labels of an id the greatest counts; without labels of both kinds all scores are 0; rows that share an
id get a row each; an empty table gives an empty one. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from flipside.llm.common import lowest, map_arrow, texts

WORD = re.compile(r"\w+")


def parts_of(word: str) -> list[str]:
    """What a word is known by: itself, its beginnings and its end."""
    word = word.lower()
    return ["w" + word, *(f"p{word[:n]}" if len(word) >= n else "-" for n in (3, 4, 5)), "s" + word[-3:]]


def once(documents: list[tuple[list[str], int]], size: int = 5, keys: int = 4) -> list[tuple[list[str], int]]:
    """Documents without those that share a MinHash of their word shingles with an earlier one."""
    seen: set[tuple[int, int]] = set()
    out = []
    for words, label in documents:
        grams = {" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))}
        own = {(k, min(xxhash.xxh3_64_intdigest(g, seed=k) for g in grams)) for k in range(keys)}
        if seen.isdisjoint(own):
            out.append((words, label))
        seen |= own
    return out


def summary(p: np.ndarray) -> np.ndarray:
    """What a document's score is made of: logits of its two greatest marginals, logarithm of their sum."""
    top = np.concatenate([np.zeros(2), np.partition(p, -2)[-2:] if len(p) > 2 else p])
    top = np.clip(np.sort(top)[-2:], 1e-6, 1 - 1e-6)
    return np.array([*np.log(top / (1 - top)), np.log(p.sum() + 1e-6), 1.0])


def evidence(documents: list[tuple[list[str], int]], test: float, ratio: float) -> set[str]:
    """Parts tied to toxic documents: significantly, and ``ratio`` times as frequent there. Words of any length
    are tried, beginnings from four characters."""
    counts = {0: Counter(), 1: Counter()}
    sizes = Counter(label for _, label in documents)
    for words, label in documents:
        counts[label].update({p for w in set(words) for p in parts_of(w) if p[0] == "w" or p[0] == "p" and len(p) > 4})
    share = sizes[1] / max(1, sizes[0] + sizes[1])
    found = set()
    for part, a in counts[1].items():
        b = counts[0][part]
        n = a + b
        strength = 2 * (a * np.log(a / (n * share)) + (b * np.log(b / (n * (1 - share))) if b else 0.0)) if share < 1 else 0.0
        if strength >= test and a * sizes[0] > ratio * b * sizes[1] and a * sizes[0] > ratio * 0.5 * sizes[1]:
            found.add(part)
    return found


class Chain:
    """Exact forward and backward vectors of concatenated two-state chains."""

    def __init__(self, lift: np.ndarray, first: np.ndarray, start: np.ndarray, move: np.ndarray, block: int = 256):
        """lift: log-weight of state 1 over state 0 at each token; first: where a text begins; start: weights of
        the states at a beginning; move: weights of state pairs."""
        n = len(lift)
        self.n, self.block = n, block
        lanes = -(-n // block)
        pad = lanes * block - n
        e = np.concatenate([np.exp(np.clip(lift, -30, 30)), np.ones(pad)]).reshape(lanes, block).T
        f = np.concatenate([first, np.ones(pad, bool)]).reshape(lanes, block).T
        # step[t] as rows by former state, columns by new state
        self.a = np.empty((4, block, lanes))
        for k, (i, j) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1))):
            self.a[k] = np.where(f, start[j], move[i, j]) * (e if j else 1.0)
        self.e, self.f = e, f

    def vectors(self):
        """Forward and backward vectors, each summing to 1: arrays (2, block, lanes)."""
        a, block, lanes = self.a, *self.e.shape
        product = np.zeros((4, lanes))
        product[0] = product[3] = 1
        for t in range(block):
            p00, p01, p10, p11 = product
            x00, x01, x10, x11 = a[:, t]
            product = np.stack([p00 * x00 + p01 * x10, p00 * x01 + p01 * x11, p10 * x00 + p11 * x10, p10 * x01 + p11 * x11])
            product /= product.sum(axis=0)
        into, out = np.empty((2, lanes)), np.empty((2, lanes))
        v = (0.5, 0.5)
        for i, (p00, p01, p10, p11) in enumerate(product.T.tolist()):
            into[:, i] = v
            v = v[0] * p00 + v[1] * p10, v[0] * p01 + v[1] * p11
            v = v[0] / (v[0] + v[1]), v[1] / (v[0] + v[1])
        v = (0.5, 0.5)
        for i, (p00, p01, p10, p11) in reversed(list(enumerate(product.T.tolist()))):
            out[:, i] = v
            v = p00 * v[0] + p01 * v[1], p10 * v[0] + p11 * v[1]
            v = v[0] / (v[0] + v[1]), v[1] / (v[0] + v[1])
        forward, backward = np.empty((2, block, lanes)), np.empty((2, block, lanes))
        u = into
        for t in range(block):
            u = np.stack([u[0] * a[0, t] + u[1] * a[2, t], u[0] * a[1, t] + u[1] * a[3, t]])
            u /= u.sum(axis=0)
            forward[:, t] = u
        u = out
        for t in range(block - 1, -1, -1):
            backward[:, t] = u
            u = np.stack([a[0, t] * u[0] + a[1, t] * u[1], a[2, t] * u[0] + a[3, t] * u[1]])
            u /= u.sum(axis=0)
        return forward, backward

    def flat(self, x: np.ndarray) -> np.ndarray:
        return x.T.reshape(-1)[: self.n]

    def marginals(self) -> np.ndarray:
        forward, backward = self.vectors()
        both = forward * backward
        return self.flat(both[1] / both.sum(axis=0))


class Field:
    def __init__(self, bits: int = 18, memo: int = 400_000):
        self.bits, self.limit = bits, memo
        self.weights = np.zeros(1 << bits)
        self.start, self.move = np.zeros(2), np.zeros((2, 2))
        self.bias = -6.0
        self.known = False
        self.logistic = np.zeros(4)
        self.memo: dict[str, float] = {}

    def learnt(self) -> dict[str, list]:
        return {"weights": [np.asarray(self.weights, np.float32).tobytes()], "states": [np.concatenate([self.start, self.move.ravel(), self.logistic]).tobytes()],
                "bias": [self.bias], "known": [self.known]}

    @classmethod
    def of(cls, row) -> Field:
        field = cls()
        states = np.frombuffer(row.states)
        field.weights, field.start, field.move = np.frombuffer(row.weights, np.float32), states[:2], states[2:6].reshape(2, 2)
        field.logistic = states[6:]
        field.bias, field.known = row.bias, row.known
        return field

    def slots(self, words: list[str]) -> np.ndarray:
        mask = (1 << self.bits) - 1
        return np.array([[xxhash.xxh3_64_intdigest(p) & mask for p in parts_of(w)] for w in words], np.int64).reshape(-1, 5)

    def fit(self, documents: list[tuple[list[str], int]], rounds: int, test: float, ratio: float, ridge: float = 1e-6) -> None:
        if {label for _, label in documents} != {0, 1}:
            return
        toxic = evidence(documents, test, ratio)
        distinct = sorted(set().union(*(words for words, _ in documents)))
        number = {w: i for i, w in enumerate(distinct)}
        marked = np.array([not toxic.isdisjoint(parts_of(w)) for w in distinct])
        documents = [d for d in documents if d[0]]
        token = np.concatenate([np.fromiter(map(number.__getitem__, words), np.int64, len(words)) for words, _ in documents])
        sizes = [len(words) for words, _ in documents]
        y = marked[token] & np.repeat([label == 1 for _, label in documents], sizes)
        first = np.zeros(len(token), bool)
        first[np.cumsum([0, *sizes[:-1]])] = True
        if not y.any():
            return
        self.known = True
        slots = self.slots(distinct)
        n = len(self.weights)
        free = np.concatenate([self.weights, [self.bias], np.zeros(6)])
        mean, square = np.zeros_like(free), np.zeros_like(free)
        y1 = y.astype(float)
        seen_start = np.bincount(y[first], minlength=2)
        inner = np.flatnonzero(~first)
        seen_move = np.bincount(2 * y[inner - 1] + y[inner], minlength=4).reshape(2, 2)
        for t in range(1, rounds + 1):
            lift = (free[slots].sum(axis=1) + free[n])[token]
            start, move = np.exp(free[n + 1:n + 3]), np.exp(free[n + 3:]).reshape(2, 2)
            chain = Chain(lift, first, start, move)
            forward, backward = chain.vectors()
            both = forward * backward
            p = chain.flat(both[1] / both.sum(axis=0))
            f0, f1 = (chain.flat(forward[i])[inner - 1] for i in (0, 1))
            b0, b1 = (chain.flat(backward[i])[inner] for i in (0, 1))
            b1 = b1 * np.exp(np.clip(lift[inner], -30, 30))
            pair = np.array([f0 * b0 * move[0, 0], f0 * b1 * move[0, 1], f1 * b0 * move[1, 0], f1 * b1 * move[1, 1]])
            pair = (pair / pair.sum(axis=0)).sum(axis=1).reshape(2, 2)
            wrong = np.bincount(token, p - y1, len(distinct))
            gradient = np.concatenate([
                np.bincount(slots.ravel(), np.repeat(wrong, 5), n) + ridge * len(token) * free[:n], [wrong.sum()],
                np.array([np.sum(1 - p[first]), np.sum(p[first])]) - seen_start, (pair - seen_move).ravel()]) / len(documents)
            mean = 0.9 * mean + 0.1 * gradient
            square = 0.99 * square + 0.01 * gradient**2
            free = free - 0.3 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
        self.weights, self.bias = free[:n].astype(np.float32), float(free[n])
        self.start, self.move = free[n + 1:n + 3], free[n + 3:].reshape(2, 2)

    def calibrate(self, documents: list[tuple[list[str], int]], ridge: float = 0.05) -> None:
        """Fits the logistic function of document scores, by Newton's method."""
        documents = [d for d in documents if d[0]]
        if not self.known or {label for _, label in documents} != {0, 1}:
            self.logistic = np.array([0.5, 0.0, 0.0, 0.0])
            return
        x = np.array([summary(p) for p in self.marginals([words for words, _ in documents])])
        y = np.array([label for _, label in documents])
        w = np.zeros(4)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(4)
            w = w - np.linalg.solve(curve, x.T @ (p - y) + ridge * w)
        self.logistic = w

    def marginals(self, batch: list[list[str]]) -> list[np.ndarray]:
        """For each list of words the probability that each is toxic."""
        sizes = np.array([len(words) for words in batch])
        if not sizes.sum() or not self.known:
            return [np.zeros(n) for n in sizes]
        new = list(set().union(*batch).difference(self.memo))
        if len(self.memo) + len(new) > self.limit:
            self.memo.clear()
            new = list(set().union(*batch))
        self.memo.update(zip(new, (self.weights[self.slots(new)].sum(axis=1) + self.bias).tolist()))
        lift = np.concatenate([np.fromiter(map(self.memo.__getitem__, words), float, len(words)) for words in batch])
        ends = np.cumsum(sizes)
        first = np.zeros(len(lift), bool)
        first[(ends - sizes)[sizes > 0]] = True
        p = Chain(lift, first, np.exp(self.start), np.exp(self.move)).marginals()
        return np.split(p, ends[:-1])

    def score(self, batch: list[str]) -> tuple[list[float], list[list[dict]]]:
        """Scores and offending spans (start, end in characters) of texts."""
        scores, spans = [], []
        for text, p in zip(batch, self.marginals([WORD.findall(t) for t in batch])):
            scores.append(float(1 / (1 + np.exp(-np.clip(summary(p) @ self.logistic, -30, 30)))) if self.known and len(p) else 0.0)
            found: list[dict] = []
            if (bad := set(np.flatnonzero(p >= 0.5).tolist())):
                for i, m in enumerate(WORD.finditer(text)):
                    if i in bad and found and i - 1 in bad:
                        found[-1]["end"] = m.end()
                    elif i in bad:
                        found.append({"start": m.start(), "end": m.end()})
            spans.append(found)
        return scores, spans


def fit(df: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", max_rows: int = 3000, rounds: int = 60, test: float = 20.0, ratio: float = 20.0) -> Field:
    """Learns from at most ``max_rows`` labelled documents among those where ``train`` holds."""
    known = labels.where(train & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    toxic, clean = (lowest(known.where(F.col("label") == k), "id", max_rows // 2) for k in (1, 0))
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(toxic.union(clean)), "id")
    docs = docs.orderBy(F.xxhash64("id"), "id", F.xxhash64("text")).limit(max_rows).select("text", "label")

    def learn(batches):
        rows = [r for b in batches for r in zip(texts(b, "text"), b["label"].to_pylist())]
        field = Field()
        documents = once([(WORD.findall(t), k) for t, k in sorted(rows, key=lambda r: (xxhash.xxh3_64_intdigest(r[0]), r))])
        field.fit([d for i, d in enumerate(documents) if i % 3], rounds, test, ratio)
        field.calibrate(documents[::3])
        yield pa.RecordBatch.from_pydict(field.learnt())

    found = docs.coalesce(1).mapInArrow(learn, "weights binary, states binary, bias double, known boolean").first()
    return Field.of(found) if found else Field()


def _score(field):
    def step(batch):
        scores, spans = field.value.score(texts(batch, "text"))
        return {"id": batch["id"], "score": scores, "spans": spans}

    return step


def tag(df: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, spans (start and end in characters)."""
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = out.schema["id"].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(field)
    return map_arrow(out, f"id {kind}, score double, spans array<struct<start:int,end:int>>", _score, shared).withColumnRenamed("id", id_col)
