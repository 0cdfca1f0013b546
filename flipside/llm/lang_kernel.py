"""Language identification with a string kernel.

The kernel of two texts is the number of n-grams of 1 to 3 characters present in both (the blended-spectrum
presence kernel), divided by the geometric mean of their own numbers. Landmark texts of the training rows span
a Nyström feature space, in which one ridge regression per language, one against the rest, gives the scores.
Whole texts are scored in batches, by matrix products of presence rows with the landmarks' presence.

Texts are lower-cased; characters that no landmark has count as one and the same. Fitting uses, of each language,
the ``rows_per_lang`` rows whose ids hash lowest, so that a language is learnt however few of the rows it has, and
every language weighs the same. The first ``landmarks_per_lang`` of them are landmarks; of a landmark's n-grams,
those of the whole text, at most the ``landmark_grams`` that hash lowest are kept. Everything else covers all
rows. The driver holds rows x landmarks of the sample: a few MB for ten languages, 8 GB for 300, where the
parameters should be lowered.

Defined cases: null texts and texts without a letter (``\\p{L}``: digits, powers and fractions aren't) are ``und``
with score 0; rows without a language aren't learnt from; without any, every row is ``und``; equal scores go to the
language first in order; rows that share an id get a row each; rows without an id are learnt from and scored like
others; an empty table gives an empty one. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from flipside.llm.common import map_arrow, stored, texts

#: Bits of a character in the code of a landmark's n-gram; no character is 0 there.
BITS = 21


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def raw_grams(text: str, most: int | None = None) -> np.ndarray:
    """Codes of the distinct n-grams of a whole text, three characters to a code; the ``most`` that hash lowest."""
    one = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64) + 1
    two = (one[:-1] << BITS) | one[1:]
    three = (two[:-1] << BITS) | one[2:]
    codes = np.unique(np.concatenate([one, two, three]))
    if most is not None and len(codes) > most:
        mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        codes = np.sort(codes[np.argsort(mixed, kind="stable")[:most]])
    return codes


class Kernel:
    """Presence of n-grams over the landmarks' alphabet, and products with the landmarks' presence.

    A landmark is a text, or the codes of its n-grams."""

    def __init__(self, landmarks: list):
        marks = [raw_grams(m) if isinstance(m, str) else np.asarray(m, np.int64) for m in landmarks]
        low = (1 << BITS) - 1
        places = [np.stack([m >> (2 * BITS), (m >> BITS) & low, m & low]) for m in marks]
        alphabet = np.unique(np.concatenate([p.ravel() for p in places])) if places else np.empty(0, np.int64)
        alphabet = alphabet[alphabet > 0] - 1
        self.size = len(alphabet) + 1
        self.number = np.zeros(0x110000, np.int64)
        self.number[alphabet] = np.arange(1, self.size)
        grams = [self._own_codes(p) for p in places]
        self.vocabulary = np.unique(np.concatenate(grams)) if grams else np.empty(0, np.int64)
        self.presence = np.zeros((len(self.vocabulary), len(landmarks)), np.float32)
        for j, g in enumerate(grams):
            self.presence[np.searchsorted(self.vocabulary, g), j] = 1
        self.own = np.array([len(g) for g in grams], np.float32)

    def _own_codes(self, places: np.ndarray) -> np.ndarray:
        """The codes that ``grams`` gives n-grams of these characters."""
        a = self.size
        x, y, z = (np.where(p > 0, self.number[p - 1], 0) for p in places)
        offset = np.where(places[0] > 0, a + a * a, np.where(places[1] > 0, a, 0))
        return np.sort(offset + (x * a + y) * a + z)

    def grams(self, text: str) -> np.ndarray:
        """Codes of the distinct n-grams, in order."""
        one = self.number[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
        a = self.size
        two = one[:-1] * a + one[1:]
        three = two[:-1] * a + one[2:]
        return np.concatenate([np.unique(one), a + np.unique(two), a + a * a + np.unique(three)])

    def products(self, batch: list[str], together: int = 128) -> np.ndarray:
        out = np.zeros((len(batch), len(self.own)), np.float32)
        for start in range(0, len(batch), together):
            some = batch[start:start + together]
            here = np.zeros((len(some), len(self.vocabulary)), np.float32)
            own = np.ones(len(some), np.float32)
            for i, text in enumerate(some):
                codes = self.grams(text)
                if not len(codes):
                    continue
                own[i] = len(codes)
                at = np.searchsorted(self.vocabulary, codes)
                at[at == len(self.vocabulary)] = 0
                here[i, at[self.vocabulary[at] == codes]] = 1
            out[start:start + len(some)] = here @ self.presence / np.sqrt(own[:, None] * self.own)
        return out


class Model:
    def __init__(self, kernel: Kernel, langs: list[str], weights: np.ndarray):
        self.kernel, self.langs, self.weights = kernel, langs, weights

    def predict(self, batch: list[str]) -> tuple[list[str], list[float]]:
        langs, scores = ["und"] * len(batch), [0.0] * len(batch)
        some = [i for i, t in enumerate(batch) if self.langs and has_letter(t)]
        if some:
            k = self.kernel.products([batch[i] for i in some])
            found = np.column_stack([k, np.ones(len(some), np.float32)]) @ self.weights
            for i, best, row in zip(some, found.argmax(axis=1), found):
                langs[i], scores[i] = self.langs[best], float(min(1.0, max(0.0, row[best])))
        return langs, scores


def _products(kernel):
    def step(batch):
        return {"lang": batch["lang"], "k": list(kernel.value.products(texts(batch, "text")).astype(float))}

    return step


def _landmark_grams(most: int):
    def step(batch):
        return {"lang": batch["lang"], "turn": batch["turn"], "grams": [raw_grams(t, most) for t in texts(batch, "text")]}

    return step


def lowest_per_lang(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows of each language whose ids hash lowest, numbered from 1 (turn). Counts of the languages, one
    row each, set thresholds that leave hardly more than ``n`` rows of a language to be put in order."""
    key = F.shiftrightunsigned(F.xxhash64(F.lit(7), "id", F.xxhash64("text")), 1)
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n_lang"))
    reach = (F.lit(n + 6 * n**0.5 + 20) / F.col("n_lang")) * F.lit(float(2**63))
    few = rows.withColumn("key", key).join(F.broadcast(counts), "lang").where(F.col("key").cast("double") <= reach)
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("key", "id", "text"))
    return few.withColumn("turn", turn).where(F.col("turn") <= n).select("lang", "text", "turn")


def fit(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        landmarks_per_lang: int = 16, landmark_grams: int = 6000, rows_per_lang: int = 500, ridge: float = 1.0) -> Model:
    """Learns from the text and language of rows where ``train`` holds."""
    spark = df.sparkSession
    rows = df.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sample = stored(lowest_per_lang(rows.where(F.col("text").rlike(r"\p{L}")), rows_per_lang), "language-sample")
    marks = map_arrow(sample.where(F.col("turn") <= landmarks_per_lang), "lang string, turn int, grams array<long>",
                      _landmark_grams, landmark_grams).orderBy("turn", "lang").collect()
    if not marks:
        return Model(Kernel([]), [], np.zeros((1, 0), np.float32))
    kernel = spark.sparkContext.broadcast(Kernel([r.grams for r in marks]))
    found = map_arrow(sample.select("lang", "text").repartition(8), "lang string, k array<double>", _products, kernel).orderBy("lang", "k").collect()
    langs = sorted({r.lang for r in found})
    k = np.array([r.k for r in found])
    target = np.array([[r.lang == x for x in langs] for r in found], float)
    weight = (target @ (1 / target.sum(axis=0)) * len(found) / len(langs))[:, None]

    z = kernel.value.presence / np.sqrt(kernel.value.own)
    values, vectors = np.linalg.eigh((z.T @ z).astype(float))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    space = k @ root
    mean, rate = (weight * space).mean(axis=0), (weight * target).mean(axis=0)
    centred = weight * (space - mean)
    solved = np.linalg.solve(centred.T @ (space - mean) + ridge * np.eye(space.shape[1]), centred.T @ (target - rate))
    weights = np.vstack([root @ solved, rate - mean @ solved]).astype(np.float32)
    return Model(kernel.value, langs, weights)


def _predict(model):
    def step(batch):
        langs, scores = model.value.predict(texts(batch, "text"))
        return {"id": batch["id"], "lang_pred": langs, "score": scores}

    return step


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score."""
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = out.schema["id"].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)
    return map_arrow(out, f"id {kind}, lang_pred string, score double", _predict, shared).withColumnRenamed("id", id_col)
