import itertools
import zlib

import numpy as np
import odd
import pandas as pd
import pytest
from llm_helpers import local
from pyspark.sql import functions as F

from flipside.llm import lang_kernel, quality, queries, toxic_spans
from flipside.llm.common import fold

SF01 = "/root/testdata/sf0.01"


def held(of, other):
    return lambda i: zlib.crc32(str(i).encode()) % of == other


def test_chain_marginals_against_enumeration():
    pick = np.random.default_rng(2)
    lift, first = pick.normal(size=11) * 2, np.zeros(11, bool)
    first[[0, 4, 5]] = True
    start, move = np.exp(pick.normal(size=2)), np.exp(pick.normal(size=(2, 2)))
    got = toxic_spans.Chain(lift, first, start, move, block=3).marginals()
    for a, b in ((0, 4), (4, 5), (5, 11)):
        total = np.zeros(b - a)
        z = 0.0
        for states in itertools.product((0, 1), repeat=b - a):
            w = start[states[0]] * np.exp(lift[a:b] @ np.array(states))
            for i, j in zip(states, states[1:]):
                w *= move[i, j]
            z += w
            total += w * np.array(states)
        assert np.allclose(got[a:b], total / z)


@pytest.fixture(scope="module")
def toxicity(spark):
    return local(queries.op4_toxicity(spark, SF01))


def test_toxicity_on_held_out_rows(toxicity):
    labels = pd.read_parquet(f"{SF01}/labels.parquet")
    assert (toxicity.held_out == toxicity.doc_id.map(held(5, 0))).all() and toxicity.score.between(0, 1).all()
    found = toxicity[toxicity.held_out.astype(bool)].merge(labels, on="doc_id")
    assert (found.predicted == found.toxic).mean() > 0.95
    assert (toxicity.predicted == (toxicity.score >= 0.5)).all()


def test_toxic_spans_are_offsets(toxicity):
    text = pd.read_parquet(f"{SF01}/documents.parquet").set_index("doc_id").text
    found = [text[r.doc_id][s.start:s.end] for r in toxicity.itertuples() for s in r.spans]
    assert "idiot" in found and all(w == w.strip() and w for w in found)


def test_toxicity_of_odd_tables(spark):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 29)] + [(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for table, marks in ((odd.table(spark), labels), (odd.table(spark), labels.limit(0)), (odd.empty(spark), labels)):
        field = toxic_spans.fit(table, marks, F.lit(True))
        got = local(toxic_spans.tag(table, field))
        assert len(got) == table.count() and got.score.between(0, 1).all()
        assert (got[got.doc_id.isin([8, 9, 10, 27])].score == 0).all()


@pytest.mark.parametrize("bad", ["zq", "xiv", "坏人"])
def test_short_words_are_tied_to_toxicity(bad):
    pick = np.random.default_rng(5)
    documents = []
    for k in range(200):
        text = list(odd.words(int(pick.integers(10**6)), 30).split())
        if k % 2:
            text[int(pick.integers(30))] = bad
        documents.append((text, k % 2))
    field = toxic_spans.Field()
    field.fit(documents[:150], 60, 20.0, 20.0)
    field.calibrate(documents[150:])
    scores, spans = field.score([f"alpha1 beta2 {bad} gamma3", "alpha1 beta2 gamma3 delta4"])
    assert scores[0] >= 0.5 > scores[1] and not spans[1]
    assert [(s["start"], s["end"]) for s in spans[0]] == [(13, 13 + len(bad))]


def test_quality_on_held_out_rows(spark):
    labels = pd.read_parquet(f"{SF01}/labels.parquet")
    got = local(queries.op1_quality(spark, SF01))
    found = got[got.held_out.astype(bool)].merge(labels, on="doc_id")
    assert (found.kept == (found.quality == 1)).mean() > 0.95
    assert found[found.quality == 1].kept.all()
    assert (got.p_good >= got.p_best).all() and np.allclose(got.expected_grade.astype(float), (got.p_good + got.p_best).astype(float))


def test_quality_thresholds_are_ordered(spark):
    table = odd.table(spark)
    ratings = spark.createDataFrame([(i, (i * 7) % 5) for i in range(1, 29)] + [(3, None), (None, 2), (4, 0)], "doc_id long, grade int")
    model = quality.fit(table, ratings, grades=5, rounds=30)
    assert len(model[1]) == 4 and (np.diff(model[1]) > 0).all()
    got = local(quality.tail_probabilities(table, model, keep=["doc_id", "lang", "grade", "__text"]))
    assert len(got) == len(odd.rows()) and (got["__text"] == "t").all()
    assert all(0 <= b <= a <= 1 for tails in got["tails"] for a, b in itertools.pairwise(tails))
    empty = [t for i, t in zip(got.doc_id, got["tails"]) if i in (8, 9, 10)]
    assert empty[0] == empty[1] == empty[2]


def test_quality_without_ratings_keeps_all(spark):
    ratings = spark.createDataFrame([], "doc_id long, grade int")
    model = quality.fit(odd.table(spark), ratings, grades=3)
    assert quality.tail_probabilities(odd.table(spark), model).where(quality.selected()).count() == len(odd.rows())
    assert quality.tail_probabilities(odd.empty(spark), model).count() == 0


def test_gradient_of_the_ordinal_loss_lowers_it():
    """The fit separates grades that one feature orders."""
    import pyarrow as pa

    take, done = quality._fit(3, 4, 200, 0.01)
    rows = [(g, [g, 3]) for g in (0, 1, 2) for _ in range(20)]
    take({"grade": pa.array([g for g, _ in rows]), "slots": pa.array([s for _, s in rows]), "vals": pa.array([[1.0, 0.5]] * len(rows))})
    weights, cuts = done()
    z = [weights[g] + 0.5 * weights[3] for g in (0, 1, 2)]
    assert z[0] < cuts[0] < z[1] < cuts[1] < z[2]


def test_language_on_held_out_rows(spark):
    got = local(queries.op7_language(spark, SF01)).set_index("doc_id")
    docs = pd.read_parquet(f"{SF01}/documents.parquet").set_index("doc_id")
    assert (got.held_out == [held(4, 2)(i) for i in got.index]).all() and got.score.between(0, 1).all()
    there = got[got.held_out.astype(bool)].index
    assert (got.lang_pred[there] == docs.lang[there]).mean() > 0.98


def test_kernel_products_against_definition():
    marks, texts = ["abcab", "Bcd é", "zz"], ["abc", "cdcd", "", "zzz ab"]
    kernel = lang_kernel.Kernel(marks)
    alphabet = set("".join(marks).lower())
    grams = lambda t: {s[i:i + n] for s in ["".join(c if c in alphabet else "?" for c in t.lower())] for n in (1, 2, 3) for i in range(len(s) - n + 1)}
    want = [[len(grams(t) & grams(m)) / np.sqrt(max(1, len(grams(t))) * len(grams(m))) for m in marks] for t in texts]
    assert np.allclose(kernel.products(texts), want)


def test_language_of_odd_tables(spark):
    table = odd.table(spark)
    model = lang_kernel.fit(table, fold("doc_id", 4) != 2)
    got = local(lang_kernel.predict(table, model))
    assert len(got) == len(odd.rows())
    none = got[got.doc_id.isin([8, 9, 10, 27, 28])]
    assert (none.lang_pred == "und").all() and (none.score == 0).all()
    assert set(got.lang_pred) <= {"en", "und"}
    nothing = lang_kernel.fit(table.where("lang IS NULL"), F.lit(True))
    assert set(local(lang_kernel.predict(table, nothing)).lang_pred) == {"und"}
    assert local(lang_kernel.predict(odd.empty(spark), model)).empty


def test_language_learns_from_long_texts_only(spark):
    rows = [(i, " ".join(f"{w}{j % 7}" for j in range(6000)), lang) for i, (w, lang) in enumerate(
        [("uno dos", "es"), ("one two", "en"), ("eins zwei", "de")] * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = local(lang_kernel.predict(df, lang_kernel.fit(df, F.lit(True), landmark_grams=40)))
    assert dict(zip(got.doc_id, got.lang_pred)) == {i: lang for i, _, lang in rows}


def test_language_learns_a_rare_language(spark):
    common = spark.range(60_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the cat and the dog number "), F.col("id") % 97).alias("text"), F.lit("en").alias("lang"))
    rare = spark.createDataFrame([(70_000 + i, f"katten og hunden nummer {i}", "da") for i in range(4)], common.schema)
    model = lang_kernel.fit(common.union(rare), F.col("doc_id") != 70_003)
    got = local(lang_kernel.predict(rare, model))
    assert model.langs == ["da", "en"] and (got.lang_pred == "da").all()


def test_language_of_signs_that_are_no_letters(spark):
    table = spark.createDataFrame([(1, "²"), (2, "½ ①"), (3, "12 _"), (4, "ª"), (5, "ʰ"), (6, "漢")], "doc_id long, text string")
    model = lang_kernel.fit(table.withColumn("lang", F.lit("xx")), F.lit(True))
    got = local(lang_kernel.predict(table, model)).set_index("doc_id").lang_pred
    assert dict(got) == {1: "und", 2: "und", 3: "und", 4: "xx", 5: "xx", 6: "xx"}


def test_language_model_against_brute_force_ridge(spark):
    """Every row a landmark: the model is kernel ridge regression with an intercept, solved here in its dual form."""
    said = {"en": ["the cat sat", "a dog ran off", "this is it"], "de": ["die katze sitzt", "der hund rennt", "das ist es"], "fr": ["le chat dort", "un chien court"]}
    rows = [(i, t, lang) for i, (t, lang) in enumerate((t, lang) for lang, ts in said.items() for t in ts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_kernel.fit(df, F.lit(True))
    grams = lambda t: {t[i:i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    k = lambda a, b: len(grams(a) & grams(b)) / np.sqrt(len(grams(a)) * len(grams(b)))
    texts, langs = [r[1] for r in rows], sorted(said)
    gram = np.array([[k(a, b) for b in texts] for a in texts])
    target = np.array([[r[2] == x for x in langs] for r in rows], float)
    weight = np.array([len(rows) / len(langs) / len(said[r[2]]) for r in rows])
    # min sum w (y - Ka - b)^2 + a'Ka, by its normal equations in (a, b)
    left = np.vstack([np.hstack([weight[:, None] * gram + np.eye(len(rows)), weight[:, None]]), np.hstack([weight @ gram, [weight.sum()]])])
    right = np.vstack([weight[:, None] * target, weight @ target])
    solved = np.linalg.solve(left, right)
    want = gram @ solved[:-1] + solved[-1]
    seen = np.column_stack([model.kernel.products(texts), np.ones(len(rows))]) @ model.weights
    assert model.langs == langs and np.allclose(seen, want, atol=1e-3)
    found, scores = model.predict(texts)
    assert found == [langs[i] for i in want.argmax(axis=1)] and np.allclose(scores, want.max(axis=1).clip(0, 1), atol=1e-3)


def test_language_ties_go_to_the_first_language(spark):
    df = spark.createDataFrame([(1, "same text", "b"), (2, "same text", "a")], "doc_id long, text string, lang string")
    got = local(lang_kernel.predict(df, lang_kernel.fit(df, F.lit(True))))
    assert set(got.lang_pred) == {"a"}
