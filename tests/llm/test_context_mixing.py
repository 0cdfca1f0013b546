import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import odd
import pyarrow as pa
from llm_helpers import SF, docs, local  # noqa: F401

from flipside.llm import context_mixing as cm, queries
from pyspark.sql import functions as F


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()) + [cm.TEXT_END]


def brute_base(rows):
    """[(id, held_out, n_tokens, n_known, train_tokens, base)]."""
    fold = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 != 0
    c = Counter(w for i, t in rows if fold(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    return [(i, len(words(t)), sum(c[w] > 0 for w in words(t)), n,
             sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t))) for i, t in rows]


def test_query_against_brute_force(spark, docs):
    got = local(queries.op11_context_mixing(spark, SF)).set_index("doc_id")
    want = brute_base(list(zip(docs.doc_id, docs.text)))
    assert len(got) == len(want)
    for i, n, known, train, base in want:
        r = got.loc[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, train, zlib.crc32(str(i).encode()) % 10 == 0)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score < 0 and r.bits_per_byte > 0
    assert got.score.sum() / (got.n_tokens.sum()) > -7  # a letter costs 8 bits without a model; this is about 4 of them


def naive_bits(mixer, texts):
    """Token after token, with posteriors: what the batch code must give."""
    out = []
    for tokens in texts:
        holds, bits = np.full(len(cm.SETS), 1 / len(cm.SETS)), 0.0
        for token in tokens:
            odds, gate, _ = mixer.inputs([token])
            each = np.array([np.prod([1 / (1 + math.exp(-float(x @ mixer.weights[g, :, m]))) for x, g in zip(odds, gate)])
                             for m in range(len(cm.SETS))])
            bits -= math.log2(holds @ each)
            holds = holds * each / (holds @ each)
        out.append(bits)
    return out


def trained(texts, cells=1 << 16):
    """A model fitted without Spark, by the operator's own steps."""
    counts = Counter(itertools.chain.from_iterable(texts))
    batch = pa.record_batch({"token": pa.array(list(counts), pa.binary()), "c": list(counts.values())})
    seen = Counter()
    schema = pa.schema([("context", pa.int64()), ("symbol", pa.int32()), ("n", pa.int64())])
    for part in cm._gather((1, 2, 4), schema, 5)(iter([batch])):
        for c, s, n in zip(part["context"].tolist(), part["symbol"].tolist(), part["n"].tolist()):
            seen[c, s] += n
    frequencies = np.zeros(256, np.int64)
    for w, n in counts.items():
        for b in w + (b"" if w == cm.TEXT_END else cm.WORD_END):
            frequencies[b] += n
    code = cm.Code(frequencies)
    by = {}
    for (c, s), n in seen.items():
        by.setdefault(c, []).append({"symbol": s, "n": n})
    lists = pa.array(list(by.values()), pa.list_(pa.struct([("symbol", pa.int32()), ("n", pa.int64())])))
    held = cm._cells(code, cells)({"context": pa.array(list(by)), "seen": lists})
    table = np.zeros(cells, np.uint16)
    for cell, _, h in sorted(zip(held["cell"].tolist(), held["n"].tolist(), held["held"].tolist()), key=lambda r: r[1:]):
        table[cell] = h
    return cm.Mixer(code, table, (1, 2, 4)), seen, frequencies


def test_batches_equal_bit_after_bit():
    texts = [words(odd.words(k, n)) for k, n in ((1, 60), (2, 3), (3, 25), (4, 0), (5, 8), (6, 16))] + [words(None), words("new ßtrange\x00 words")]
    mixer, _, _ = trained(texts[:4])
    distinct = list(dict.fromkeys(itertools.chain.from_iterable(texts)))
    numbers = {w: i for i, w in enumerate(distinct)}
    sequence = np.array([numbers[w] for t in texts for w in t], np.int32)
    got = cm.text_bits(mixer.costs(distinct, together=7), sequence, np.array([len(t) for t in texts]))
    assert np.allclose(got, naive_bits(mixer, texts), rtol=1e-4)


def test_probabilities_add_up():
    """Of all symbols after a context, whatever the table holds: a bit's two outcomes share 1."""
    mixer, _, _ = trained([words(odd.words(9, 200))])
    whole = 0.0
    for s in range(256):
        if s == cm.WORD_END[0]:
            continue  # no token is empty, but the code has a place for it
        token = cm.TEXT_END if s == cm.TEXT_END[0] else bytes([s])
        odds, gate, _ = mixer.inputs([token])
        sums = np.einsum("ij,ijm->im", odds, mixer.weights[gate])[:mixer.code.size[s]]
        whole += np.prod(1 / (1 + np.exp(-sums.astype(float))), axis=0)
    assert (whole > 0.9).all() and (whole <= 1 + 1e-6).all()


def test_counts_behind_the_cells():
    """Contexts and symbols as counted by hand, first order."""
    texts = [words("ab abc b"), words("ab")]
    _, seen, frequencies = trained(texts)
    assert frequencies[ord("b")] == 4 and frequencies[ord(" ")] == 4 and frequencies[10] == 2
    by_context = Counter()
    for (c, _), n in seen.items():
        by_context[c] += n
    assert sum(by_context.values()) == 3 * frequencies.sum()


def test_refining_chooses_a_set():
    """A text unlike the training texts isn't coded much worse than by its own best set."""
    mixer, _, _ = trained([words(odd.words(31, 2000))])
    costs = mixer.costs([w[::-1] for w in words(odd.words(30, 300))[:-1]])
    whole = cm.text_bits(costs, np.arange(len(costs)), np.array([len(costs)]))[0]
    assert costs.sum(axis=0).min() <= whole + 1e-3 <= costs.sum(axis=0).min() + 2.01


def test_shares_are_refined_after_every_token(monkeypatch):
    """Texts of many lengths, a few tokens fetched at a time: each token is paid by the shares that those before it
    left, also where a set that was far behind catches up."""
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 40, 25)
    lengths[7] = 700
    costs = rng.uniform(0, 12, (50, 4)).astype(np.float32)
    sequence = rng.integers(0, 50, lengths.sum())
    costs[0], costs[1] = (0.1, 8, 8, 8), (8, 0.1, 8, 8)
    at = lengths[:7].sum()
    sequence[at:at + 300], sequence[at + 300:at + 700] = 0, 1
    taken = []
    monkeypatch.setattr(cm.np, "log2", lambda x, f=np.log2: taken.append(np.shape(x)) or f(x))
    got = cm.text_bits(costs, sequence, lengths, together=64)
    monkeypatch.undo()
    assert len(taken) >= 700   # a step for each token of the longest text
    for i, start in enumerate(np.cumsum(lengths) - lengths):
        holds, bits = np.full(4, -2.0), 0.0   # logarithms of the shares
        for c in costs[sequence[start:start + lengths[i]]].astype(float):
            all_of = np.logaddexp2.reduce(holds - c)
            bits, holds = bits - all_of, holds - c - all_of
        assert abs(got[i] - bits) < 1e-6 * max(1, bits)


def test_odd_tables(spark):
    train = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10) != 0
    assert local(cm.score_texts(odd.empty(spark), train)).empty
    got = cm.score_texts(odd.table(spark), train).collect()
    want = brute_base([r[:2] for r in odd.rows()])
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in got), key=key) == sorted((w[:4] for w in want), key=key)
    assert np.allclose(sorted(r.base_score for r in got), sorted(w[4] for w in want))
    none = cm.score_texts(odd.table(spark), F.lit(False)).collect()
    assert len(none) == len(odd.rows()) and all(r.train_tokens == 0 and r.n_known == 0 and np.isfinite(r.score) for r in none)


def test_equal_texts_score_equally(spark):
    rows = [(k, odd.words(40, 300)) for k in range(20)] + [(100 + k, odd.words(50 + k, 30)) for k in range(50)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = cm.score_texts(frame, F.col("doc_id") % 10 != 0, block_bytes=5000).collect()
    assert len({round(r.score, 6) for r in got if r.doc_id < 20}) == 1


def naive_refined(mixer, text, moving=True):
    """Token after token with weights that move, bit after bit within a token."""
    weights, holds, bits = mixer.weights.astype(float), np.full(len(cm.SETS), 1 / len(cm.SETS)), 0.0
    for token in text:
        odds, gate, _ = mixer.inputs([token])
        each, slope = np.ones(len(cm.SETS)), np.zeros_like(weights)
        for x, g in zip(odds.astype(float), gate):
            p = 1 / (1 + np.exp(-np.clip(x @ weights[g], -30, 15)))
            each *= p
            slope[g] += x[:, None] * (1 - p)
        bits -= math.log2(holds @ each)
        holds = holds * each / (holds @ each)
        if moving:
            weights += np.clip(cm.RATE * slope, -cm.MOST, cm.MOST)
    return bits


def refined_bits(mixer, texts, **sizes):
    distinct = list(dict.fromkeys(itertools.chain.from_iterable(texts)))
    numbers = {w: i for i, w in enumerate(distinct)}
    sequence = np.array([numbers[w] for t in texts for w in t], np.int32)
    return cm.text_bits(cm.Refined(mixer, distinct, 50), sequence, np.array([len(t) for t in texts]), **sizes)


def test_weights_are_refined_after_every_token():
    """Each set's weights of the gates that a token met move with the gradient of its cost, text by text."""
    texts = [words(odd.words(k, n)) for k, n in ((1, 60), (2, 3), (3, 250), (4, 0), (5, 8), (6, 16))]
    texts += [words(None), words("new ßtrange\x00 words"), [w[::-1] for w in words(odd.words(30, 300))]]
    mixer, _, _ = trained(texts[:4])
    want = [naive_refined(mixer, t) for t in texts]
    assert np.allclose(refined_bits(mixer, texts), want, rtol=1e-4)
    assert np.allclose(refined_bits(mixer, texts, side=2), want, rtol=1e-4)
    fixed = [naive_refined(mixer, t, moving=False) for t in texts]
    assert np.allclose(fixed, naive_bits(mixer, texts), rtol=1e-4)
    assert max(abs(a - b) for a, b in zip(want, fixed)) > 1   # it isn't what fixed weights give


def test_refined_by_more_orders_and_long_tokens():
    """More predictors than fit in 32 bits; a token whose probability is below what a float holds."""
    texts = [words(odd.words(1, 80)) + [b"zq\xff" * 300, b"zq"]] * 2
    mixer, _, _ = trained([words(odd.words(1, 80))])
    mixer = cm.Mixer(mixer.code, mixer.table, (1, 2, 4, 5))
    want = [naive_refined(mixer, t[:-3] + t[-1:]) for t in texts]
    assert np.allclose(refined_bits(mixer, [t[:-3] + t[-1:] for t in texts]), want, rtol=1e-4)
    assert np.isfinite(refined_bits(mixer, texts)).all() and (refined_bits(mixer, texts) > want[0] + 2000).all()
    held = cm.Refined(mixer, texts[0])
    held.begin(3)
    whole = held.step(np.array([0, 1, 2]))
    held.begin(3)
    assert np.allclose(held.step(np.array([0, 1, 2]), together=1), whole, rtol=1e-5)


def test_query_moves_its_weights(spark, monkeypatch):
    """The operator's scores are those of the plain version, and not those of weights that stay."""
    rows = [(k, odd.words(60 + k, 40)) for k in range(30)] + [(100, " ".join(w[::-1] for w in odd.words(1, 400).split()))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = []
    monkeypatch.setattr(cm, "fit", lambda *a, f=cm.fit: kept.append(f(*a)) or kept[0])
    got = {r.doc_id: r.score for r in cm.score_texts(frame, F.col("doc_id") < 100, cells=1 << 16).collect()}
    want = {k: naive_refined(kept[0], words(t)) * -math.log10(2) for k, t in rows}
    assert all(abs(got[k] - want[k]) < 1e-3 * abs(want[k]) for k in got)
    assert abs(naive_refined(kept[0], words(rows[-1][1]), moving=False) * -math.log10(2) - got[100]) > 1


def test_texts_of_a_block_are_one_value(spark):
    """Whatever a block holds, its row beside those of the counts has no lists of numbers for the JVM, and small blocks
    give what large ones do."""
    rows = [(k, odd.words(70 + k % 9, 60)) for k in range(60)] + [(None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    train = F.coalesce(F.col("doc_id") < 50, F.lit(False))
    small, large = (cm.score_texts(frame, train, cells=1 << 16, block_bytes=b) for b in (500, 1 << 20))
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "ids#" not in plan and "sequence#" not in plan
    key = lambda r: (r.doc_id is None, r.doc_id or 0)
    a, b = (sorted(x.collect(), key=key) for x in (small, large))
    assert [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in a] == [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in b]
    assert np.allclose([r.score for r in a], [r.score for r in b], rtol=1e-6)
