import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import odd
import pytest
from hypothesis import given, settings, strategies as st
from llm_helpers import SF, docs, local  # noqa: F401

from flipside.llm import lexical_search, queries, spelling

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_search(rows, items, k=20):
    """{item number: [(id, score)]}."""
    texts = [(i, Counter(TERM.findall(lower(t)))) for i, t in rows]
    n_docs = sum(1 for _, c in texts if c)
    total = sum(sum(c.values()) for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    out = {}
    for number, (_, text) in enumerate(items):
        scored = []
        for i, c in texts:
            if not c:
                continue
            m = 75 + 25 * sum(c.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                    for t in TERM.findall(lower(text)) if c[t])
            if s > 0:
                scored.append((i, s))
        out[number] = sorted(scored, key=lambda r: (-r[1], r[0] is None, r[0] or 0))[:k]
    return out


def collected(df):
    found = {}
    for r in sorted(df.collect(), key=lambda r: (r.item_id is None, r.item_id or 0, r.rank)):
        found.setdefault(r.item_id, []).append((r.doc_id, r.score, r.rank))
    return found


def test_search_query(spark, docs):
    import pandas as pd

    items = pd.read_parquet(f"{SF}/benchmark.parquet")
    got = collected(queries.op13_lexical_search(spark, SF))
    want = brute_search(list(zip(docs.doc_id, docs.text)), list(zip(items.item_id, items.text)))
    assert {i: [(d, s) for d, s, _ in rows] for i, rows in got.items()} == {items.item_id[n]: rows for n, rows in want.items() if rows}
    assert all([r for _, _, r in rows] == list(range(1, len(rows) + 1)) for rows in got.values())


def test_search_in_query_blocks_and_with_few_results(spark, docs):
    """Blocks of queries, small k (so that bounds cut), repeated terms, ties between copies."""
    rows = list(zip(docs.doc_id.tolist(), docs.text)) + [(10_000 + k, docs.text[3]) for k in range(30)]
    items = [(k, " ".join(t.split()[:40] + t.split()[:3])) for k, t in enumerate(docs.text[:40])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = collected(lexical_search.search(frame, asked, k=3, query_bytes=2000))
    want = brute_search(rows, items, k=3)
    assert {i: [(d, s) for d, s, _ in r] for i, r in got.items()} == want


def test_search_odd_tables(spark):
    items = spark.createDataFrame([(1, "alpha beta1 gamma7"), (2, None), (3, ""), (4, "nowhereword"), (None, "One two three"), (1, "one")],
                                  "item_id long, text string")
    rows = [r[:2] for r in odd.rows()]
    got = lexical_search.search(odd.table(spark), items).collect()
    want = brute_search(rows, [(1, "alpha beta1 gamma7"), (None, "One two three"), (1, "one")])
    assert sorted((r.doc_id is None, r.doc_id or 0, r.score) for r in got) == sorted(
        (i is None, i or 0, s) for found in want.values() for i, s in found)
    assert lexical_search.search(odd.empty(spark), items).collect() == []
    assert lexical_search.search(odd.table(spark), items.where("item_id > 9")).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 2000))
def test_bounds_lose_no_candidate(seed, least):
    """All documents that reach ``least`` come with their exact scores."""
    pick = np.random.default_rng(seed)
    n, terms = 40, 7
    rows, lengths, tf = [], [], []
    for _ in range(terms):
        here = np.sort(pick.choice(n, pick.integers(1, n), replace=False))
        rows.append(here)
        lengths.append(len(here))
        tf.append(pick.integers(1, 5, len(here)))
    block = lexical_search.Block(n, [10] * n, np.arange(terms), np.array(lengths), np.concatenate(rows), np.concatenate(tf), n, 10 * n)
    weights = pick.integers(0, 9, terms)
    units = [(t, int(pick.integers(1, 3))) for t in range(terms)]
    exact = np.zeros(n, np.int64)
    for t, q in units:
        exact[rows[t]] += block.lists[t][1] * weights[t] * q
    least = int(exact.max() * least / 2000)
    places, scores = lexical_search.candidates(block, lexical_search.dealt_pairs(units, weights), weights, max(1, least))
    assert dict(zip(places.tolist(), scores.tolist())) == {i: s for i, s in enumerate(exact.tolist()) if s >= max(1, least)}


def test_pair_bounds_are_tighter_than_sums():
    """Where no document has two terms, a pair adds what one of them adds."""
    block = lexical_search.Block(4, [10] * 4, np.arange(2), np.array([2, 2]), np.array([0, 1, 2, 3]), np.array([1, 3, 1, 1]), 4, 40)
    weights = np.array([5, 5])
    one, other = block.unit((0, 1), weights)[2], block.unit((1, 1), weights)[2]
    assert block.pair((0, 1), (1, 1), weights) == max(one, other) < one + other


def brute_words(rows, least=6, occurrences=5, noise=199):
    total = Counter()
    for i, text in rows:
        for run in re.findall("[a-zÀ-ÿ]+", lower(text)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % noise == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= least and n >= occurrences}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    front = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[front + (len(a) >= len(b)):] == b[front + (len(b) >= len(a)):]


def brute_variants(words, ratio=5):
    near = {w: [] for w in words}
    for a in words:
        for b in words:
            if a < b and one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words.get(form[w]))
    return out


def spelled(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def family(seed, n_words, occurrences=lambda k: 5):
    """Texts full of words an edit or two from one another."""
    pick = random.Random(seed)
    base = ["".join(pick.choice("abé") for _ in range(pick.randint(6, 14))) for _ in range(n_words // 10)]
    out = set(base)
    while len(out) < n_words:
        w = list(pick.choice(sorted(out)))
        at, how = pick.randrange(len(w)), pick.randrange(3)
        w[at:at + (how != 0)] = [pick.choice("abéz")] if how < 2 else []
        if len(w) >= 6:
            out.add("".join(w))
    return [(k, " ".join([w] * occurrences(k))) for k, w in enumerate(sorted(out))]


def test_variants_query(spark, docs):
    words = brute_words(zip(docs.doc_id, docs.text))
    assert spelled(queries.op12_spelling_variants(spark, SF)) == brute_variants(words)


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_against_brute_force(spark, seed):
    pick = random.Random(seed)
    rows = family(seed, 400, lambda k: 5 * 5 ** pick.randrange(5))
    words = brute_words(rows, noise=10**12)
    got = spelled(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), noise=0))
    assert got == brute_variants(words)
    assert any(root not in (w, form) for w, (form, root, *_) in got.items())


@pytest.mark.parametrize("floor", [1, 8, 1000])
def test_gram_lists_hold_all_near_pairs(spark, floor):
    """At any pruning of the dictionary."""
    words = [t.split()[0] for _, t in family(7, 300)]
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    got = {(r.a, r.b) for r in spelling.near_pairs(frame, most=10**9 if floor == 1 else 100, floor=floor).collect()}
    assert {tuple(sorted(p)) for p in got} == {(a, b) for a in words for b in words if a < b and one_edit(a, b)}
    assert len({tuple(sorted(p)) for p in got}) == len(got)


def test_affected_bounds():
    dictionary = spelling.GramDictionary({"ab": 50, "abc": 20}, 8)
    assert dictionary.decompose("abcdabcd", 4)[0] == (0, 4) and dictionary.decompose("abcdabcd", 2)[0] == (0, 2)
    assert spelling.affected([(0, 3), (3, 5)]) == 1 and spelling.affected([(0, 3), (2, 5), (1, 4)]) == 3
    for word in ("abcdabcd", "xyzxyz", "ababab"):
        (a, b), (c, d) = sorted(dictionary.lists(word))
        assert b <= c and d <= len(word) + 1


def test_variants_odd_tables(spark):
    assert spelling.variants(odd.empty(spark)).collect() == []
    rows = [r[:2] for r in odd.rows()]
    words = brute_words(rows)
    assert spelled(spelling.variants(odd.table(spark))) == brute_variants(words)


def test_no_table_of_words_is_broadcast(spark, monkeypatch):
    """However small Spark takes a table for: lists of keys are many times the words that they are made from."""
    plans = []
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(spelling, "stored", lambda df, label, f=spelling.stored: plans.append(plan(df)) or f(df, label))
    rows = family(3, 200, lambda k: 5 if k % 7 else 30)
    got = spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), noise=0)
    assert spelled(got) == brute_variants(brute_words(rows, noise=10**12))
    plans.append(plan(got))
    assert sum("SortMergeJoin" in p for p in plans) >= 4 and not any("BroadcastHashJoin" in p or "BroadcastExchange" in p for p in plans)
