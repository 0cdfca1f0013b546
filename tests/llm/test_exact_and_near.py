import random
import re
from collections import defaultdict

import numpy as np
import odd
import pytest
from llm_helpers import SF, docs, local  # noqa: F401

from flipside.llm import exact_dedup, minhash, queries


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    return {key: (min((s, (i is None, i or 0)) for s, i in g), len(g)) for key, g in groups.items()}


def test_exact_against_brute_force(spark):
    rows = [r[:2] for r in odd.rows() if r[0] is not None]
    got = local(exact_dedup.exact_groups(odd.table(spark).where("doc_id IS NOT NULL")))
    want = brute_exact(rows)
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got.itertuples()}
    for i, t in rows:
        ((_, (_, keep)), size) = want[re.sub(r"[\x20\x09-\x0D]", "", t or "")]
        assert (by_id[i].keep_id, by_id[i].group_size, by_id[i].kept) == (keep, size, keep == i), i


def test_exact_with_null_ids(spark):
    """A null id comes after all others, and a group that only such rows lead stays a group."""
    by_text = defaultdict(list)
    for r in exact_dedup.exact_groups(odd.table(spark)).collect():
        by_text[r.text_sha256].append((r.doc_id, r.keep_id, r.group_size, r.kept))
    group = next(g for g in by_text.values() if (1, 1, 5, True) in g)
    assert sorted(group, key=str) == sorted([(i, 1, 5, i == 1) for i in (1, 2, 4, 5, None)], key=str)
    rows = [(None, "a b c"), (1, "abc"), (2, "ab c"), (None, "lone"), (None, "x y"), (None, "x y"), (3, "xy")]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=str) == sorted([
        (None, None, 3, True), (1, None, 3, False), (2, None, 3, False), (None, None, 1, True),
        (None, None, 3, True), (None, None, 3, True), (3, None, 3, False)], key=str)


def test_exact_odd_tables(spark):
    assert local(exact_dedup.exact_groups(odd.empty(spark))).empty
    assert len(local(exact_dedup.exact_groups(odd.table(spark)))) == len(odd.rows())


def test_chunks_are_content_defined(spark):
    """A change at the start leaves the later chunks as they were."""
    text = odd.words(5, 3000)
    frame = spark.createDataFrame([(1, text), (2, "new words " + text)], "doc_id long, text string")
    one, two = (r.chunks for r in exact_dedup.recipes(frame, "doc_id", "text", 64, 1024).orderBy("id").collect())
    assert len({c.sha for c in one} & {c.sha for c in two}) >= len(one) - 2
    assert sum(c.len for c in one) == len(re.sub(r"\s", "", text))


def test_equal_weak_hashes_do_not_merge(spark):
    """Identifiers hold the SHA-256, so chunks that agree in length and 64-bit hash alone stay apart."""
    frame = spark.createDataFrame([(1, "x" * 10), (2, "y" * 10), (3, "x " * 10)], "doc_id long, text string")
    got = {r.doc_id: r.keep_id for r in exact_dedup.exact_groups(frame).collect()}
    assert got == {1: 3, 2: 2, 3: 3}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_near(rows, percent=85):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    return {i: top(i) for i, _ in rows}, {i: len(s) for i, s in sets}


def near_family(seed, base_words, copies, edits, first_id):
    """A base and copies that are near it, less so one another."""
    pick = random.Random(seed)
    base = odd.words(seed, base_words).split()
    out = [(first_id, " ".join(base))]
    for k in range(copies):
        copy = list(base)
        for _ in range(edits):
            copy[pick.randrange(len(copy))] = f"edit{k}x{pick.randrange(1000)}"
        out.append((first_id + 1 + k, " ".join(copy)))
    return out


@pytest.mark.parametrize("make", [
    lambda: [r[:2] for r in odd.rows() if r[0] is not None],
    lambda: near_family(7, 200, 30, 2, 100) + near_family(8, 150, 25, 3, 200) + near_family(9, 100, 40, 4, 300)
    + [(50 + k, " ".join(odd.words(10, 200).split()[k * 3:])) for k in range(30)],  # a chain of neighbours
])
def test_near_against_brute_force(spark, make):
    rows = make()
    got = local(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    component, size = brute_near(rows)
    assert len(got) == len(rows)
    for r in got.itertuples():
        assert (r.component_id, r.n_shingles, r.kept) == (component[r.doc_id], size[r.doc_id], component[r.doc_id] == r.doc_id)


def test_near_odd_tables(spark):
    assert local(minhash.near_duplicates(odd.empty(spark))).empty
    assert len(local(minhash.near_duplicates(odd.table(spark)))) == len(odd.rows())


def test_near_query(spark, docs):
    got = local(queries.op6_minhash(spark, SF)).set_index("doc_id")
    component, size = brute_near(list(zip(docs.doc_id, docs.text)))
    assert got.component_id.to_dict() == component and got.n_shingles.to_dict() == size


def test_circulant_signatures_estimate_similarity():
    pick = np.random.default_rng(1)
    a = pick.integers(0, 2**63, 3000).astype(np.uint64)
    b = np.concatenate([a[:2400], pick.integers(0, 2**63, 600).astype(np.uint64)])
    one, two = minhash.signatures([np.unique(a), np.unique(b)], 512)
    assert abs((one == two).mean() - 2400 / 3600) < 0.08


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (105, 101), (103, 105), (7, 200)]
    got = {r.node: r.component for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 1 for k in [*range(1, 41), 200]} | {k: 100 for k in (100, 101, 103, 105)}
