import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from flipside.functions.editdist import bounded_levenshtein, levenshtein_similarity, ratcliff_similarity
from flipside.functions.sampling import take_smallest
from flipside.functions.keys import hash_rank_key


def naive(a, b):
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i] + [0] * len(b)
        for j, cb in enumerate(b, 1):
            cur[j] = min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb))
        prev = cur
    return prev[-1]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcé ", max_size=14), st.text(alphabet="abcé ", max_size=14))
def test_bounded_levenshtein_is_exact(a, b):
    d = naive(a, b)
    assert bounded_levenshtein(a, b, 40) == d
    if d > 0:
        assert bounded_levenshtein(a, b, d - 1) is None


def test_long_near_copy_fast():
    random.seed(3)
    a = "".join(random.choice("abcdefgh ") for _ in range(50000))
    b = a[:20000] + "XY" + a[20002:40000] + "Z" + a[40000:]
    assert bounded_levenshtein(a, b, 100) == 3


def test_edit_similarity_spark_matches_python(spark):
    rows = [("tide", "diet"), ("diet", "tide"), ("kitten", "sitting"), ("", ""), ("same", "same")]
    df = spark.createDataFrame(rows, "a string, b string")
    out = df.select(levenshtein_similarity(F.col("a"), F.col("b")).alias("s"),
                    ratcliff_similarity(F.col("a"), F.col("b")).alias("r")).collect()
    assert [round(r.s, 4) for r in out] == [0.25, 0.25, round(1 - 3 / 7, 4), 1.0, 1.0]
    # ratcliff is asymmetric (reference behaviour)
    assert round(out[0].r, 2) == 0.25 and round(out[1].r, 2) == 0.5


def test_take_smallest_equals_global_rank(spark):
    from pyspark.sql import Window
    df = spark.range(0, 5000).withColumn("g", (F.col("id") % 3).cast("int"))
    key = hash_rank_key(7, "id")
    for by, n in [((), 1234), (("g",), 100)]:
        got = {r.id for r in take_smallest(df, key, n, by=by).select("id").collect()}
        w = Window.partitionBy(*by).orderBy(key, "id") if by else Window.orderBy(key, "id")
        exp = {r.id for r in df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).select("id").collect()}
        assert got == exp


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abcé ", max_size=70), st.text(alphabet="abcé ", max_size=70))
def test_bitparallel_levenshtein_is_exact(a, b):
    from flipside.functions.editdist import bitparallel_levenshtein
    assert bitparallel_levenshtein(a, b) == naive(a, b)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcé ", max_size=30), st.text(alphabet="abcé ", max_size=12), st.text(alphabet="abcé ", max_size=12), st.text(alphabet="abcé ", max_size=30))
def test_levenshtein_without_common_ends_is_exact(start, x, y, end):
    from flipside.functions.editdist import core, levenshtein
    a, b = start + x + end, start + y + end
    assert levenshtein(a, b) == naive(a, b)
    p, q = core(a, b)
    assert not (p and q) or (p[0] != q[0] and p[-1] != q[-1])


def test_added_clause_needs_no_search(monkeypatch):
    from flipside.functions import editdist
    monkeypatch.setattr(editdist, "bounded_levenshtein", None)
    monkeypatch.setattr(editdist, "bitparallel_levenshtein", None)
    text = "some words " * 5000
    assert editdist.levenshtein(text, text + "and a clause") == 12
    assert editdist.levenshtein(text + "x" + text, text + text) == 1


def test_token_diff_equals_the_sets(spark):
    """Few and many changed tokens; the cosine is that of the whole sets."""
    from flipside.functions.text import set_cosine, token_set
    from flipside.operators import score as SC
    many = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200))
    rows = [("a b c a", "a b d a"), ("a b", "a b c d"), ("", "a"), ("", ""), ("a a a", "a"), ("b a", "a b"), (many, "x " + many),
            (many, many + " tail"), ("A-b'c d", "a b'c e"), (None, "a")]
    df = spark.createDataFrame(rows, "a string, b string")
    out = df.select("a", SC.token_diff(F.col("a"), F.col("b"))["semantic"].alias("s"), SC.semantic_score(F.col("a"), F.col("b")).alias("t"),
                    set_cosine(token_set(F.col("a")), token_set(F.col("b"))).alias("want")).collect()
    assert all(r.s == r.want == r.t for r in out), out


def test_equal_rewrites_are_made_one_row(spark):
    """Distinct rewrites with all their turns; opened, they are the candidates of each (round, ordinal)."""
    from flipside.operators import generate as E
    lexicon = spark.createDataFrame([(t, o, s, d) for o, (x, y) in enumerate([("bad", "fine"), ("ugly", "nice"), ("dull", "keen")], 1)
                                     for t, s, d in ((0, x, y), (1, y, x))], "target_label int, ordinal int, src string, dst string")
    samples = spark.createDataFrame([(1, "no cue here", 1), (2, "bad and Ugly", 1), (3, "nice keen fine", 0)], "id long, text string, label int")
    few = E.distinct_candidates(samples, lexicon, 4, 7, 3, 1)
    assert {r.id: len(r.turns) for r in few.collect() if r.id == 1} == {1: 12}
    assert few.groupBy("id", "cand_text").count().where("count > 1").count() == 0 and few.where("id = 2").count() == 3
    every = E.lexicon_candidates(samples, lexicon, 4, 7, 3, 1)
    keys = samples.withColumn("target_label", 1 - F.col("label")).crossJoin(spark.range(1, 4).select(F.col("id").cast("int").alias("round"))).crossJoin(
        spark.range(1, 5).select(F.col("id").cast("int").alias("ordinal")))
    plain = E.with_candidate_text(keys, lexicon, 7, 1)
    cols = ["id", "round", "ordinal", "target_label", "cand_text"]
    assert sorted(map(tuple, every.select(*cols).collect())) == sorted(map(tuple, plain.select(*cols).collect()))
    assert {r.candidate_id for r in every.collect()} == {"c1", "c2", "c3", "c4"}


def test_distances_of_many_pairs_equal_one_at_a_time():
    """Searched together, with short and long texts, nulls and pairs over the budget in one batch."""
    import random

    from flipside.functions import editdist as ed
    pick = random.Random(5)
    words = ["fool", "nice", "a", "the", "é", "世界", "\U0001f600", "abab"]
    pairs = [(None, "a"), ("a", None), ("", ""), ("", "ab"), ("ab" * 300, "ba" * 300), ("x" * 3000, "y" * 10), ("same", "same")]
    for _ in range(400):
        a = " ".join(pick.choice(words) for _ in range(pick.choice((1, 5, 60))))
        b = a.replace(pick.choice(words), pick.choice(words)).replace(pick.choice(words), "w")
        pairs.append((a, b))
    want = [None if x is None or y is None else ed.bitparallel_levenshtein(x, y) for x, y in pairs]
    assert ed.distances(iter(pairs)) == want


def test_rewrites_of_several_sets_meet(spark):
    """Runs with equal lexicons make the same rewrites: one row, whose turns name all runs."""
    from flipside.operators import generate as E
    samples = spark.createDataFrame([(1, "bad and Ugly", 0), (2, "no cue", 0)], "id long, text string, target_label int")
    sets = _sets([(0, "7", [("bad", "fine"), ("ugly", "nice")]), (1, "8", [("bad", "fine"), ("ugly", "nice")])])
    got = E.rewrites_of_sets(samples, sets, 2, 2, 2).collect()
    assert sorted((r.id, r.cand_text) for r in got) == [(1, "fine and Nice"), (2, "no cue but it reads calmer overall.")]
    assert all({(t.run, t.round, t.ordinal) for t in r.turns} == {(i, j, k) for i in (0, 1) for j in (1, 2) for k in (1, 2)} for r in got)


def _sets(sets):
    from pyspark.sql import functions as F
    pair = lambda i, p: F.struct(F.lit(i).alias("ordinal"), F.lit(p[0]).alias("src"), F.lit(p[1]).alias("dst"))
    return F.array(*[F.struct(F.lit(run).alias("run"), F.lit(seed).alias("seed"), F.array(*[pair(i, p) for i, p in enumerate(pairs)]).alias("pairs"))
                     for run, seed, pairs in sets])


def test_heavy_work_is_spread(spark):
    """A table of one file split is dealt over several tasks for each core, and stays so when partitions are coalesced."""
    from flipside.functions.sampling import spread
    out = spread(spark.range(100).coalesce(1), "id")
    assert out.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_token_changes_equal_token_diff(spark):
    """The counting pass gives the cosine of ``token_diff`` and changes with the same sums by token."""
    from pyspark.sql import functions as F

    from flipside.operators import score as SC
    rows = [("a b c a", "a b d a"), ("a b", "a b c d"), ("", "a"), ("", ""), ("a a a", "a"), ("b a", "a b"), ("A-b'c d", "a b'c e"), (None, "a"), ("K k", "k")]
    for r in spark.createDataFrame(rows, "a string, b string").select(
            SC.token_diff(F.col("a"), F.col("b")).alias("x"), SC.token_changes(F.col("a"), F.col("b")).alias("y")).collect():
        sums = [{t: sum(c.d for c in z.changed or [] if c.token == t) for t in {c.token for c in z.changed or []}} for z in (r.x, r.y)]
        assert r.x.semantic == r.y.semantic and {t: d for t, d in sums[0].items() if d} == sums[1], r


def _made(spark, texts, sets, n, rounds, k, preserve):
    from pyspark.sql import functions as F

    from flipside.operators import rewrites as R
    samples = spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(texts)], "id long, text string, target_label int")
    return R.scored_of_sets(samples, _sets(sets), n, rounds, k, [F.array(*[F.lit(x) for x in items]) for items in preserve])


def test_scored_rewrites_equal_the_scores_of_their_texts(spark):
    """What comes back without texts equals the expressions on both texts, rewrite by rewrite and turn by turn."""
    from pyspark.sql import functions as F

    from flipside.functions.editdist import edit_similarity
    from flipside.operators import generate as E
    from flipside.operators import score as SC
    texts = ["bad day, a Bad dog and a baddish cat", "no cue", "sad bad sad topic", "", "K bad\nbad  x", "Sad"]
    sets = [(0, "7", [("bad", "fine"), ("sad", "bad"), ("dog", "cat")]), (3, "8", [("bad", "fine"), ("zzz", "y")])]
    preserve = [["core x", "Event y"], ["topic"], []]
    made = _made(spark, texts, sets, 3, 2, 2, preserve)
    got = made.select("id", F.explode("_made").alias("m")).select("id", F.explode("m.turns").alias("t"), "m.changed", "m.ss", "m.ms", "m.cs")
    got = {(r.id, r.t.run, r.t.round, r.t.ordinal): (r.ss, r.ms, r.cs, {c.token: c.d for c in r.changed}) for r in got.collect()}
    whole = E.rewrites_of_sets(made.select("id", "text", "target_label"), _sets(sets), 3, 2, 2)
    both = F.col("text"), F.col("cand_text")
    cs = F.array(*[SC.consistency_score(*both, F.array(*[F.lit(x) for x in items])) for items in preserve])
    whole = whole.withColumn("d", SC.token_diff(*both)).withColumn("ms", edit_similarity(*both)).withColumn("cs", cs)
    whole = whole.withColumn("t", F.explode("turns")).collect()
    assert len(whole) == len(got) == len(texts) * 2 * 3 * 2
    for r in whole:
        sums = {t: sum(c.d for c in r.d.changed if c.token == t) for t in {c.token for c in r.d.changed}}
        assert got[r.id, r.t.run, r.t.round, r.t.ordinal] == (r.d.semantic, r.ms, r.cs, {t: d for t, d in sums.items() if d}), r


def test_swaps_are_made_once_a_text(spark):
    """A swap of a text is made once for all turns and sets, and keys are worked out only where a pair changes the text."""
    from flipside.operators import generate as E
    made = []

    class Text(str):
        def replace(self, old, new):
            made.append((str(self), old))
            return self if old not in self else Text(str.replace(self, old, new))

    pairs = [{"src": w, "dst": f"{w}x"} for w in ("alpha", "beta", "gamma", "delta", "rho")]
    sets = [{"run": i, "seed": str(i), "pairs": pairs} for i in range(6)]
    found = E.turns_by_text("1", Text("alpha and beta"), sets, 5, 4, 4)
    assert sum(len(f[3]) for f in found) == 6 * 5 * 4
    assert len(made) == len(set(made)) <= 10 * len({t for t, _ in made})   # by turns and sets: 960
    assert len(E.turns_by_text("2", "none of them", sets, 5, 4, 4)) == 1


def test_label_logits_of_made_rewrites(spark):
    """Scores from tokens and changes equal those of the rewrites' texts; repeated and missing ids as by a join."""
    from pyspark.sql import functions as F

    from flipside.operators import score as SC
    kind = ("id long, label int, _own array<struct<token: string, tf: int>>, _made array<struct<turns: array<struct<run: int, round: int, ordinal: int>>,"
            "changed: array<struct<token: string, d: int>>, ss: double, ms: double, cs: array<double>>>")
    rewrite = lambda o, changed: ([(0, 1, o)], changed, 0.5, 0.25, [1.0])
    rows = [(1, 0, [("a", 2), ("b", 1)], [rewrite(1, [("a", -1), ("c", 1)]), rewrite(2, [("zz", 3)])]), (2, 1, [], [rewrite(1, [])]),
            (3, 1, [("a", 1)], []), (None, 1, [("a", 5)], [rewrite(1, [("c", 1)])])]
    weights = spark.createDataFrame([("a", 1.0), ("b", 10.0), ("c", 100.0)], "token string, w double")
    got = SC.label_logits(None, spark.createDataFrame(rows, kind), weights, ["id"])
    assert {(r.id, r.turns[0].ordinal): (r.logit, r.label, r._ss, r._ms, r._cs) for r in got.collect()} == {
        (1, 1): (111.0, 0, 0.5, 0.25, 1.0), (1, 2): (12.0, 0, 0.5, 0.25, 1.0), (2, 1): (0.0, 1, 0.5, 0.25, 1.0), (None, 1): (0.0, 1, 0.5, 0.25, 1.0)}
    twice = spark.createDataFrame([rows[0], rows[0]], kind)
    assert SC.label_logits(None, twice, weights, ["id"]).count() == 4


def test_listed_arrays_are_worked_out_once(spark):
    """The filter before an explode doesn't name the expression again."""
    from pyspark.sql import functions as F

    from flipside.functions.text import listed, tokens
    df = spark.createDataFrame([("a b",), ("",), (None,)], "text string")
    out = listed(df, "_t", tokens(F.col("text"))).select(F.explode("_t").alias("token"))
    assert sorted(r.token for r in out.collect()) == ["a", "b"]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    plain = df.withColumn("_t", tokens(F.col("text"))).select(F.explode("_t").alias("token"))
    assert plain._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") > 1   # else ``listed`` has no use
