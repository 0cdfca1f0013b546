"""The experiment grid as grouped jobs (J1-J4, I4, I6, and the input of J5-J12).

Ratios, seeds, presets, methods and ablation variants are columns. A *run* is a training sample (ratio, seed), a
*config* a method or variant under a preset's parameters; both lists are literal and short. Nothing loops over
them, so the number of Spark jobs is the same for one run and for a hundred:

* a sample is read once and carries the list of runs that it is in;
* token statistics are summed by (token, label, list of runs) before the list is opened, so a text is split once,
  and give every run's lexicon and label scorer;
* rewrites depend on (seed, run's lexicon, id, round, ordinal) only: presets and variants use subsets of the same
  rewrites, and runs often make equal ones, so each different text of a sample is scored once, and what differs between configs (gate, selection, rounds) is decided on
  slim score rows;
* the models of all (config, run) are one table of tokens with the weights of many models side by side, and all
  predictions one grouped sum.

Tables that several steps read are written once to the checkpoint folder.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.keys import hash_rank_key
from ..functions.sampling import spread, take_smallest, take_smallest_each
from ..functions.text import listed, tokens
from ..operators import planning as C
from ..operators import sampling as S
from ..operators.evaluate import classification_metrics
from ..operators.generate import rewritten, synonyms_replaced
from ..operators.rewrites import scored_of_sets
from ..params import DEFAULT, LADDER, METHODS, MULTI_STAGE, VARIANTS, Params, variant_params
from ..sources.stages import written

#: What the configs' preserve lists are called in the score table.
PRESERVE_LISTS = {"plan": C.PRESERVE, "default": C.DEFAULT_PRESERVE, "single": C.SINGLE_PRESERVE}


@dataclass(frozen=True)
class Config:
    """One way to choose augmented rows from the scored rewrites."""

    name: str
    preset: str
    how: str                 # none, synonym, first_pass, filtered, shot or rounds
    params: Params
    preserve: str = "plan"


def method_configs(presets: dict[str, Params], methods=METHODS) -> list[Config]:
    """The five methods under each preset."""
    how = {"none": "none", "synonym": "synonym", "single": "first_pass", "single_filtered": "filtered", "multi_stage": "rounds"}
    return [Config(m, name, how[m], p, "single" if m.startswith("single") else "plan") for name, p in presets.items() for m in methods]


def variant_configs(preset: str, p: Params, variants=VARIANTS) -> list[Config]:
    """The six ablations of one preset."""
    return [Config(v, preset, "shot" if v == "single_agent" else "rounds", variant_params(p, v),
                   {"single_agent": "single", "no_planner": "default"}.get(v, "plan")) for v in variants]


def run_list(ratios, seeds) -> list[tuple[float, int]]:
    return [(float(r), int(s)) for r in ratios for s in seeds]


def ratio_name(ratio: float) -> str:
    return f"{int(round(ratio * 100))}pct"


def samples_of_runs(train: DataFrame, runs: list[tuple[float, int]], base: int = 0) -> DataFrame:
    """id, text, label, runs: the numbers of the runs whose training sample holds the row (P5 for every seed at once)."""
    seeds, ratios = sorted({s for _, s in runs}), sorted({r for r, _ in runs})
    slim = train.select("id").withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))

    def size(total: Column) -> Column:
        b = F.lit(base) if base > 0 else total
        return F.least(total, F.greatest(F.lit(1), F.floor(b * F.col("ratio"))))
    members = take_smallest_each(slim, hash_rank_key(F.col("seed"), "id"), "ratio", ratios, size, by=["seed"])
    number = F.coalesce(*[F.when((F.col("ratio") == r) & (F.col("seed") == s), i) for i, (r, s) in enumerate(runs)])
    members = members.withColumn("run", number).where("run IS NOT NULL").groupBy("id").agg(F.array_sort(F.collect_list("run")).alias("runs"))
    return train.select("id", "text", "label").join(members, "id")


def token_stats(rows: DataFrame) -> DataFrame:
    """run, token, c1, c0 (occurrences by label), df1, df0 (rows by label) of rows (text, label, runs)."""
    words = tokens(F.col("text"))
    mark = lambda c, df: lambda t: F.struct(t.alias("token"), F.lit(c).alias("c"), F.lit(df).alias("df"))
    marked = F.concat(F.transform(words, mark(1, 0)), F.transform(F.array_distinct(words), mark(0, 1)))
    each = rows.select("label", "runs", F.explode(marked).alias("t")).groupBy("t.token", "label", "runs").agg(
        F.sum("t.c").alias("c"), F.sum("t.df").alias("df"))
    of = lambda c, label: F.sum(F.when(F.col("label") == label, F.col(c)).otherwise(0)).cast("long")
    return each.withColumn("run", F.explode("runs")).groupBy("run", "token").agg(
        of("c", 1).alias("c1"), of("c", 0).alias("c0"), of("df", 1).alias("df1"), of("df", 0).alias("df0"))


def bayes_weights(counts: DataFrame, key: str) -> DataFrame:
    """I1 for every ``key``: key, token, w = log P(token|1) - log P(token|0) from counts c1, c0 (smoothing 1)."""
    totals = counts.groupBy(key).agg(F.sum("c1").alias("t1"), F.sum("c0").alias("t0"), F.count(F.lit(1)).alias("v"))
    return counts.join(F.broadcast(totals), key).select(  # one row for each run or model
        key, "token", (F.log(F.col("c1") + 1.0) - F.log(F.col("t1") + F.col("v") * 1.0)
                       - F.log(F.col("c0") + 1.0) + F.log(F.col("t0") + F.col("v") * 1.0)).alias("w"))


def run_sizes(rows: DataFrame) -> DataFrame:
    """run, n1, n0: rows by label."""
    of = lambda label: F.sum(F.when(F.col("label") == label, 1).otherwise(0)).cast("long")
    return rows.withColumn("run", F.explode("runs")).groupBy("run").agg(of(1).alias("n1"), of(0).alias("n0"))


def lexicons(stats: DataFrame, sizes: DataFrame, k: int, min_df: int) -> DataFrame:
    """C4 for every run: run, target_label, ordinal, src, dst."""
    scored = stats.join(F.broadcast(sizes), "run").withColumn("lo", C.log_odds())
    cues = [scored.where(F.col(f"df{c}") >= min_df).select("run", F.lit(c).alias("cue"), "token", (F.col("lo") * (1 if c else -1)).alias("score")) for c in (1, 0)]
    top = Window.partitionBy("run", "cue").orderBy(F.col("score").desc(), F.col("token"))
    top = cues[0].unionByName(cues[1]).withColumn("ordinal", F.row_number().over(top)).where(F.col("ordinal") <= k)
    word = lambda c: F.max(F.when(F.col("cue") == c, F.col("token")))
    pairs = top.groupBy("run", "ordinal").agg(word(1).alias("w1"), word(0).alias("w0")).where("w1 IS NOT NULL AND w0 IS NOT NULL")
    swap = F.explode(F.array(F.struct(F.lit(0).alias("target_label"), F.col("w1").alias("src"), F.col("w0").alias("dst")),
                             F.struct(F.lit(1).alias("target_label"), F.col("w0").alias("src"), F.col("w1").alias("dst"))))
    return pairs.withColumn("s", swap).select("run", "s.target_label", "ordinal", "s.src", "s.dst")


def synonyms(stats: DataFrame, sizes: DataFrame, k: int = 7, min_df: int = 2, min_len: int = 4) -> DataFrame:
    """Label-neutral swap pairs of every run: run, ordinal, src, dst."""
    df = F.col("df0") + F.col("df1")
    neutral = stats.join(F.broadcast(sizes), "run").where((F.length("token") >= min_len) & (df >= min_df) & (F.abs(C.log_odds()) < 0.1))
    top = Window.partitionBy("run").orderBy(F.col("df").desc(), F.col("token"))
    top = neutral.select("run", "token", df.alias("df")).withColumn("r", F.row_number().over(top)).where(F.col("r") <= 2 * k)
    word = lambda odd: F.max(F.when(F.col("r") % 2 == odd, F.col("token")))
    pairs = top.groupBy("run", F.ceil(F.col("r") / 2).cast("int").alias("ordinal")).agg(word(1).alias("src"), word(0).alias("dst"))
    return pairs.where("src IS NOT NULL AND dst IS NOT NULL")


def _with_pairs(df: DataFrame, table: DataFrame, *more: str) -> DataFrame:
    """Adds pairs: the run's rows of a small table (a few for each run) as an array, from one scalar subquery."""
    same = lambda p: (p["run"] == F.col("run")) & F.coalesce(*[p[c] == F.col(c) for c in more], F.lit(True))
    pair = lambda p: F.struct(p["ordinal"].alias("ordinal"), p["src"].alias("src"), p["dst"].alias("dst"))
    whole = table.agg(F.collect_list(F.struct("run", *more, "ordinal", "src", "dst"))).scalar()
    return df.withColumn("_all", whole).withColumn("pairs", F.array_sort(F.transform(F.filter("_all", same), pair))).drop("_all")


def _seed_of_run(runs: list[tuple[float, int]]) -> Column:
    return F.element_at(F.array(*[F.lit(s) for _, s in runs]), F.col("run") + 1)


def _with_sets(df: DataFrame, lexicon: DataFrame, runs: list[tuple[float, int]]) -> DataFrame:
    """Adds sets: for each of a row's runs its seed and its lexicon's pairs for the row's target, from one scalar subquery."""
    pair = F.struct("ordinal", "src", "dst")
    lists = lexicon.groupBy("run", "target_label").agg(F.array_sort(F.collect_list(pair)).alias("pairs"))
    whole = lists.agg(F.collect_list(F.struct("run", "target_label", "pairs"))).scalar()
    seeds = F.array(*[F.lit(str(s)) for _, s in runs])
    own = lambda r: F.filter("_all", lambda x: (x["run"] == r) & (x["target_label"] == F.col("target_label")))
    each = F.transform("runs", lambda r: F.struct(
        r.cast("int").alias("run"), F.element_at(seeds, r + 1).alias("seed"), F.flatten(F.transform(own(r), lambda x: x["pairs"])).alias("pairs")))
    return df.withColumn("_all", whole).withColumn("sets", each).drop("_all")


def scored_rewrites(rows: DataFrame, runs, lexicon: DataFrame, weights: DataFrame, sizes: DataFrame, p: Params, n: int, rounds: int) -> DataFrame:
    """run, id, label, round, ordinal and the unrounded scores ls, ss, ms, and cs by preserve list, of every rewrite.
    Equal rewrites of a sample are scored once, whichever runs make them; its tokens meet the weights of all runs at once."""
    base = spread(rows.withColumn("target_label", (1 - F.col("label")).cast("int")), "id")
    lists = [F.array(*[F.lit(x) for x in items]) for items in PRESERVE_LISTS.values()]
    cands = scored_of_sets(_with_sets(base, lexicon, runs), F.col("sets"), n, rounds, p.pairs_per_candidate, lists, p.edit_method)
    # without texts, and written, since the changed tokens and the scores are read apart
    made = written(cands.select("id", "label", "target_label", "_own", "_made"), "grid-rewrites")
    cs = {f"cs_{name}": F.get("_m.cs", F.lit(i)) for i, name in enumerate(PRESERVE_LISTS)}
    slim = made.select("id", "label", "target_label", F.explode("_made").alias("_m")).withColumns(cs).select(
        "id", "label", "target_label", "_m.turns", "_m.ss", "_m.ms", *cs, F.col("_m.changed").alias("_changed"))
    w = [F.coalesce(f"w{i}", F.lit(0.0)) for i in range(len(runs))]
    none = F.array(*[F.lit(0.0) for _ in runs])
    wide = weights.groupBy("token").agg(*[F.max(F.when(F.col("run") == i, F.col("w"))).alias(f"w{i}") for i in range(len(runs))])
    new = F.array_distinct(F.flatten(F.transform("_made", lambda m: m["changed"]["token"])))
    each = F.concat("_own", F.transform(new, lambda t: F.struct(t.alias("token"), F.lit(0).alias("tf"))))
    touched = F.when(F.col("tf") == 0, F.struct("token", F.array(*w).alias("ws")))
    met = made.select("id", F.explode(each).alias("_t")).select("id", "_t.*").join(wide, "token").groupBy("id").agg(
        F.array(*[F.sum(F.col("tf") * x) for x in w]).alias("_own"), F.map_from_entries(F.collect_set(touched)).alias("_w"))
    add = lambda z, t: F.zip_with(z, F.coalesce(F.try_element_at("_w", t["token"]), none), lambda x, y: x + t["d"] * y)
    scored = slim.join(met, "id", "left").withColumn("_z", F.aggregate("_changed", F.coalesce("_own", none), add))
    each = scored.select("id", "label", "target_label", "ss", "ms", *cs, "_z", F.explode("turns").alias("_t")).select("*", "_t.*")
    prior = F.log(F.col("n1") + 1.0) - F.log(F.col("n0") + 1.0)
    logit = F.element_at("_z", F.col("run") + 1) + prior
    return each.join(F.broadcast(sizes), "run").select(
        "run", "id", "label", "round", "ordinal",
        (1 / (1 + F.exp(F.when(F.col("target_label") == 1, -logit).otherwise(logit)))).alias("ls"), "ss", "ms", *cs)


def chosen(scores: DataFrame, configs: list[Config]) -> DataFrame:
    """The rewrites that each config looks at: config (its place in the list), run, id, label, round, ordinal, rounded
    scores, and whether the config selects the rewrite."""
    structs = [F.struct(
        F.lit(i).alias("config"), F.lit(c.how).alias("how"), F.lit(c.params.num_candidates if c.how != "shot" else 1).alias("n"),
        F.lit(c.params.rounds if c.how == "rounds" else 1).alias("rounds"), F.lit(float(c.params.th_label)).alias("th_label"),
        F.lit(float(c.params.th_semantic)).alias("th_semantic"), F.lit(float(c.params.th_minimality)).alias("th_minimality"),
        F.lit(float(c.params.th_final)).alias("th_final"), F.lit(c.params.filtering_mode == "dynamic_percentile").alias("dynamic"),
        F.lit(_cut(c.params)).alias("q"), F.lit(int(c.params.keep_top_k)).alias("k"), F.lit(c.params.use_selector).alias("use_selector"),
        F.lit(c.preserve).alias("preserve"), *[F.lit(float(getattr(c.params, w))).alias(w) for w in ("w_label", "w_semantic", "w_minimality", "w_consistency")])
        for i, c in enumerate(configs) if c.how not in ("none", "synonym")]
    each = scores.withColumn("_c", F.explode(F.array(*structs))).select("*", "_c.*").drop("_c").where("ordinal <= n AND round <= rounds")
    cs = F.coalesce(*[F.when(F.col("preserve") == name, F.col(f"cs_{name}")) for name in PRESERVE_LISTS])
    fs = F.col("w_label") * F.col("ls") + F.col("w_semantic") * F.col("ss") + F.col("w_minimality") * F.col("ms") + F.col("w_consistency") * cs
    each = each.withColumn("fs", fs)
    passes = (F.col("ls") >= F.col("th_label")) & (F.col("ss") >= F.col("th_semantic")) & (F.col("ms") >= F.col("th_minimality")) & (F.col("fs") >= F.col("th_final"))
    each = each.withColumn("pass", passes)
    for name, short in (("label_score", "ls"), ("semantic_score", "ss"), ("minimality_score", "ms"), ("final_score", "fs")):
        each = each.withColumn(name, F.round(short, 4))
    within = (F.col("label_score") >= F.col("th_label")) & (F.col("semantic_score") >= F.col("th_semantic")) & (F.col("final_score") >= F.col("th_final"))
    each = each.withColumn("within", within)
    # one dealing of slim rows by sample serves all windows
    each = each.repartition("run", "id")
    sample, turn = Window.partitionBy("run", "id", "config"), Window.partitionBy("run", "id", "config", "round")
    # a percentile's share must be a literal: one column for each distinct one
    shares = sorted({_cut(c.params) for c in configs})
    cut = F.coalesce(*[F.when(F.col("q") == q, F.percentile(F.when(F.col("within"), F.col("final_score")), F.lit(q)).over(turn)) for q in shares])
    each = each.withColumn("_n", F.count(F.when(F.col("within"), 1)).over(turn)).withColumn("_cut", cut)
    each = each.withColumn("_q", F.col("within") & (~F.col("dynamic") | (F.col("_n") <= F.col("k")) | (F.col("final_score") >= F.col("_cut"))))
    best = F.row_number().over(turn.orderBy(F.col("_q").desc(), F.col("final_score").desc(), F.col("ordinal")))
    each = each.withColumn("_picked", F.when(F.col("use_selector"), F.col("_q") & (best <= F.col("k"))).otherwise(F.col("pass")))
    each = each.withColumn("_stop", F.min(F.when(F.col("_picked"), F.col("round"))).over(sample))
    each = each.withColumn("_hit", F.min(F.when(F.col("pass"), F.col("ordinal"))).over(sample))
    rounds, first = F.col("how") == "rounds", F.col("how").isin("first_pass", "filtered")
    seen = F.when(rounds, F.col("_stop").isNull() | (F.col("round") <= F.col("_stop"))).when(
        first, F.col("_hit").isNull() | (F.col("ordinal") <= F.col("_hit"))).otherwise(True)
    each = each.where(seen).withColumn("_survives", F.max("within").over(sample))
    selected = F.when(rounds, F.col("_picked") & (F.col("round") == F.col("_stop"))).when(
        F.col("how") == "filtered", (F.col("ordinal") == F.col("_hit")) & F.col("_survives")).when(
        F.col("how") == "first_pass", F.col("ordinal") == F.col("_hit")).otherwise(F.col("pass"))
    # the filtering baseline reports on the verifications that survive its thresholds
    return each.where((F.col("how") != "filtered") | F.col("within") | (F.col("ordinal") == F.col("_hit"))).select(
        "config", "run", "id", "label", "round", "ordinal", ((F.col("how") != "filtered") | F.col("within")).alias("verified"),
        "label_score", "semantic_score", "minimality_score", "final_score", F.coalesce(selected, F.lit(False)).alias("selected"))


def _cut(p: Params) -> float:
    return max(0.0, min(1.0, 1.0 - float(p.percentile_keep)))


def word_changes(text: Column, rewrite: Column) -> Column:
    """array of (token, d): the tokens of the words (parted by spaces, which no token holds) that differ place by place, with
    -1 in the text and 1 in the rewrite. Only these words are split into tokens."""
    signed = lambda word, d: F.transform(tokens(F.coalesce(word, F.lit(""))), lambda t: F.struct(t.alias("token"), F.lit(d).alias("d")))
    pairs = F.filter(F.zip_with(F.split(text, " "), F.split(rewrite, " "), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: ~p["a"].eqNullSafe(p["b"]))
    return F.flatten(F.transform(pairs, lambda p: F.concat(signed(p["a"], -1), signed(p["b"], 1))))


def merged_counts(rows: DataFrame, stats: DataFrame, sizes: DataFrame, picked: DataFrame, syn: DataFrame | None, runs, lexicon: DataFrame,
                  configs: list[Config], p: Params) -> tuple[DataFrame, DataFrame]:
    """Training counts of every model (H1 of every config and run): (run, token, c1_i and c0_i of each config i) and
    (model, n1, n0). A model's number is config * number of runs + run. All models of a run count its own rows; a
    synonym model counts them twice, but for the tokens that the swaps change."""
    n_runs = len(runs)
    model = F.lit(n_runs) * F.col("config") + F.col("run")
    everyone = F.explode(F.array(*[F.lit(i) for i in range(len(configs))]))
    target = (1 - F.col("label")).cast("int")
    # a rewrite that several configs picked is made and split once
    texts = picked.groupBy("run", "id", "round", "ordinal", "label").agg(F.array_sort(F.collect_list(model)).cast("array<int>").alias("models"))
    texts = texts.join(rows.select("id", "text"), "id").withColumn("target_label", target).withColumn("seed", _seed_of_run(runs))
    texts = rewritten(_with_pairs(texts, lexicon, "target_label"), F.col("pairs"), F.col("seed"), p.pairs_per_candidate)
    added = texts.select(F.explode(tokens(F.col("cand_text"))).alias("token"), F.col("target_label").alias("label"), "models", F.lit(1).alias("d"))
    swapping = [i for i, c in enumerate(configs) if c.how == "synonym"]
    if syn is not None:
        swapped = _with_pairs(rows.withColumn("run", F.explode("runs")).withColumn("seed", _seed_of_run(runs)), syn)
        swapped = swapped.withColumn("_swapped", synonyms_replaced(F.col("text"), F.col("pairs"), F.col("seed")))
        swapped = listed(swapped, "_d", word_changes(F.col("text"), F.col("_swapped"))).withColumn(
            "models", F.array(*[(F.lit(i * n_runs) + F.col("run")).cast("int") for i in swapping]))
        added = added.unionByName(swapped.select(F.explode("_d").alias("_c"), "label", "models").select("_c.token", "label", "models", "_c.d"))
    added = added.groupBy("token", "label", "models").agg(F.sum("d").alias("d")).withColumn("model", F.explode("models"))
    of = lambda label: F.when(F.col("label") == label, F.col("d")).otherwise(0).cast("long")
    more = added.select((F.col("model") % n_runs).alias("run"), "token", F.floor(F.col("model") / n_runs).cast("int").alias("config"), of(1).alias("c1"), of(0).alias("c0"))
    own = stats.select("run", "token", F.lit(-1).alias("config"), "c1", "c0")
    part = lambda c, i: F.sum(F.when(F.col("config") == i, F.col(c)).otherwise(0)).alias(f"{c}_{i}")
    sums = own.unionByName(more).groupBy("run", "token").agg(*[part(c, i) for i in range(-1, len(configs)) for c in ("c1", "c0")])
    counts = sums.select("run", "token", *[(F.col(f"`{c}_-1`") * (2 if i in swapping else 1) + F.col(f"{c}_{i}")).alias(f"{c}_{i}")
                                           for i in range(len(configs)) for c in ("c1", "c0")])
    numbers = lambda df: df.select("model", "n1", "n0")
    own_n = numbers(sizes.withColumn("config", everyone).withColumn("model", model))
    twice = numbers(sizes.withColumn("config", everyone).where(F.col("config").isin(swapping)).withColumn("model", model))
    one = lambda label: F.when(target == label, 1).otherwise(0).cast("long")
    more_n = picked.select(model.alias("model"), one(1).alias("n1"), one(0).alias("n0"))
    return counts, own_n.unionByName(twice).unionByName(more_n).groupBy("model").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def weights_abreast(counts: DataFrame, n_configs: int, n_runs: int) -> DataFrame:
    """I1 of every model from ``merged_counts``, as ``predictions`` reads them: token, part, w0, w1, ... A token of a run is one
    row until its runs meet, whatever the number of configs."""
    c, places = range(n_configs), range(min(ABREAST, n_configs * n_runs))
    seen = lambda i: F.col(f"c1_{i}") + F.col(f"c0_{i}") > 0
    totals = counts.groupBy("run").agg(*[F.sum(f"c1_{i}").alias(f"t1_{i}") for i in c], *[F.sum(f"c0_{i}").alias(f"t0_{i}") for i in c],
                                       *[F.sum(seen(i).cast("long")).alias(f"v_{i}") for i in c])
    weight = lambda i: F.when(seen(i), F.log(F.col(f"c1_{i}") + 1.0) - F.log(F.col(f"t1_{i}") + F.col(f"v_{i}") * 1.0)
                              - F.log(F.col(f"c0_{i}") + 1.0) + F.log(F.col(f"t0_{i}") + F.col(f"v_{i}") * 1.0))
    of_run = counts.join(F.broadcast(totals), "run").select("run", "token", *[weight(i).alias(f"x{i}") for i in c])   # one row for each run
    # a token's rows meet before they are widened, so that nothing wide is exchanged; plain maxima need neither lists nor sorting
    parts = range(-(-n_configs * n_runs // ABREAST))
    met = of_run.repartition("token").withColumn("part", F.explode(F.array(*[F.lit(part) for part in parts])))
    of = lambda part, m: F.when((F.col("part") == part) & (F.col("run") == m % n_runs), F.col(f"x{m // n_runs}"))
    of_place = lambda i: [of(part, m) for part in parts if (m := part * ABREAST + i) < n_configs * n_runs]
    return met.groupBy("token", "part").agg(*[F.max(F.coalesce(*of_place(i))).alias(f"w{i}") for i in places])


#: Models whose weights stand side by side in one row.
ABREAST = 60


def predictions(samples: DataFrame, weights: DataFrame, sizes: DataFrame, n_models: int) -> DataFrame:
    """model, split, label, prediction of every sample by every model (numbered below ``n_models``). A sample's tokens are
    counted before they meet the models' weights, those of up to ABREAST models in one row: (model, token, w), or as
    ``weights_abreast`` gives them."""
    parts = range(-(-n_models // ABREAST))
    places = range(min(ABREAST, n_models))
    part, place = F.floor(F.col("model") / ABREAST).cast("int"), F.col("model") % ABREAST
    wide = weights
    if "part" not in weights.columns:
        wide = weights.groupBy("token", part.alias("part")).agg(*[F.max(F.when(place == i, F.col("w"))).alias(f"w{i}") for i in places])
    counted = samples.select("id", F.explode(tokens(F.col("text"))).alias("token")).groupBy("id", "token").agg(F.count(F.lit(1)).alias("tf"))
    sums = counted.join(wide, "token").groupBy("id", "part").agg(*[F.sum(F.col("tf") * F.col(f"w{i}")).alias(f"z{i}") for i in places])
    every = samples.select("id", "split", "label", F.explode(F.array(*[F.lit(i) for i in parts])).alias("part")).join(sums, ["id", "part"], "left")
    every = every.select("split", "label", "part", F.posexplode(F.array(*[F.coalesce(f"z{i}", F.lit(0.0)) for i in places])).alias("place", "z"))
    prior = F.log(F.col("n1") + 1.0) - F.log(F.col("n0") + 1.0)
    return every.withColumn("model", F.col("part") * ABREAST + F.col("place")).join(F.broadcast(sizes), "model").select(   # a row for each model
        "model", "split", "label", ((F.col("z") + prior) > 0).cast("int").alias("prediction"))


def run_configs(spark: SparkSession, root: str, configs: list[Config], runs: list[tuple[float, int]], p: Params) -> DataFrame:
    """One row for each (config, run): accuracies and F1 by split, sizes, counts and mean scores."""
    samples = written(S.prepared_samples(spark, root, p).select("id", "text", "label", "split", "domain"), "grid-samples")
    train = samples.where("domain = 'id' AND split = 'train'")
    rows = written(samples_of_runs(train, runs, p.train_samples), "grid-train")
    stats = written(token_stats(rows), "grid-stats")
    sizes = written(run_sizes(rows), "grid-sizes")
    lexicon = written(lexicons(stats, sizes, p.lexicon_size, p.lexicon_min_df), "grid-lexicon")
    syn = written(synonyms(stats, sizes), "grid-synonyms") if any(c.how == "synonym" for c in configs) else None
    weights = written(bayes_weights(stats, "run"), "grid-weights")
    looking = [c for c in configs if c.how not in ("none", "synonym")]
    n, rounds = max(c.params.num_candidates for c in looking), max(c.params.rounds for c in looking)
    scores = written(scored_rewrites(rows, runs, lexicon, weights, sizes, p, n, rounds), "grid-scores")
    marked = written(chosen(scores, configs), "grid-marked")

    n_orig = sizes.select("run", (F.col("n1") + F.col("n0")).alias("n_orig"))
    aug = marked.where("selected").join(F.broadcast(n_orig), "run").withColumn("seed", _seed_of_run(runs)).withColumn(
        "candidate_id", F.concat(F.col("round").cast("string"), F.lit("c"), F.col("ordinal").cast("string")))
    ratio = p.ratio
    picked = written(take_smallest(aug, hash_rank_key(F.col("seed"), F.lit("merge"), "id", "candidate_id"),
                                   lambda total: F.least(total, F.floor(F.col("n_orig") * F.lit(float(ratio)))),
                                   by=["config", "run", "n_orig"], tiebreak=("id", "candidate_id")), "grid-picked")
    counts, models = merged_counts(rows, stats, sizes, picked, syn, runs, lexicon, configs, p)
    models = written(models, "grid-models")
    model_weights = weights_abreast(written(counts, "grid-counts"), len(configs), len(runs))
    pred = predictions(samples.where(F.col("split").isin("validation", "test", "ood_test")), model_weights, models, len(configs) * len(runs))
    metrics = classification_metrics(pred, ["model", "split"])
    wide = metrics.groupBy("model").agg(*[F.max(F.when(F.col("split") == s, F.col(m))).alias(f"{name}_{m}")
                                          for s, name in (("test", "test"), ("validation", "val"), ("ood_test", "ood")) for m in ("acc", "f1")])
    model = (F.lit(len(runs)) * F.col("config") + F.col("run")).alias("model")
    quality = marked.groupBy(model).agg(
        F.sum(F.col("verified").cast("long")).alias("n_ver"), F.sum(F.col("selected").cast("long")).alias("n_aug"),
        *[F.round(F.avg(F.when(F.col("verified"), F.col(c))), 4).alias(a) for c, a in (
            ("label_score", "label_success"), ("semantic_score", "semantic_sim"), ("minimality_score", "edit_similarity"), ("final_score", "final_score"))])
    config, run = F.floor(F.col("model") / len(runs)).cast("int"), (F.col("model") % len(runs)).cast("int")
    at = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), i + 1)
    out = models.join(wide, "model", "left").join(quality, "model", "left").withColumn("config", config).withColumn("run", run)
    out = out.join(F.broadcast(n_orig), "run").withColumn("how", at([c.how for c in configs], F.col("config")))
    n_ver, n_aug = F.coalesce("n_ver", F.lit(0)), F.coalesce("n_aug", F.lit(0))
    generated = F.when(F.col("how") == "none", 0).when(F.col("how") == "synonym", F.col("n_orig")).otherwise(F.when(n_ver > 0, n_ver).otherwise(n_aug))
    selected = F.when(F.col("how") == "none", 0).when(F.col("how") == "synonym", F.col("n_orig")).otherwise(n_aug)
    return out.select(
        at([c.name for c in configs], F.col("config")).alias("method"), at([c.preset for c in configs], F.col("config")).alias("preset"),
        at([ratio_name(r) for r, _ in runs], F.col("run")).alias("ratio"), at([s for _, s in runs], F.col("run")).alias("seed"),
        "test_acc", "test_f1", "val_acc", "val_f1", "ood_acc", "ood_f1", F.round(F.col("test_acc") - F.col("ood_acc"), 4).alias("gap"),
        (F.col("n1") + F.col("n0")).alias("train_size"), generated.cast("long").alias("generated"), selected.cast("long").alias("selected"),
        "label_success", "semantic_sim", "edit_similarity", "final_score")


SEEDS = (42, 43, 44)
PRESETS = {"default": DEFAULT, "multi_stage": MULTI_STAGE}


def method_runs(spark: SparkSession, root: str, seeds=SEEDS, ratios=LADDER, presets=None) -> DataFrame:
    """Every method under every preset, seed and ratio."""
    presets = presets or PRESETS
    return run_configs(spark, root, method_configs(presets), run_list(ratios, seeds), next(iter(presets.values())))


def ablation_runs(spark: SparkSession, root: str, seeds=SEEDS, preset: str = "multi_stage") -> DataFrame:
    """The six variants of a preset on the whole training sample, for every seed."""
    p = PRESETS[preset]
    return run_configs(spark, root, variant_configs(preset, p), run_list((1.0,), seeds), p)
