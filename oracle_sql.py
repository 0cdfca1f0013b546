"""Independent DuckDB SQL for the registered queries (the correctness oracle).

Each builder returns CTE text mirroring one operator's semantics, written
directly against the pre-registered views (documents, labels, embeddings,
events, ...). Parameters come from the same Params presets the Spark side
uses, so both sides agree on thresholds, weights and seeds.
"""

from __future__ import annotations

from flipside.operators.generate import UNCHANGED_CLAUSE
from flipside.operators.linear import LinearParams
from flipside.operators.planning import (CAUSAL, DEFAULT_PRESERVE, PLANNER_TEMPLATE, PRESERVE, SINGLE_PRESERVE,
                                         STRIP_CHARS)
from flipside.operators.score import (DEFAULT_FEEDBACK, GENERIC_CRITIQUE, ISSUE_EDIT, ISSUE_LABEL,
                                      ISSUE_SEMANTIC)
from flipside.params import CRITIQUE_LIMITS, LADDER, MULTI_STAGE, Params


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def str_list(items) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]::VARCHAR[]"


TOK = "regexp_extract_all(lower({x}), '[a-z'']+')"


def tok(x: str) -> str:
    return TOK.format(x=x)


def cap(x: str) -> str:
    return f"(upper(substr({x}, 1, 1)) || lower(substr({x}, 2)))"


def md5_key(seed, *parts) -> str:
    cols = [q(str(seed))] + [f"CAST({p} AS VARCHAR)" for p in parts]
    return f"md5(concat_ws(':', {', '.join(cols)}))"


def ascii_q(x: str) -> str:
    # DuckDB's levenshtein counts bytes; Spark's counts characters. Non-ASCII
    # characters become '?' on the oracle side only (candidates differ from
    # their original by ASCII words, so distances agree).
    return f"regexp_replace({x}, '[^\\x00-\\x7F]', '?', 'g')"


def samples_cte(p: Params) -> str:
    """S1 + P1 + P2 + P9 -> prepared(id, text, label, lang, source, split, domain)."""
    b = f"(('0x' || substr({md5_key(p.split_seed, 'id')}, 1, 8))::BIGINT % 100)"
    return f"""
raw AS (
  SELECT d.doc_id AS id, d.text, CAST(l.{p.label_col} AS INTEGER) AS label, d.lang, d.source
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
),
cleaned AS (
  SELECT id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text, label, lang, source FROM raw
),
dedup AS (
  SELECT id, arg_min({{'text': text, 'label': label, 'lang': lang, 'source': source}}, text) AS r
  FROM cleaned WHERE text IS NOT NULL AND length(text) > 0 AND label IS NOT NULL GROUP BY id
),
pre AS (SELECT id, r.text AS text, r.label AS label, r.lang AS lang, r.source AS source FROM dedup),
split0 AS (
  SELECT *, CASE WHEN {b} < {p.train_pct} THEN 'train'
                 WHEN {b} < {p.train_pct + p.validation_pct} THEN 'validation' ELSE 'test' END AS split0
  FROM pre
),
prepared AS (
  SELECT id, text, label, lang, source,
         CASE WHEN lang = {q(p.in_domain_lang)} THEN split0 ELSE 'ood_test' END AS split,
         CASE WHEN lang = {q(p.in_domain_lang)} THEN 'id' ELSE 'ood' END AS domain
  FROM split0
),
train AS (SELECT * FROM prepared WHERE domain = 'id' AND split = 'train')"""


def lexicon_cte(p: Params, src: str = "train") -> str:
    """C4 mined lexicon -> lexicon(target_label, ordinal, src, dst)."""
    a = 0.5
    lo = (f"ln((df1 + {a}) / (n1 - df1 + {a})) - ln((df0 + {a}) / (n0 - df0 + {a}))")
    return f""",
tokdocs AS (SELECT label, unnest(list_distinct({tok('text')})) AS token FROM {src}),
tstats AS (
  SELECT token, count(*) FILTER (WHERE label = 1) AS df1, count(*) FILTER (WHERE label = 0) AS df0
  FROM tokdocs GROUP BY token
),
ncls AS (SELECT count(*) FILTER (WHERE label = 1) AS n1, count(*) FILTER (WHERE label = 0) AS n0 FROM {src}),
scored_tok AS (SELECT token, df1, df0, {lo} AS lo FROM tstats, ncls),
cues AS (
  SELECT * FROM (
    SELECT cue_label, token, score,
           row_number() OVER (PARTITION BY cue_label ORDER BY score DESC, token) AS rank
    FROM (SELECT 1 AS cue_label, token, lo AS score FROM scored_tok WHERE df1 >= {p.lexicon_min_df}
          UNION ALL
          SELECT 0 AS cue_label, token, -lo AS score FROM scored_tok WHERE df0 >= {p.lexicon_min_df})
  ) WHERE rank <= {p.lexicon_size}
),
lexicon AS (
  SELECT 0 AS target_label, c1.rank AS ordinal, c1.token AS src, c0.token AS dst
  FROM cues c1 JOIN cues c0 ON c1.rank = c0.rank AND c1.cue_label = 1 AND c0.cue_label = 0
  UNION ALL
  SELECT 1 AS target_label, c1.rank AS ordinal, c0.token AS src, c1.token AS dst
  FROM cues c1 JOIN cues c0 ON c1.rank = c0.rank AND c1.cue_label = 1 AND c0.cue_label = 0
),
lexpairs AS (
  SELECT t.target_label,
         coalesce((SELECT list({{'ordinal': ordinal, 'src': src, 'dst': dst}} ORDER BY ordinal)
                   FROM lexicon l WHERE l.target_label = t.target_label), []) AS pairs
  FROM (SELECT 0 AS target_label UNION ALL SELECT 1) t
)"""


def candidates_cte(p: Params, src: str, n: int, rounds: int, name: str = "cands",
                   preserve=PRESERVE) -> str:
    """E1 over `src` -> name(id, text, label, target_label, round, ordinal, candidate_id, cand_text, preserve)."""
    swap = (f"replace(replace(acc, pp.src, pp.dst), {cap('pp.src')}, {cap('pp.dst')})")
    keyed = (f"list_slice(list_sort(list_transform(lp.pairs, lambda x: "
             f"{{'k': {md5_key(p.seed, 's.id', 'r.round', 'o.ordinal', 'x.src')}, 'src': x.src, 'dst': x.dst}})), 1, {p.pairs_per_candidate})")
    return f""",
{name}_raw AS (
  SELECT s.id, s.text, s.label, 1 - s.label AS target_label, r.round, o.ordinal,
         list_reduce({keyed}, lambda acc, pp: {swap}, s.text) AS changed
  FROM {src} s
  JOIN lexpairs lp ON lp.target_label = 1 - s.label
  CROSS JOIN (SELECT unnest(range(1, {rounds} + 1)) AS round) r
  CROSS JOIN (SELECT unnest(range(1, {n} + 1)) AS ordinal) o
),
{name} AS (
  SELECT id, text, label, CAST(target_label AS INTEGER) AS target_label, CAST(round AS INTEGER) AS round,
         CAST(ordinal AS INTEGER) AS ordinal, 'c' || CAST(ordinal AS VARCHAR) AS candidate_id,
         CASE WHEN changed = text THEN text || CASE WHEN target_label = 0 THEN {q(UNCHANGED_CLAUSE[0])}
                                                   ELSE {q(UNCHANGED_CLAUSE[1])} END
              ELSE changed END AS cand_text,
         {str_list(preserve)} AS preserve
  FROM {name}_raw
)"""


def nb_cte(train: str = "train") -> str:
    """Multinomial NB (smoothing 1) as Spark ML fits it: vocab = train tokens."""
    return f""",
nb_tok AS (SELECT label, unnest({tok('text')}) AS token FROM {train}),
nb_vocab AS (SELECT DISTINCT token FROM nb_tok),
nb_v AS (SELECT count(*) AS v FROM nb_vocab),
nb_cls AS (SELECT label, count(*) AS n_docs FROM {train} GROUP BY label),
nb_pi AS (
  SELECT label, ln(n_docs + 1.0) - ln((SELECT sum(n_docs) FROM nb_cls) + (SELECT count(*) FROM nb_cls) * 1.0) AS pi
  FROM nb_cls
),
nb_tc AS (SELECT label, token, count(*) AS c FROM nb_tok GROUP BY label, token),
nb_ctot AS (SELECT label, count(*) AS c FROM nb_tok GROUP BY label),
nb_theta AS (
  SELECT v.token, cl.label, ln(coalesce(tc.c, 0) + 1.0) - ln(ct.c + nb_v.v * 1.0) AS th
  FROM nb_vocab v CROSS JOIN nb_cls cl JOIN nb_ctot ct ON ct.label = cl.label CROSS JOIN nb_v
  LEFT JOIN nb_tc tc ON tc.token = v.token AND tc.label = cl.label
)"""


def nb_score_cte(docs: str, key_cols: list[str], text_col: str, name: str) -> str:
    """name(key..., raw0, raw1): NB raw scores of every row of `docs`."""
    keys = ", ".join(key_cols)
    dk = ", ".join(f"d.{k}" for k in key_cols)
    return f""",
{name}_tok AS (SELECT {keys}, unnest({tok(text_col)}) AS token FROM {docs}),
{name}_sum AS (
  SELECT {', '.join('t.' + k for k in key_cols)}, th.label, sum(th.th) AS s
  FROM {name}_tok t JOIN nb_theta th ON th.token = t.token GROUP BY ALL
),
{name} AS (
  SELECT {dk},
         max(CASE WHEN pi.label = 0 THEN pi.pi + coalesce(s.s, 0) END) AS raw0,
         max(CASE WHEN pi.label = 1 THEN pi.pi + coalesce(s.s, 0) END) AS raw1
  FROM (SELECT DISTINCT {keys} FROM {docs}) d CROSS JOIN nb_pi pi
  LEFT JOIN {name}_sum s ON {' AND '.join(f's.{k} = d.{k}' for k in key_cols)} AND s.label = pi.label
  GROUP BY ALL
)"""


def p_class(raw_t: str, raw_o: str) -> str:
    return (f"(CASE WHEN {raw_t} >= {raw_o} THEN 1.0 / (1.0 + exp({raw_o} - {raw_t})) "
            f"ELSE exp({raw_t} - {raw_o}) / (1.0 + exp({raw_t} - {raw_o})) END)")


def verify_cte(p: Params, cands: str, name: str = "ver") -> str:
    """F1 + F3 + F5 + F6 -> F7/F8/F9 over `cands` -> name(...)."""
    keys = ["id", "round", "ordinal"]
    ls = p_class("CASE WHEN c.target_label = 1 THEN nb.raw1 ELSE nb.raw0 END",
                 "CASE WHEN c.target_label = 1 THEN nb.raw0 ELSE nb.raw1 END")
    ta, tb = f"list_distinct({tok('c.text')})", f"list_distinct({tok('c.cand_text')})"
    ss = (f"CASE WHEN len({ta}) * len({tb}) > 0 THEN len(list_intersect({ta}, {tb})) / sqrt(len({ta}) * len({tb})) "
          f"ELSE 0.0 END")
    longest = "greatest(length(c.text), length(c.cand_text))"
    ms = (f"CASE WHEN {longest} = 0 THEN 1.0 ELSE 1.0 - levenshtein({ascii_q('c.text')}, {ascii_q('c.cand_text')}) "
          f"/ {longest} END")
    ptoks = "list_transform(list_filter(c.preserve, lambda x: length(trim(x)) > 0), lambda x: string_split_regex(lower(trim(x)), '\\s+')[1])"
    cs = (f"CASE WHEN len({ptoks}) = 0 THEN 0.8 ELSE least(1.0, greatest(0.0, "
          f"len(list_filter({ptoks}, lambda t: contains(lower(c.text), t) AND contains(lower(c.cand_text), t))) "
          f"/ len({ptoks}))) END")
    lim = CRITIQUE_LIMITS
    crit = (f"concat_ws('; ', CASE WHEN ls < {lim['label']} THEN {q(ISSUE_LABEL)} END, "
            f"CASE WHEN ss < {lim['semantic']} THEN {q(ISSUE_SEMANTIC)} END, "
            f"CASE WHEN ms < {lim['minimality']} THEN {q(ISSUE_EDIT)} END)")
    # rounds and ordinals often give the same rewrite: its distance is worked out once
    return nb_score_cte(cands, keys, "cand_text", f"{name}_nb") + f""",
{name}_ms AS MATERIALIZED (SELECT id, cand_text, {ms} AS ms FROM (SELECT DISTINCT id, text, cand_text FROM {cands}) c),
{name}_s AS (
  SELECT c.*, {ls} AS ls, {ss} AS ss, d.ms, {cs} AS cs
  FROM {cands} c JOIN {name}_nb nb ON nb.id = c.id AND nb.round = c.round AND nb.ordinal = c.ordinal
  JOIN {name}_ms d ON d.id = c.id AND d.cand_text = c.cand_text
),
{name}_f AS (
  SELECT *, {p.w_label} * ls + {p.w_semantic} * ss + {p.w_minimality} * ms + {p.w_consistency} * cs AS fs
  FROM {name}_s
),
{name} AS (
  SELECT id, text, label, target_label, round, ordinal, candidate_id, cand_text,
         round(ls, 4) AS label_score, round(ss, 4) AS semantic_score, round(ms, 4) AS minimality_score,
         round(cs, 4) AS consistency_score, round(fs, 4) AS final_score,
         CASE WHEN ls >= {p.th_label} AND ss >= {p.th_semantic} AND ms >= {p.th_minimality} AND fs >= {p.th_final}
              THEN 'pass' ELSE 'reject' END AS status,
         CASE WHEN ls >= {p.th_label} AND ss >= {p.th_semantic} AND ms >= {p.th_minimality} AND fs >= {p.th_final}
              THEN '' WHEN {crit} = '' THEN {q(GENERIC_CRITIQUE)} ELSE {crit} END AS critique
  FROM {name}_f
)"""


def mark_cte(p: Params, ver: str, name: str = "marked") -> str:
    """Selection marks per (id, round) + stop round per id (E5)."""
    t = f"(label_score >= {p.th_label} AND semantic_score >= {p.th_semantic} AND final_score >= {p.th_final})"
    if not p.use_selector:
        sel = "status = 'pass'"
        return f""",
{name} AS (
  SELECT *, min(CASE WHEN selected THEN round END) OVER (PARTITION BY id) AS stop_round
  FROM (SELECT *, {sel} AS selected FROM {ver})
)"""
    if p.filtering_mode == "dynamic_percentile":
        qv = max(0.0, min(1.0, 1.0 - p.percentile_keep))
        qexpr = (f"_t AND (count(*) FILTER (WHERE _t) OVER w <= {p.keep_top_k} OR final_score >= "
                 f"quantile_cont(CASE WHEN _t THEN final_score END, {qv}) OVER w)")
    else:
        qexpr = "_t"
    return f""",
{name}_t AS (SELECT *, {t} AS _t FROM {ver}),
{name}_q AS (SELECT *, {qexpr} AS _q FROM {name}_t WINDOW w AS (PARTITION BY id, round)),
{name}_r AS (
  SELECT *, _q AND row_number() OVER (PARTITION BY id, round ORDER BY _q DESC, final_score DESC, ordinal) <= {p.keep_top_k} AS selected
  FROM {name}_q
),
{name} AS (SELECT *, min(CASE WHEN selected THEN round END) OVER (PARTITION BY id) AS stop_round FROM {name}_r)"""


def select_cte(p: Params, ver: str, name: str = "sel") -> str:
    """G1 -> G2 -> G3 per (id, round) -> name(...)."""
    t = f"label_score >= {p.th_label} AND semantic_score >= {p.th_semantic} AND final_score >= {p.th_final}"
    qv = max(0.0, min(1.0, 1.0 - p.percentile_keep))
    g2 = (f"SELECT * FROM (SELECT *, count(*) OVER w AS _n, quantile_cont(final_score, {qv}) OVER w AS _cut "
          f"FROM {name}_g1 WINDOW w AS (PARTITION BY id, round)) WHERE _n <= {p.keep_top_k} OR final_score >= _cut"
          if p.filtering_mode == "dynamic_percentile" else f"SELECT * FROM {name}_g1")
    return f""",
{name}_g1 AS (SELECT * FROM {ver} WHERE {t}),
{name}_g2 AS ({g2}),
{name} AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, round ORDER BY final_score DESC, ordinal) AS _rk
                 FROM {name}_g2) WHERE _rk <= {p.keep_top_k}
)"""


def with_(body: str, final: str) -> str:
    return "WITH " + body.strip().lstrip(",") + "\n" + final


def take_cte(src: str, key: str, n_expr: str, by: list[str], name: str, tiebreak: str = "id") -> str:
    part = f"PARTITION BY {', '.join(by)}" if by else ""
    return f""",
{name}_k AS (SELECT *, substr({key}, 1, 15) AS _k, count(*) OVER ({part}) AS _total FROM {src}),
{name} AS (
  SELECT * EXCLUDE (_k, _total, _rn) FROM (
    SELECT *, row_number() OVER ({part} ORDER BY _k, {tiebreak}) AS _rn FROM {name}_k
  ) WHERE _rn <= {n_expr}
)"""


# ---------------------------------------------------------------------------------------------------
# Per-query oracle SQL
# ---------------------------------------------------------------------------------------------------

P = MULTI_STAGE
VER_COLS = ("id, round, ordinal, candidate_id, target_label, label_score, semantic_score, minimality_score, "
            "consistency_score, final_score, status, critique")


def _base(p: Params = P) -> str:
    return samples_cte(p)


def _round1(p: Params = P, preserve=PRESERVE, name: str = "cands") -> str:
    return _base(p) + lexicon_cte(p) + candidates_cte(p, "train", p.num_candidates, 1, name, preserve)


def _ver1(p: Params = P, preserve=PRESERVE) -> str:
    return _round1(p, preserve) + nb_cte() + verify_cte(p, "cands")


def _ver_all(p: Params = P) -> str:
    """One round of rewrites of all prepared samples; lexicon and model come from the train split."""
    return (_base(p) + lexicon_cte(p) + candidates_cte(p, "prepared", p.num_candidates, 1, "cands", PRESERVE)
            + nb_cte() + verify_cte(p, "cands"))


def _first_pass(p: Params = P) -> str:
    return _ver1(p, SINGLE_PRESERVE) + """,
fp AS (SELECT *, min(CASE WHEN status = 'pass' THEN ordinal END) OVER (PARTITION BY id) AS _hit FROM ver)"""


def _rounds(p: Params = P) -> str:
    return (_base(p) + lexicon_cte(p) + candidates_cte(p, "train", p.num_candidates, p.rounds, "cands", PRESERVE)
            + nb_cte() + verify_cte(p, "cands") + mark_cte(p, "ver"))


def _core_oracles() -> dict[str, str]:
    p = P
    o: dict[str, str] = {}
    o["s1_load_samples"] = with_(_base(p), "SELECT id, text, label, lang, source FROM raw")
    o["p1_preprocess"] = with_(_base(p), "SELECT id, text, label, lang, source FROM pre")
    o["p2_assign_split"] = with_(_base(p), "SELECT id, split0 AS split FROM split0")
    o["p3_subsample"] = with_(_base(p) + take_cte("prepared", md5_key(p.seed, "id"), "100", [], "sub"),
                              "SELECT id, label FROM sub")
    o["p4_stratified_fraction"] = with_(
        _base(p) + take_cte("train", md5_key(p.seed, "id"), "floor(_total * 0.3)", ["label"], "strat"),
        "SELECT id, label FROM strat")
    ratios = "(SELECT unnest([" + ", ".join(f"{r}::DOUBLE" for r in LADDER) + "]) AS ratio)"
    o["p5_low_resource_ladder"] = with_(
        _base(p) + f""",
lad_in AS (SELECT t.*, r.ratio FROM train t CROSS JOIN {ratios} r)"""
        + take_cte("lad_in", md5_key(p.seed, "id"), "least(_total, greatest(1, floor(_total * ratio)))",
                   ["ratio"], "lad"),
        "SELECT ratio, id FROM lad")
    o["p6_low_resource_stratified"] = with_(
        _base(p) + f""",
lrs_in AS (SELECT t.*, r.ratio FROM train t CROSS JOIN {ratios} r)"""
        + take_cte("lrs_in", md5_key(p.seed, "id"), "CASE WHEN ratio < 1.0 THEN floor(_total * ratio) ELSE _total END",
                   ["ratio", "label"], "lrs"),
        "SELECT ratio, id, label FROM lrs")
    o["p7_target_label"] = with_(_base(p), "SELECT id, label, CAST(1 - label AS INTEGER) AS target_label FROM prepared")
    words = "len(list_filter(string_split_regex(text, '\\s+'), lambda w: length(w) > 0))"
    edges = (0, 20, 50, 200, 1000)
    case = "CASE " + " ".join(f"WHEN n_words >= {lo} AND n_words < {hi} THEN '{lo}-{hi}'"
                              for lo, hi in zip(edges[:-1], edges[1:])) + f" ELSE '{edges[-1]}+' END"
    o["p8_length_bins"] = with_(_base(p) + f""",
lb AS (SELECT *, {words} AS n_words FROM prepared)""",
                                f"SELECT {case} AS length_bin, count(*) AS n_rows, round(avg(n_words), 4) AS mean_words, "
                                f"round(avg(label), 4) AS positive_rate FROM lb GROUP BY 1")
    o["p9_domain_split"] = with_(_base(p), "SELECT id, domain, split FROM prepared")
    strip = "'^[" + STRIP_CHARS + "]+|[" + STRIP_CHARS + "]+$'"
    change = (f"list_transform(list_slice(list_filter(list_filter(string_split_regex(trim(text), '\\s+'), "
              f"lambda w: length(w) > 0), lambda w: length(w) > 5), 1, 4), lambda w: regexp_replace(w, {strip}, '', 'g'))")
    o["c1_rule_plan"] = with_(_base(p), f"SELECT id, CAST(1 - label AS INTEGER) AS target_label, "
                                        f"array_to_string({change}, '|') AS elements_to_change, "
                                        f"{q('|'.join(PRESERVE))} AS elements_to_preserve, "
                                        f"{q('|'.join(CAUSAL))} AS causal_features FROM prepared")
    o["c2_default_plan"] = with_(_base(p), f"SELECT id, CAST(1 - label AS INTEGER) AS target_label, "
                                           f"{q('|'.join(DEFAULT_PRESERVE))} AS elements_to_preserve, 0 AS n_change FROM prepared")
    first = "string_split(text, ' ')[1]"
    o["c6_reply_plans"] = with_(_base(p) + f""",
pk AS (SELECT *, ('0x' || substr({md5_key(11, 'id')}, 1, 8))::BIGINT % 5 AS k, {first} AS w, {change} AS chg FROM prepared),
pl AS (
  SELECT id, CAST(1 - label AS INTEGER) AS target_label, text, CASE WHEN k IN (0, 1, 3) THEN 'reply' ELSE 'rule' END AS plan_source,
    CASE WHEN k = 3 THEN ['a'] ELSE {str_list(CAUSAL)} END AS causal, CASE WHEN k = 0 THEN list_filter(chg, lambda x: x <> '') ELSE chg END AS chg,
    CASE k WHEN 0 THEN [w] WHEN 1 THEN [w, w || ' two', 'named', 'plain'] WHEN 3 THEN [] ELSE {str_list(PRESERVE)} END AS keep
  FROM pk)""", f"""
SELECT id, target_label, plan_source, array_to_string(causal, '|') AS causal_features, array_to_string(chg, '|') AS elements_to_change,
  array_to_string(keep, '|') AS elements_to_preserve,
  round(CASE WHEN len(keep) = 0 THEN 0.8 ELSE len(list_filter(keep, lambda x: contains(lower(text), string_split(lower(x), ' ')[1]))) / len(keep) END, 4) AS consistency_score
FROM pl""")
    prompt = q(PLANNER_TEMPLATE)
    for key, val in [("{id}", "CAST(id AS VARCHAR)"), ("{label}", "CAST(label AS VARCHAR)"),
                     ("{target_label}", "CAST(1 - label AS VARCHAR)"), ("{num_candidates}", q(str(p.num_candidates))),
                     ("{plan_json}", "'{}'"), ("{feedback}", "''"), ("{text}", "text")]:
        prompt = f"replace({prompt}, {q(key)}, {val})"
    o["c3_render_prompts"] = with_(_base(p), f"SELECT 'planner:' || CAST(id AS VARCHAR) || ':1' AS request_id, id, "
                                             f"'planner' AS stage, 1 AS round, {prompt} AS prompt FROM prepared")
    o["c4_cue_lexicon"] = with_(_base(p) + lexicon_cte(p), "SELECT target_label, CAST(ordinal AS INTEGER) AS ordinal, src, dst FROM lexicon")
    o["c7_call_usage"] = ("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type AS stage, 'rule' AS model, "
                          "count(*) AS calls FROM events GROUP BY ALL")
    o["e1_lexicon_candidates"] = with_(_round1(p), "SELECT id, round, ordinal, candidate_id, target_label, cand_text FROM cands")
    o["e3_first_pass"] = with_(_first_pass(p), "SELECT id, cand_text AS text, target_label AS label, 'single' AS source "
                                               "FROM fp WHERE ordinal = _hit")
    o["e3_first_pass_verifications"] = with_(_first_pass(p), f"SELECT {VER_COLS} FROM fp WHERE _hit IS NULL OR ordinal <= _hit")
    o["e5_augment_rounds"] = with_(_rounds(p), "SELECT id, round, ordinal, candidate_id, cand_text AS text, "
                                               "target_label AS label, 'multi_stage' AS source, final_score "
                                               "FROM marked WHERE selected AND round = stop_round")
    o["e5_verifications"] = with_(_rounds(p), f"SELECT {VER_COLS} FROM marked WHERE stop_round IS NULL OR round <= stop_round")
    o["e5_feedback"] = with_(_rounds(p) + """,
kept AS (SELECT * FROM marked WHERE stop_round IS NULL OR round <= stop_round),
fb AS (SELECT id, round, arg_min(critique, CASE WHEN status = 'reject' THEN ordinal END) AS _c,
              max(stop_round) AS _stop FROM kept GROUP BY id, round)""",
                             f"SELECT id, round + 1 AS round, coalesce(_c, {q(DEFAULT_FEEDBACK)}) AS feedback FROM fb "
                             f"WHERE (_stop IS NULL OR round < _stop) AND round + 1 <= {p.rounds}")
    o["f1_label_score"] = with_(_ver1(p), "SELECT id, ordinal, label_score FROM ver")
    o["f3_semantic_score"] = with_(_ver_all(p), "SELECT id, ordinal, semantic_score FROM ver")
    o["f5_edit_similarity"] = with_(_ver_all(p), "SELECT id, ordinal, minimality_score FROM ver")
    o["f6_consistency"] = with_(_ver_all(p), "SELECT id, ordinal, consistency_score FROM ver")
    o["f8_verify"] = with_(_ver1(p), f"SELECT {VER_COLS} FROM ver")
    o["f4_embedding_cosine"] = """
WITH cent AS (
  SELECT label, list(v ORDER BY pos) AS centroid FROM (
    SELECT label, pos, avg(CAST(embedding[pos] AS DOUBLE)) AS v
    FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings) GROUP BY label, pos)
  GROUP BY label
),
j AS (
  SELECT e.vec_id, e.label, list_dot_product(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)), c.centroid) AS dot,
         sqrt(list_dot_product(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)))) AS na,
         sqrt(list_dot_product(c.centroid, c.centroid)) AS nb
  FROM embeddings e JOIN cent c ON c.label = e.label
)
SELECT vec_id, label, round(CASE WHEN na > 0 AND nb > 0 THEN dot / (na * nb) ELSE 0.0 END, 4) AS cosine FROM j"""
    sel_cols = "id, round, ordinal, candidate_id, cand_text AS text, target_label AS label, 'multi_stage' AS source, final_score"
    o["g1_threshold_filter"] = with_(_ver1(p), f"SELECT {VER_COLS} FROM ver WHERE label_score >= {p.th_label} AND "
                                               f"semantic_score >= {p.th_semantic} AND final_score >= {p.th_final}")
    o["g2_dynamic_percentile"] = with_(_ver1(p) + select_cte(p, "ver"), f"SELECT {VER_COLS} FROM sel_g2")
    o["g3_top_k"] = with_(_ver1(p), f"SELECT {VER_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY id, round "
                                    f"ORDER BY final_score DESC, ordinal) AS _rk FROM ver) WHERE _rk <= {p.keep_top_k}")
    o["g4_select"] = with_(_ver1(p) + select_cte(p, "ver"), f"SELECT {sel_cols} FROM sel")
    o["g5_select_pass_only"] = with_(_ver1(p), f"SELECT {sel_cols} FROM ver WHERE status = 'pass'")
    o["g6_post_filter"] = with_(_first_pass(p), f"""
SELECT id, cand_text AS text, target_label AS label, 'single' AS source FROM fp
WHERE ordinal = _hit AND id IN (SELECT id FROM fp WHERE (_hit IS NULL OR ordinal <= _hit)
  AND label_score >= {p.th_label} AND semantic_score >= {p.th_semantic} AND final_score >= {p.th_final})""")
    return o


def synonyms_cte(p: Params, src: str = "train", k: int = 7, min_df: int = 2, min_len: int = 4) -> str:
    a = 0.5
    lo = f"ln((df1 + {a}) / (n1 - df1 + {a})) - ln((df0 + {a}) / (n0 - df0 + {a}))"
    return f""",
sy_tokdocs AS (SELECT label, unnest(list_distinct({tok('text')})) AS token FROM {src}),
sy_stats AS (SELECT token, count(*) FILTER (WHERE label = 1) AS df1, count(*) FILTER (WHERE label = 0) AS df0
             FROM sy_tokdocs GROUP BY token),
sy_n AS (SELECT count(*) FILTER (WHERE label = 1) AS n1, count(*) FILTER (WHERE label = 0) AS n0 FROM {src}),
sy_neutral AS (SELECT token, df0 + df1 AS df FROM sy_stats, sy_n
               WHERE length(token) >= {min_len} AND df0 + df1 >= {min_df} AND abs({lo}) < 0.1),
sy_top AS (SELECT * FROM (SELECT token, row_number() OVER (ORDER BY df DESC, token) AS rank FROM sy_neutral)
           WHERE rank <= {2 * k}),
synonyms AS (
  SELECT CAST((a.rank + 1) / 2 AS INTEGER) AS ordinal, a.token AS src, b.token AS dst
  FROM sy_top a JOIN sy_top b ON a.rank % 2 = 1 AND b.rank = a.rank + 1
)"""


def _extra_oracles(o: dict) -> None:
    p = P
    swap = f"replace(replace(acc, pp.src, pp.dst), {cap('pp.src')}, {cap('pp.dst')})"
    keyed = (f"list_slice(list_sort(list_transform((SELECT list({{'ordinal': ordinal, 'src': src, 'dst': dst}}) FROM synonyms), "
             f"lambda x: {{'k': {md5_key(p.seed, 's.id', 'x.src')}, 'src': x.src, 'dst': x.dst}})), 1, 3)")
    o["e2_synonym_augment"] = with_(
        _base(p) + synonyms_cte(p)
        + take_cte("train", md5_key(p.seed, "'synonym'", "id"), f"least(_total, floor(_total * {float(p.ratio)}))", [], "syn_rows"),
        f"SELECT s.id, list_reduce({keyed}, lambda acc, pp: CASE WHEN contains(lower(acc), pp.src) THEN {swap} ELSE acc END, s.text) AS text, "
        f"s.label, 'synonym' AS source FROM syn_rows s")
    o["e4_single_shot"] = with_(
        _base(p) + lexicon_cte(p) + candidates_cte(p, "train", 1, 1, "cands", SINGLE_PRESERVE) + nb_cte()
        + verify_cte(p, "cands"),
        "SELECT id, cand_text AS text, target_label AS label, 'single' AS source FROM ver WHERE status = 'pass'")
    o["f2_cue_score"] = with_(
        _ver_all(p) + """,
cw AS (SELECT list(dst) FILTER (WHERE target_label = 0) AS w0, list(dst) FILTER (WHERE target_label = 1) AS w1 FROM lexicon),
cc AS (SELECT v.id, v.ordinal, v.target_label, """ + tok("v.cand_text") + """ AS toks, cw.w0, cw.w1 FROM ver v, cw),
cn AS (SELECT id, ordinal,
         len(list_filter(toks, lambda t: list_contains(CASE WHEN target_label = 1 THEN w1 ELSE w0 END, t))) AS nt,
         len(list_filter(toks, lambda t: list_contains(CASE WHEN target_label = 1 THEN w0 ELSE w1 END, t))) AS ns
       FROM cc)""",
        "SELECT id, ordinal, round(CASE WHEN nt + ns > 0 THEN nt / (nt + ns) ELSE 0.5 END, 4) AS cue_score FROM cn")
    o["f10_diversity"] = with_(
        _round1(p) + f""",
pairs AS (
  SELECT a.id, a.round, 1.0 * levenshtein({ascii_q('a.cand_text')}, {ascii_q('b.cand_text')})
         / greatest(length(a.cand_text), length(b.cand_text)) AS d
  FROM cands a JOIN cands b ON a.id = b.id AND a.round = b.round AND a.ordinal < b.ordinal
),
groups AS (SELECT id, round, count(*) AS n_candidates FROM cands GROUP BY id, round)""",
        "SELECT g.id, g.round, g.n_candidates, round(coalesce((SELECT avg(d) FROM pairs p WHERE p.id = g.id AND p.round = g.round), 0.0), 4) AS diversity FROM groups g")


def _more_oracles(o: dict) -> None:
    p = P
    sel = "SELECT id, round, ordinal, candidate_id, cand_text AS text, target_label AS label FROM marked WHERE selected AND round = stop_round"
    o["h1_merge_train"] = with_(
        _rounds(p) + f""",
aug AS ({sel}),
norig AS (SELECT count(*) AS n FROM train)"""
        + take_cte("aug", md5_key(p.seed, "'merge'", "id", "candidate_id"),
                   f"least(_total, floor((SELECT n FROM norig) * {float(p.ratio)}))", [], "picked", "id, candidate_id"),
        "SELECT id, 'original' AS source, label, text FROM train UNION ALL "
        "SELECT id, 'multi_stage' AS source, label, text FROM picked")
    o["h2_sample_stats"] = with_(
        _rounds(p),
        "SELECT 'multi_stage' AS method, "
        "CASE WHEN (SELECT count(*) FROM marked WHERE stop_round IS NULL OR round <= stop_round) > 0 "
        "THEN (SELECT count(*) FROM marked WHERE stop_round IS NULL OR round <= stop_round) "
        "ELSE (SELECT count(*) FROM marked WHERE selected AND round = stop_round) END AS generated, "
        "(SELECT count(*) FROM marked WHERE selected AND round = stop_round) AS selected")
    o["h3_run_counters"] = with_(
        _rounds(p) + """,
v AS (SELECT count(*) AS n FROM marked WHERE stop_round IS NULL OR round <= stop_round),
s AS (SELECT count(*) AS n FROM marked WHERE selected AND round = stop_round),
i AS (SELECT count(*) AS n FROM train),
np AS (SELECT count(*) AS n FROM train t WHERE NOT EXISTS (SELECT 1 FROM marked m WHERE m.id = t.id AND m.selected AND m.round = m.stop_round))""",
        "SELECT i.n AS input_samples, v.n AS generated_candidates, v.n AS verified_candidates, s.n AS selected_samples, "
        "greatest(0, i.n - s.n) AS dropped_samples, np.n AS samples_without_selection FROM i, v, s, np")
    preds = (_base(p) + nb_cte() + """,
ev AS (SELECT id, text, label, split, domain FROM prepared WHERE split IN ('validation', 'test', 'ood_test'))"""
             + nb_score_cte("ev", ["id"], "text", "evnb") + """,
pred AS (
  SELECT e.id, e.split, e.domain, e.label, CASE WHEN nb.raw1 > nb.raw0 THEN 1 ELSE 0 END AS prediction,
         """ + p_class("nb.raw1", "nb.raw0") + """ AS probability
  FROM ev e JOIN evnb nb ON nb.id = e.id
)""")
    o["i2_predict"] = with_(preds, "SELECT id, split, prediction, round(probability, 4) AS probability FROM pred")

    def metrics(by: str, src: str = "pred") -> str:
        f = lambda c: (f"CASE WHEN 2 * tp{c} + fp{c} + fn{c} > 0 THEN 2.0 * tp{c} / (2 * tp{c} + fp{c} + fn{c}) ELSE 0.0 END")
        return f"""
SELECT {by}, n AS n_rows, round(correct / n, 4) AS acc,
       round(CASE WHEN present0 + present1 > 0 THEN ({f(0)} * present0 + {f(1)} * present1) / (present0 + present1) ELSE 0.0 END, 4) AS f1
FROM (
  SELECT {by}, count(*) AS n, sum(CASE WHEN label = prediction THEN 1 ELSE 0 END) AS correct,
    sum(CASE WHEN label = 0 AND prediction = 0 THEN 1 ELSE 0 END) AS tp0, sum(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS tp1,
    sum(CASE WHEN label <> 0 AND prediction = 0 THEN 1 ELSE 0 END) AS fp0, sum(CASE WHEN label <> 1 AND prediction = 1 THEN 1 ELSE 0 END) AS fp1,
    sum(CASE WHEN label = 0 AND prediction <> 0 THEN 1 ELSE 0 END) AS fn0, sum(CASE WHEN label = 1 AND prediction <> 1 THEN 1 ELSE 0 END) AS fn1,
    max(CASE WHEN label = 0 OR prediction = 0 THEN 1 ELSE 0 END) AS present0, max(CASE WHEN label = 1 OR prediction = 1 THEN 1 ELSE 0 END) AS present1
  FROM {src} GROUP BY {by})"""
    o["i3_classification_metrics"] = with_(preds, metrics("split"))
    o["i6_ood_report"] = with_(preds + """,
m AS (""" + metrics("method, domain", "(SELECT *, 'none' AS method FROM pred WHERE split IN ('test', 'ood_test'))") + ")",
        "SELECT method, max(CASE WHEN domain = 'id' THEN acc END) AS id_acc, max(CASE WHEN domain = 'id' THEN f1 END) AS id_f1, "
        "max(CASE WHEN domain = 'ood' THEN acc END) AS ood_acc, max(CASE WHEN domain = 'ood' THEN f1 END) AS ood_f1, "
        "round(max(CASE WHEN domain = 'id' THEN acc END) - max(CASE WHEN domain = 'ood' THEN acc END), 4) AS gap FROM m GROUP BY method")
    o["i5_quality_report"] = with_(
        _rounds(p),
        "SELECT round(avg(label_score), 4) AS label_success, round(avg(semantic_score), 4) AS semantic_sim, "
        "round(avg(minimality_score), 4) AS edit_similarity, round(avg(final_score), 4) AS final_score "
        "FROM marked WHERE stop_round IS NULL OR round <= stop_round")
    from flipside.params import variant_params
    parts = []
    for v in ("full", "no_selector", "fixed_threshold"):
        pv = variant_params(p, v)
        body = _ver1(p) + mark_cte(pv, "ver", "mk")
        parts.append((v, body))
    # each variant is an independent marking of the same verification set
    sqls = []
    for v, body in parts:
        sqls.append(f"SELECT '{v}' AS variant, CAST(sum(CAST(selected AS INTEGER)) AS BIGINT) AS selected, count(*) AS verified "
                    f"FROM (WITH {body.strip().lstrip(',')} SELECT * FROM mk)")
    o["j1_variant_selection"] = " UNION ALL ".join(sqls)


def _linear_oracles(o: dict) -> None:
    """I1, the linear kind: gradient descent written out, one pair of tables (scores, weights) an epoch. Slot -1 is the intercept."""
    l = LinearParams()
    body = _base(P) + f""",
lt AS (SELECT id, unnest({tok('text')}) AS token FROM prepared),
lc AS (SELECT id, ('0x' || substr(md5('slot:' || token), 1, 8))::BIGINT % {l.buckets} AS slot, 1 + ln(count(*)) AS v FROM lt GROUP BY ALL),
lx AS MATERIALIZED (SELECT id, slot, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS x FROM lc UNION ALL SELECT id, -1, 1.0 FROM prepared),
lrows AS MATERIALIZED (SELECT id, label, split, (SELECT count(*) FROM train) / (2.0 * (SELECT count(*) FROM train t WHERE t.label = p.label)) AS c FROM prepared p),
ln_ AS (SELECT count(*) AS n FROM lrows WHERE split = 'train'),
lw0 AS MATERIALIZED (SELECT DISTINCT slot, CAST(0 AS DOUBLE) AS w, CAST(0 AS DOUBLE) AS m FROM lx SEMI JOIN train USING (id)),
lz0 AS MATERIALIZED (SELECT id, label, split, c, CAST(0 AS DOUBLE) AS z FROM lrows)"""
    for e in range(1, l.epochs + 1):
        body += f""",
lg{e} AS (SELECT slot, sum(x * c * (1 / (1 + exp(-z)) - label)) / (SELECT greatest(1, n) FROM ln_) AS g FROM lx JOIN lz{e - 1} USING (id) WHERE split = 'train' GROUP BY slot),
lw{e} AS MATERIALIZED (SELECT slot, w + m AS w, m FROM (SELECT slot, w, {l.momentum} * m - {l.step} * (g + CASE WHEN slot >= 0 THEN {l.penalty} * w ELSE 0 END) AS m FROM lw{e - 1} JOIN lg{e} USING (slot))),
lz{e} AS MATERIALIZED (SELECT id, any_value(label) AS label, any_value(split) AS split, any_value(c) AS c, sum(x * coalesce(w, 0)) AS z FROM lx LEFT JOIN lw{e} USING (slot) JOIN lrows USING (id) GROUP BY id)"""
    f1 = lambda c: f"2.0 * t{c} / (2 * t{c} + f0 + f1)"
    body += """,
lall AS (""" + " UNION ALL ".join(f"SELECT {e} AS epoch, * FROM lz{e}" for e in range(1, l.epochs + 1)) + f"""),
lsum AS (
  SELECT epoch, sum(CASE WHEN split = 'train' THEN c * ln(1 + exp(CASE WHEN label = 1 THEN -z ELSE z END)) END) / (SELECT greatest(1, n) FROM ln_) AS train_loss,
    count(*) FILTER (WHERE split = 'validation') AS n, count(*) FILTER (WHERE split = 'validation' AND label = 0 AND z <= 0) AS t0,
    count(*) FILTER (WHERE split = 'validation' AND label = 1 AND z > 0) AS t1, count(*) FILTER (WHERE split = 'validation' AND label = 0 AND z > 0) AS f0,
    count(*) FILTER (WHERE split = 'validation' AND label = 1 AND z <= 0) AS f1
  FROM lall GROUP BY epoch),
lhist AS (
  SELECT epoch, coalesce(train_loss, 0.0) AS train_loss, (t0 + t1) / greatest(1, n) AS val_acc,
    (CASE WHEN t0 + f0 + f1 > 0 THEN {f1(0)} ELSE 0 END + CASE WHEN t1 + f0 + f1 > 0 THEN {f1(1)} ELSE 0 END)
    / greatest(1, CAST(t0 + f0 + f1 > 0 AS INTEGER) + CAST(t1 + f0 + f1 > 0 AS INTEGER)) AS val_f1
  FROM lsum),
lbest AS (SELECT epoch FROM lhist ORDER BY val_f1 DESC, epoch LIMIT 1)"""
    o["i1_train_epochs"] = with_(body, "SELECT CAST(epoch AS INTEGER) AS epoch, round(train_loss, 4) AS train_loss, round(val_acc, 4) AS val_acc, round(val_f1, 4) AS val_f1, "
                                       "epoch = (SELECT epoch FROM lbest) AS kept FROM lhist")
    o["i2_predict_linear"] = with_(body, "SELECT id, split, CAST(z > 0 AS INTEGER) AS prediction, round(1 / (1 + exp(-z)), 4) AS probability "
                                         "FROM lall WHERE epoch = (SELECT epoch FROM lbest) AND split IN ('test', 'ood_test')")


def _sink_oracles(o: dict) -> None:
    """Sinks and incremental runs: their results must equal the batch tables."""
    p = P
    o["h4_resume"] = with_(_base(p), "SELECT count(*) AS pending_first, CAST(0 AS BIGINT) AS pending_second FROM train")
    o["s2_stage_roundtrip"] = o["e5_verifications"]
    o["h4_resumed_augment"] = o["e5_augment_rounds"]
    o["h5_stream_augment"] = o["e5_augment_rounds"]



def _response_oracles(o: dict) -> None:
    """The reply rows are built from the same parts, so what each parse must find is known."""
    shapes = """
t AS (SELECT 'generator:' || CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS request_id, conv_id AS id, coalesce(text, '') AS t FROM conversations),
r AS (SELECT request_id, id, ('0x' || substr(md5('7:' || request_id), 1, 8))::BIGINT % 10 AS k, t, t || ' (one)' AS a, t || ' (two)' AS b FROM t),
w AS (SELECT *, CAST(to_json({'candidates': [{'candidate_id': 'c1', 'text': a}, {'candidate_id': 'c2', 'text': b}]}) AS VARCHAR) AS whole FROM r),
p AS (SELECT *, CASE WHEN k IN (0, 1, 4, 5, 6) THEN 'ok' WHEN k IN (2, 9) THEN 'scanned' WHEN k = 8 THEN 'failed_call' ELSE 'error' END AS parse_status,
  CASE WHEN k IN (0, 1, 2, 9) THEN whole WHEN k = 4 THEN CAST(to_json({'candidates': [a, '', b]}) AS VARCHAR)
       WHEN k = 5 THEN CAST(to_json({'candidates': [{'output': a}]}) AS VARCHAR) WHEN k = 6 THEN CAST(to_json({'prediction': a}) AS VARCHAR) END AS json FROM w)"""
    strip = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    flat = lambda x: strip.format(x=f"regexp_replace({x}, '\\s+', ' ', 'g')")
    o["d1_extract_json"] = with_(shapes, "SELECT request_id, parse_status, json FROM p")
    o["d2_salvage_candidates"] = with_(shapes, f"""
SELECT request_id, id, CAST(1 AS INTEGER) AS round, CAST(0 AS INTEGER) AS pos, 'c1' AS candidate_id, {flat('a')} AS text FROM p WHERE k IN (0, 1, 2, 3, 9)
UNION ALL SELECT request_id, id, 1, 1, 'c2', {flat("CASE WHEN k = 3 THEN left(b, length(b) - 3) ELSE b END")} FROM p WHERE k IN (0, 1, 2, 3, 9)""")
    o["d3_normalize_candidates"] = with_(shapes, f"""
SELECT request_id, id, CAST(1 AS INTEGER) AS round, CAST(0 AS INTEGER) AS pos, 'c1' AS candidate_id, {strip.format(x='a')} AS text FROM p WHERE json IS NOT NULL
UNION ALL SELECT request_id, id, 1, CASE WHEN k = 4 THEN 2 ELSE 1 END, CASE WHEN k = 4 THEN 'c3' ELSE 'c2' END, {strip.format(x='b')} FROM p WHERE k IN (0, 1, 2, 4, 9)""")
    o["d4_first_text"] = with_(shapes, f"SELECT request_id, id, CASE WHEN json IS NULL THEN '' ELSE {strip.format(x='a')} END AS first_text FROM p")
    o["d5_parse_report"] = with_(shapes, "SELECT parse_status, count(*) AS n FROM p GROUP BY parse_status")


def oracles() -> dict[str, str]:
    o = _core_oracles()
    for add in (_extra_oracles, _more_oracles, _linear_oracles, _sink_oracles, _response_oracles):
        add(o)
    return o
