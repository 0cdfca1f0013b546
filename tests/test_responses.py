import json
import os

import pytest

from flipside.operators import responses as D

CASES = [
    ("clean", '{"candidates":[{"candidate_id":"c1","text":"t"}]}'),
    ("fenced", '```json\n{"candidates":[{"candidate_id":"c1","text":"t"}]}\n```'),
    ("prose", 'Sure: {"candidates":[{"candidate_id":"c1","text":"t"}]} done'),
    ("brace", '{"text":"a } b"}'),
    ("badfirst", '{oops} {"text":"t"}'),
    ("strlist", '{"candidates":["t1","","t3"]}'),
    ("altkey", '{"candidates":[{"output":"t"}]}'),
    ("pred", '{"prediction":"t"}'),
    ("garbage", "no json"),
    ("empty", ""),
]


def _resp(spark, rows):
    return spark.createDataFrame([(k, i, "generator", 1, c, None, 1) for i, (k, c) in enumerate(rows)],
                                 D.RESPONSE_SCHEMA)


def test_extract_json(spark):
    parsed = {r.request_id: r for r in D.extract_json(_resp(spark, CASES)).collect()}
    assert json.loads(parsed["fenced"].json)["candidates"][0]["text"] == "t"
    assert json.loads(parsed["prose"].json)["candidates"][0]["text"] == "t"
    assert json.loads(parsed["brace"].json)["text"] == "a } b"
    assert json.loads(parsed["badfirst"].json)["text"] == "t"
    assert parsed["garbage"].json is None and parsed["garbage"].parse_status == "error"
    assert parsed["clean"].parse_status == "ok"


def test_normalize_candidates(spark):
    parsed = D.extract_json(_resp(spark, CASES))
    got = {}
    for r in D.normalize_candidates(parsed).collect():
        got.setdefault(r.request_id, []).append((r.candidate_id, r.text))
    assert sorted(got["strlist"]) == [("c1", "t1"), ("c3", "t3")]
    assert got["altkey"] == [("c1", "t")]
    assert got["pred"] == [("c1", "t")]
    assert got["clean"] == [("c1", "t")]


def test_salvage_truncated(spark):
    trunc = '{"candidates":[{"candidate_id":"c1","text":"a"},{"candidate_id":"c2","text":"b'
    dup = '{"candidates":[{"candidate_id":"c1","text":"a"},{"candidate_id":"c1","text":"a"},{"candidate_id":"c2","text":"b'
    got = {}
    for r in D.salvage_candidates(_resp(spark, [("t", trunc), ("d", dup)])).collect():
        got.setdefault(r.request_id, []).append((r.candidate_id, r.text))
    assert sorted(got["t"]) == [("c1", "a"), ("c2", "b")]
    assert sorted(got["d"]) == [("c1", "a"), ("c2", "b")]


def test_first_text_and_report(spark):
    parsed = D.extract_json(_resp(spark, CASES))
    ft = {r.request_id: r.first_text for r in D.first_text(parsed).collect()}
    assert ft["brace"] == "a } b" and ft["strlist"] == "t1" and ft["pred"] == "t"
    rep = {r.parse_status: r.n for r in D.parse_report(parsed).collect()}
    assert rep["error"] == 2


def test_batch_complete_failures_become_rows(spark):
    prompts = spark.createDataFrame([("r1", 1, "generator", 1, "x"), ("r2", 2, "generator", 1, "boom")],
                                    "request_id string, id long, stage string, round int, prompt string")

    def factory():
        def fn(stage, prompt):
            if prompt == "boom":
                raise RuntimeError("down")
            return '{"text": "ok"}'
        return fn

    out = {r.request_id: r for r in D.batch_complete(prompts, factory, max_retries=2, backoff=0).collect()}
    assert out["r1"].content == '{"text": "ok"}' and out["r1"].attempts == 1
    assert out["r2"].content is None and "down" in out["r2"].error and out["r2"].attempts == 3


TRUNCATED = '{"candidates":[{"candidate_id":"c1","text":"a"},{"candidate_id":"c2","text":"b'


@pytest.mark.parametrize("content, status, candidates", [
    (TRUNCATED, "error", [("c1", "a"), ("c2", "b")]),
    ('{oops {"a":1}}', "error", []),
    ("{'text':'x'}", "error", []),
    ('{"prediction":" p "} and {"prediction":"q"}', "scanned", [("c1", "p")]),
    ('{"candidates":[{"text":5},{"text":{"a":1}},"{braces} text",{"text":"  ","candidate":"z"},'
     '{"text":"","candidate":"y","candidate_id":7}]}', "ok", [("c3", "{braces} text"), ("7", "y")]),
    ('{"candidates":"none","prediction":"p"}', "ok", [("c1", "p")]),
    ('{"candidates":[" ",null,3],"prediction":""}', "ok", []),
    ('{"text":"e \\"q\\"","candidate_id":"c9"', "error", [("c9", 'e "q"')]),
    (None, "failed_call", []),
])
def test_reply_to_candidates(spark, content, status, candidates):
    """D1, then D3 on what was read and D2 on what was not."""
    parsed = D.extract_json(_resp(spark, [("r", content)]))
    assert parsed.first().parse_status == status
    read = D.normalize_candidates(parsed).collect()
    rest = D.salvage_candidates(parsed.filter("json IS NULL AND content IS NOT NULL")).collect()
    assert [(r.candidate_id, r.text) for r in sorted(read + rest, key=lambda r: r.pos)] == candidates


def test_long_reply_is_salvaged(spark):
    text = 'long \\"text\\" ' * 50_000
    (row,) = D.salvage_candidates(_resp(spark, [("r", '{"candidates":[{"candidate_id":"c1","text":"' + text)])).collect()
    assert row.text == ('long "text" ' * 50_000).strip()


def test_top_level_blocks():
    assert list(D.top_level_blocks('a {"x": "}{"} b {c {d}} {e')) == ['{"x": "}{"}', "{c {d}}"]
    assert list(D.top_level_blocks('{"open string }')) == []
    assert list(D.top_level_blocks("{" * 3000)) == []


def test_rejects_have_a_preview(spark):
    (row,) = D.parse_rejects(D.extract_json(_resp(spark, [("ok", "{}"), ("bad", "no\njson" + "x" * 500)]))).collect()
    assert row.request_id == "bad" and row.preview.startswith("no\\njsonx") and len(row.preview) == 401


def test_repair_round_trip(spark):
    parsed = D.extract_json(_resp(spark, [("good", '{"prediction":"p"}'), ("bad", "nothing"), ("lost", "nothing")]))
    asked = D.repair_requests(parsed)
    assert sorted(r.request_id for r in asked.collect()) == ["bad:repair", "lost:repair"]
    answers = D.extract_json(_resp(spark, [("bad:repair", '{"prediction":"q"}'), ("lost:repair", "still nothing")]))
    merged = {r.request_id: (r.parse_status, r.json) for r in D.merge_repaired(parsed, answers).collect()}
    assert merged == {"good": ("ok", '{"prediction":"p"}'), "bad": ("repaired", '{"prediction":"q"}'), "lost": ("error", None)}


def _counting(folder):
    """The stand-in model, leaving a file for each call."""
    import model_stub
    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(model_stub)

    def factory():
        import hashlib
        import uuid

        answer = model_stub.rule_model_factory()

        def fn(stage, prompt):
            key = hashlib.md5(prompt.encode()).hexdigest()
            open(f"{folder}/{key}-{uuid.uuid4().hex}", "w").close()
            return answer(stage, prompt)
        return fn
    return factory


def test_model_rounds(spark, tmp_path):
    from pyspark.sql import functions as F
    from flipside.params import MULTI_STAGE
    from flipside.plans.queries import _model, _train
    from flipside.plans.rounds import augment_rounds_with_model
    root = "/root/testdata/sf0.001"
    one = augment_rounds_with_model(_train(spark, root), _counting(str(tmp_path)), _model(spark, root),
                                    MULTI_STAGE.with_(max_retry_rounds=0), max_retries=0, backoff=0)
    assert one.verifications.count() > 0 and one.selected.count() >= 0
    calls = [name.split("-")[0] for name in os.listdir(tmp_path)]
    assert len(calls) == len(set(calls)) > 0  # one call for each prompt, however often the tables are read
    import model_stub
    res = augment_rounds_with_model(_train(spark, root), model_stub.rule_model_factory, _model(spark, root), MULTI_STAGE,
                                    max_retries=0, backoff=0)
    sel, ver = res.selected, res.verifications
    # every sample of the first round has a candidate but those whose reply holds no JSON, asked twice
    first = ver.filter("round = 1").select("id").distinct().count()
    assert _train(spark, root).count() * 0.7 <= first
    assert sel.join(ver, ["id", "round", "ordinal"], "left_anti").count() == 0
    # a sample is selected in one round only, within the round budget
    assert sel.groupBy("id").agg(F.countDistinct("round").alias("r")).filter("r > 1").count() == 0
    assert sel.filter(F.col("round") > MULTI_STAGE.rounds).count() == 0
    assert ver.filter((F.col("final_score") < 0) | (F.col("final_score") > 1)).count() == 0


@pytest.mark.parametrize("content, candidates, first", [
    ('{"score": NaN, "candidates": ["a", "b"]}', [("c1", "a"), ("c2", "b")], "a"),
    ('{"score": -Infinity, "big": 1e999, "prediction": "p"}', [("c1", "p")], "p"),
    ('{"candidates": ["old"], "candidates": ["new"]}', [("c1", "new")], "new"),
    ('{"candidates": [{"text": "x", "text": "y"}]}', [("c1", "y")], "y"),
    ('{"candidates": ["a"], "deep": ' + "[" * 1500 + "]" * 1500 + "}", [("c1", "a")], "a"),
    ('{"candidates": ["\\ud800 half"]}', None, None),
    ('{"n": 123456789012345678901234567890123456789012345, "text": "t"}', [], "t"),
    ('{"deep": ' + "[" * 200_000 + ', "candidates": ["a"]', [], ""),
])
def test_ok_means_readable(spark, content, candidates, first):
    """Whatever D1 calls ok, Spark's JSON parser takes, and D3 and D4 find what it holds."""
    from pyspark.sql import functions as F
    parsed = D.extract_json(_resp(spark, [("r", content)]))
    row = parsed.select("parse_status", F.try_parse_json("json").isNull().alias("unread")).first()
    assert row.unread == (row.parse_status not in ("ok", "scanned"))
    if candidates is not None:
        assert [(r.candidate_id, r.text) for r in D.normalize_candidates(parsed).orderBy("pos").collect()] == candidates
        assert D.first_text(parsed).first().first_text == first


def test_repair_comes_before_salvage(spark, tmp_path):
    """Readable repair; repair cut short; no repair; nothing to salvage at first, then a good reply; never anything."""
    folder = str(tmp_path)
    cut = lambda t: '{"candidates":[{"candidate_id":"c1","text":"' + t

    def factory():
        def fn(stage, prompt):
            name = prompt.split("name=")[1].split("!")[0]
            repair = prompt.startswith("Rewrite the following reply")
            path = f"{folder}/{name}-{repair}"
            n = len(open(path).read()) if os.path.exists(path) else 0
            open(path, "a").write("x")
            mark = f" name={name}!"
            if not repair:
                return {"late": "nothing" + mark if n == 0 else '{"prediction":"second try"}', "never": "nothing" + mark}.get(name, cut("from the reply") + mark)
            return {"good": '{"candidates":["from the repair"]}', "cut": cut("half a repair"), "late": "still nothing", "never": "no"}.get(name, "")
        return fn

    names = ["good", "cut", "none", "late", "never"]
    prompts = spark.createDataFrame([(n, i, "generator", 1, f"name={n}!") for i, n in enumerate(names)],
                                    "request_id string, id long, stage string, round int, prompt string")
    log = f"{folder}/log"
    got = {r.request_id: r.text for r in D.complete_candidates(prompts, factory, max_retries=2, backoff=0, log_dir=log, model="m").collect()}
    assert got == {"good": "from the repair", "cut": "half a repair", "none": "from the reply name=none!", "late": "second try"}
    calls = {n: [len(open(f"{folder}/{n}-{r}").read()) if os.path.exists(f"{folder}/{n}-{r}") else 0 for r in (False, True)] for n in names}
    assert calls == {"good": [1, 1], "cut": [1, 1], "none": [1, 3], "late": [2, 1], "never": [3, 3]}
    # the call log has a row per call, and the hourly counts add up to them
    from flipside.operators.planning import call_usage
    from pyspark.sql import functions as F
    logged = spark.read.parquet(log)
    assert {n: [logged.where(F.col("request_id") == n).count(), logged.where(F.col("request_id") == f"{n}:repair").count()] for n in names} == calls
    assert logged.where("request_id = 'none:repair' AND outcome = 'failed'").count() == 3 and logged.where("request_id = 'none' AND outcome = 'ok'").count() == 1
    assert call_usage(logged).agg(F.sum("calls")).first()[0] == sum(map(sum, calls.values()))


def test_planner_replies_become_plans(spark):
    from pyspark.sql import functions as F
    from flipside.operators.planning import rule_plan
    from flipside.operators.score import consistency_score
    samples = spark.createDataFrame([(i, "The remarkable Paris story", i % 2) for i in range(6)], "id long, text string, label int")
    replies = ['{"elements_to_preserve": [{"text": "Paris trip"}, {"token": "Rome"}, {"name": "story"}, {"text": 3, "name": "x"}, 4, " "]}',
               '{"elements_to_preserve": {"text": "Paris"}, "elements_to_change": []}', None, "nothing", '{"target_label": 9, "causal_features": ["a", {"text": "b"}]}']
    parsed = D.extract_json(spark.createDataFrame([(f"r{i}", i, "planner", 1, c, None, 1) for i, c in enumerate(replies)], D.RESPONSE_SCHEMA))
    rule = {r.id: r for r in rule_plan(samples).collect()}
    plans = D.plans_from_replies(parsed, rule_plan(samples))
    got = {r.id: r for r in plans.collect()}
    assert [got[i].plan_source for i in range(6)] == ["reply", "reply", "rule", "rule", "reply", "rule"]
    assert got[0].elements_to_preserve == ["Paris trip", "Rome", "story"] and got[0].elements_to_change == rule[0].elements_to_change
    assert got[1].elements_to_change == [] and got[1].elements_to_preserve == rule[1].elements_to_preserve
    assert got[4].causal_features == ["a", "b"] and got[4].target_label == rule[4].target_label
    assert all(tuple(got[i][:-1]) == tuple(rule[i]) for i in (2, 3, 5))
    scores = plans.join(samples.select("id", "text"), "id").select("id", consistency_score(F.col("text"), F.col("text"), F.col("elements_to_preserve")))
    assert abs(dict(map(tuple, scores.collect()))[0] - 2 / 3) < 1e-9


def test_reply_plans_query_scores_the_lists(spark, tmp_path):
    """The query as registered: lists joined into strings, scores of the lists."""
    from flipside.plans.queries import c6_reply_plans
    texts = [f"Berlin remarkable story number{i} about plain things" for i in range(60)] + [None, ""]
    spark.createDataFrame([(i, t, "en", "web", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long"
                          ).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = c6_reply_plans(spark, str(tmp_path)).collect()
    assert {r.id for r in rows} >= set(range(60)) and {r.plan_source for r in rows} == {"reply", "rule"}
    seen = {(r.elements_to_preserve, r.consistency_score) for r in rows if r.id < 60}
    assert {("Berlin", 1.0), ("Berlin|Berlin two|named|plain", 0.75), ("", 0.8)} <= seen and len(seen) == 4
    (rule, score), = [x for x in seen if x[0] not in ("Berlin", "Berlin|Berlin two|named|plain", "")]
    items = rule.split("|")
    assert score == round(sum(x.lower().split()[0] in texts[0].lower() for x in items) / len(items), 4)


def test_model_plans_reach_prompts_and_scores(spark):
    from flipside.params import MULTI_STAGE
    from flipside.plans.queries import _model, _train
    from flipside.plans.rounds import augment_rounds_with_model

    def factory():
        def fn(stage, prompt):
            if stage == "planner":
                return '{"elements_to_preserve": ["zzz-not-there"]}'
            return json.dumps({"candidates": ["plan seen" if "zzz-not-there" in prompt else "no plan"]})
        return fn

    root = "/root/testdata/sf0.001"
    res = augment_rounds_with_model(_train(spark, root), factory, _model(spark, root), MULTI_STAGE.with_(max_retry_rounds=0),
                                    max_retries=0, backoff=0, plan_with_model=True)
    rows = res.verifications.select("cand_text", "consistency_score").distinct().collect()
    assert [tuple(r) for r in rows] == [("plan seen", 0.0)]
