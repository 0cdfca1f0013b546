"""Model calls and response parsing as Spark jobs.

* C5 runs a caller-supplied completion function per partition
  (``mapInPandas``); the function is built once per partition by a factory,
  retried with exponential back-off, and failures become rows (``error``),
  never task failures. Replies are lazy like any plan: write them once
  (``sources.stages``) before parsing, or the model is called again per read.
* D1 is one Arrow function per reply (JSON over balanced top-level blocks);
  D2-D5 are column expressions. What D1 reads, they read: an object that
  Spark's parser would refuse (NaN, a key twice, very deep nesting) is written
  anew by D1.
"""

from __future__ import annotations

import json
import math
import re
import time
from functools import reduce
from typing import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

RESPONSE_SCHEMA = ("request_id string, id bigint, stage string, round int, content string, "
                   "error string, attempts int")
LOGGED_SCHEMA = RESPONSE_SCHEMA + ", call_times array<double>"
PREVIEW_CHARS = 400


def batch_complete(prompts: DataFrame, factory: Callable[[], Callable[[str, str], str]],
                   max_retries: int = 3, backoff: float = 1.0, partitions: int | None = None, log: bool = False) -> DataFrame:
    """One completion per prompt row (request_id, id, stage, round, prompt).

    ``factory()`` runs once per partition and returns ``fn(stage, prompt) -> str``.
    An empty reply counts as a failure and is retried; after max_retries the
    row carries the last error. ``partitions`` bounds concurrency (and so the
    request rate) across the cluster. ``log`` adds call_times, the time of every
    attempt (see ``call_log``)."""
    src = prompts.repartition(partitions, "id") if partitions else prompts

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = factory()
        for pdf in batches:
            contents, errors, attempts, times = [], [], [], []
            for stage, prompt in zip(pdf["stage"], pdf["prompt"]):
                content, err, n = None, None, 0
                times.append([])
                for attempt in range(max_retries + 1):
                    n = attempt + 1
                    times[-1].append(time.time())
                    try:
                        out = fn(stage, prompt)
                        if out is None or not str(out).strip():
                            raise ValueError("empty reply")
                        content, err = str(out), None
                        break
                    except Exception as exc:  # noqa: BLE001 - failures become rows
                        err = f"{type(exc).__name__}: {exc}"
                        if attempt < max_retries and backoff > 0:
                            time.sleep(backoff * (2 ** attempt))
                contents.append(content)
                errors.append(err)
                attempts.append(n)
            yield pd.DataFrame({
                "request_id": pdf["request_id"], "id": pdf["id"], "stage": pdf["stage"],
                "round": pdf["round"].astype("int32"), "content": contents, "error": errors,
                "attempts": pd.Series(attempts, dtype="int32"), **({"call_times": times} if log else {}),
            })

    return src.select("request_id", "id", "stage", "round", "prompt").mapInPandas(run, LOGGED_SCHEMA if log else RESPONSE_SCHEMA)


def call_log(replies: DataFrame, model: str) -> DataFrame:
    """One row per call of logged, written replies, for C7: ts, stage, model, request_id, attempt, outcome (ok or
    failed). The times come from the table that holds the replies, so what a lost task had called before it was run
    again leaves no rows."""
    calls = replies.select("request_id", "stage", "content", "attempts", F.posexplode("call_times").alias("_pos", "_at"))
    return calls.select(F.timestamp_seconds("_at").alias("ts"), "stage", F.lit(model).alias("model"), "request_id", (F.col("_pos") + 1).alias("attempt"),
                        F.when((F.col("_pos") + 1 == F.col("attempts")) & F.col("content").isNotNull(), "ok").otherwise("failed").alias("outcome"))


# ---- D1 -----------------------------------------------------------------------------------------------

# Fixed value: a reply may wrap its object in a Markdown code fence, with or without the word json.
_FENCED = re.compile(r"```(?:json)?\s*(\{.*?\})\s*```", re.DOTALL)
_STRUCTURE = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?\Z)|[{}]', re.DOTALL)


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def top_level_blocks(text: str) -> Iterator[str]:
    """The balanced {...} blocks of a text that lie in no other block; braces
    inside strings do not count. An unclosed block ends the search: what is
    inside it is part of a truncated object."""
    at = text.find("{")
    while at >= 0:
        depth, end = 0, None
        for token in _STRUCTURE.finditer(text, at):
            depth += {"{": 1, "}": -1}.get(token[0], 0)
            if depth == 0:
                end = token.end()
                break
        if end is None:
            return
        yield text[at:end]
        at = text.find("{", end)


MAX_DEPTH = 200   # what lies deeper in an object is written as null


def _shallow(value, depth: int = 0):
    """A value whose lists and objects end at MAX_DEPTH."""
    if depth >= MAX_DEPTH and isinstance(value, (dict, list)):
        return None
    if isinstance(value, dict):
        return {k: _shallow(v, depth + 1) for k, v in value.items()}
    return [_shallow(v, depth + 1) for v in value] if isinstance(value, list) else value


def read_object(text: str) -> str | None:
    """The text of a JSON object as Spark's parser takes it: as it is, or, where only Python takes it, written anew
    with the last value of a key that comes twice and null for numbers that aren't finite. None where it is no object."""
    odd = []

    def members(pairs):
        found = dict(pairs)
        if len(found) < len(pairs):
            odd.append("keys")
        return found

    def number(digits):
        value = float(digits)
        if not math.isfinite(value):
            odd.append("number")
            return None
        return value

    try:
        value = json.loads(text, object_pairs_hook=members, parse_float=number, parse_constant=number)
    except (ValueError, RecursionError):
        return None
    if not isinstance(value, dict):
        return None
    if odd or text.count("{") + text.count("[") > MAX_DEPTH:
        return json.dumps(_shallow(value))
    return text


def parse_reply(content: str | None) -> tuple[str | None, str]:
    """(object text, status) of one reply."""
    if content is None:
        return None, "failed_call"
    text = content.strip()
    if fenced := _FENCED.search(text):
        text = fenced[1]
    if text.startswith("{") and text.endswith("}") and (whole := read_object(text)) is not None:
        return whole, "ok"
    found = next((o for o in map(read_object, top_level_blocks(text)) if o is not None), None)
    return found, "error" if found is None else "scanned"


_PARSED = pa.struct([("json", pa.string()), ("parse_status", pa.string())])


@F.arrow_udf(StructType().add("json", "string").add("parse_status", "string"))
def _parse(contents: pa.Array) -> pa.Array:
    # a reply at a time leaves Arrow, and a few go back together: a batch's replies aren't held as Python objects
    def parsed(some: pa.Array) -> pa.Array:
        return pa.array([dict(zip(("json", "parse_status"), parse_reply(c.as_py()))) for c in some], _PARSED)
    return pa.concat_arrays([parsed(contents.slice(at, 256)) for at in range(0, max(1, len(contents)), 256)])


def extract_json(responses: DataFrame) -> DataFrame:
    """Adds `json` (the object text) and `parse_status` in
    {ok, scanned, error, failed_call}: a code fence is unwrapped, the whole
    text is tried as JSON, then each balanced top-level block in turn. Where it is ok or scanned, D3 and D4 can read it."""
    return responses.withColumn("_p", _parse("content")).select(
        *responses.columns, F.col("_p.json").alias("json"), F.col("_p.parse_status").alias("parse_status"))


# ---- D2 -----------------------------------------------------------------------------------------------

_KEY = r'"candidate_id"\s*:\s*"([^"]+)"'
# One JSON string value, up to its closing quote or the end of the input; only whole escapes count.
# Possessive, so that long texts are matched in a loop and not by recursion.
_VALUE = r'"text"\s*:\s*"((?:[^"\\]++|\\u[0-9a-fA-F]{4}|\\[^u])*+)'


def _decoded(raw: Column) -> Column:
    """The text of a JSON string's inside, white space collapsed."""
    plain = F.regexp_replace(raw, r"[\x00-\x1f]+", " ")
    text = F.get_json_object(F.concat(F.lit('{"t":"'), plain, F.lit('"}')), "$.t")
    return _strip(F.regexp_replace(text, r"\s+", " "))


def _pairs(parts: Column) -> Column:
    """(candidate_id, text) of the parts that have both."""
    pair = F.transform(parts, lambda part: F.struct(
        _strip(F.regexp_extract(part, _KEY, 1)).alias("candidate_id"), _decoded(F.regexp_extract(part, _VALUE, 1)).alias("text")))
    return F.filter(pair, lambda x: (x["candidate_id"] != "") & (x["text"] != ""))


def salvage_candidates(responses: DataFrame) -> DataFrame:
    """Truncated generator output -> (request_id, id, round, pos,
    candidate_id, text). The text is cut at every `"candidate_id":`, and each
    part gives the id and the string after `"text":`, as far as it goes. When
    no part has both, lines that have both (in any order) are used. Duplicates
    (same id and text) keep the first; pos is the order of the rest."""
    body = F.regexp_replace(F.col("content"), r"```(?:json)?", "")
    by_id = _pairs(F.split(body, r'(?="candidate_id"\s*:)'))
    by_line = _pairs(F.split(body, r"\R"))
    pairs = F.array_distinct(F.when(F.size(by_id) > 0, by_id).otherwise(by_line))
    return responses.select("request_id", "id", "round", F.posexplode(pairs).alias("pos", "_c")).select(
        "request_id", "id", "round", "pos", "_c.candidate_id", "_c.text")


# ---- D3 / D4 -------------------------------------------------------------------------------------------

# The field names under which replies carry a text, in order of preference.
ITEM_KEYS = ("text", "candidate", "output")
TEXT_KEYS = ("text", "counterfactual", "candidate", "prediction", "output")
PLAN_ITEM_KEYS = ("text", "token", "name")
PLAN_LISTS = ("causal_features", "spurious_features", "elements_to_change", "elements_to_preserve", "editing_constraints")
# JSON values that count as absent.
_ABSENT = ("null", '""', "0", "0.0", "false", "[]", "{}")


def _field(obj: Column, key: str) -> Column:
    """A field as a variant, null when absent or empty."""
    value = F.variant_get(obj, f"$.{key}", "variant")
    return F.when(~F.to_json(value).isin(*_ABSENT), value)


def _string(value: Column) -> Column:
    """A variant's string without outer white space; null for other kinds and blanks."""
    text = F.when(F.schema_of_variant(value) == "STRING", _strip(F.variant_get(value, "$", "string")))
    return F.when(text != "", text)


def _items(obj: Column) -> Column:
    """The candidates as variants; null unless they are a list."""
    return F.try_variant_get(obj, "$.candidates", "array<variant>")


def _item_text(item: Column, keys: tuple[str, ...] = ITEM_KEYS) -> Column:
    """The text of a list's item: a string, or an object's first present field if that is a string."""
    first = F.coalesce(*[_field(item, k) for k in keys])
    return F.when(F.schema_of_variant(item).startswith("OBJECT"), _string(first)).otherwise(_string(item))


def _item_id(item: Column, index: Column) -> Column:
    own = F.when(F.schema_of_variant(item).startswith("OBJECT"), F.variant_get(_field(item, "candidate_id"), "$", "string"))
    return F.coalesce(own, F.concat(F.lit("c"), (index + 1).cast("string")))


def normalize_candidates(parsed: DataFrame) -> DataFrame:
    """D3: parsed objects -> one row per usable candidate (request_id, id,
    round, pos, candidate_id, text). Elements may be strings or objects; an
    object's text is the first of text / candidate / output that is present
    (not null or empty), and must be a string; the id comes from candidate_id
    else c<raw index>; blank texts are skipped; when none is usable,
    `prediction` becomes c1."""
    obj = F.try_parse_json(F.col("json"))
    found = F.filter(F.transform(_items(obj), lambda item, i: F.struct(
        i.alias("pos"), _item_id(item, i).alias("candidate_id"), _item_text(item).alias("text"))),
        lambda c: c["text"].isNotNull())
    predicted = F.array(F.struct(F.lit(0).alias("pos"), F.lit("c1").alias("candidate_id"),
                                 _string(F.variant_get(obj, "$.prediction", "variant")).alias("text")))
    usable = F.when(F.coalesce(F.size(found), F.lit(0)) > 0, found).otherwise(predicted)
    rows = parsed.filter(F.col("json").isNotNull()).select("request_id", "id", "round", F.explode(usable).alias("_c"))
    return rows.filter(F.col("_c.text").isNotNull()).select(
        "request_id", "id", "round", F.col("_c.pos").cast("int").alias("pos"), "_c.candidate_id", "_c.text")


def first_text(parsed: DataFrame) -> DataFrame:
    """First non-blank of text / counterfactual / candidate / prediction /
    output, else the first candidate (string, or object's text / candidate /
    output); '' when nothing usable."""
    obj = F.try_parse_json(F.col("json"))
    direct = F.coalesce(*[_string(F.variant_get(obj, f"$.{k}", "variant")) for k in TEXT_KEYS])
    first = F.try_element_at(_items(obj), F.lit(1))
    of_first = F.coalesce(_string(first), *[
        F.when(F.schema_of_variant(first).startswith("OBJECT"), _string(F.variant_get(first, f"$.{k}", "variant"))) for k in ITEM_KEYS])
    return parsed.select("request_id", "id", F.coalesce(direct, of_first, F.lit("")).alias("first_text"))


def plans_from_replies(parsed: DataFrame, fallback: DataFrame) -> DataFrame:
    """Planner replies as plans: ``fallback`` (C1 or C2, a row an id) with each list that the id's reply has.

    A list's items may be strings, or objects with text, token or name; other and blank items are left out. Where a
    field is missing or no list, and where there is no readable reply, the fallback's list stays; plan_source says
    whether any list is the reply's (reply or rule). The target label is the fallback's, whatever the reply says. Of
    several replies of an id, the one with the smallest request_id counts."""
    obj = F.try_parse_json("json")
    said = [F.filter(F.transform(F.try_variant_get(obj, f"$.{name}", "array<variant>"), lambda item: _item_text(item, PLAN_ITEM_KEYS)),
                     lambda x: x.isNotNull()).alias(name) for name in PLAN_LISTS]
    replies = parsed.where(F.col("json").isNotNull()).select("id", "request_id", F.struct(*said).alias("_said"))
    replies = replies.groupBy("id").agg(F.min_by("_said", "request_id").alias("_said"))
    own = reduce(lambda x, y: x | y, [F.col(f"_said.{name}").isNotNull() for name in PLAN_LISTS])
    lists = {name: F.coalesce(F.col(f"_said.{name}"), F.col(name)) for name in PLAN_LISTS}
    return fallback.join(replies, "id", "left").withColumns({"plan_source": F.when(own, "reply").otherwise("rule"), **lists}).drop("_said")


def parse_report(parsed: DataFrame) -> DataFrame:
    """Counts per parse status."""
    return parsed.groupBy("parse_status").agg(F.count(F.lit(1)).alias("n"))


def parse_rejects(parsed: DataFrame) -> DataFrame:
    """Unreadable replies with a fixed-length preview (newlines escaped)."""
    return parsed.filter(F.col("json").isNull()).select(
        "request_id", "parse_status", F.col("error"),
        F.replace(F.substring(F.coalesce("content", F.lit("")), 1, PREVIEW_CHARS), F.lit("\n"), F.lit("\\n")).alias("preview"))


# ---- C6 ------------------------------------------------------------------------------------------------

REPAIR_TEMPLATE = ("Rewrite the following reply as one valid JSON object only, shaped like {schema}.\n"
                   "Reply:\n{reply}")
SCHEMA_HINTS = {
    "planner": '{"id": "...", "target_label": 0, "elements_to_change": ["..."], "elements_to_preserve": ["..."]}',
    "generator": '{"candidates": [{"candidate_id": "c1", "text": "..."}]}',
}


def repair_requests(parsed: DataFrame) -> DataFrame:
    """A second prompt for every unreadable reply (same request key with a
    `:repair` suffix), ready for batch_complete."""
    bad = parsed.filter(F.col("json").isNull() & F.col("content").isNotNull())
    hint = F.coalesce(*[F.when(F.col("stage") == k, F.lit(v)) for k, v in SCHEMA_HINTS.items()], F.lit("{}"))
    prompt = F.replace(F.replace(F.lit(REPAIR_TEMPLATE), F.lit("{schema}"), hint), F.lit("{reply}"), F.col("content"))
    return bad.select(F.concat("request_id", F.lit(":repair")).alias("request_id"), "id", "stage", "round",
                      prompt.alias("prompt"))


def merge_repaired(parsed: DataFrame, repaired_parsed: DataFrame) -> DataFrame:
    """Replace unreadable rows by their repaired parse when it succeeded."""
    fixed = (repaired_parsed.filter(F.col("json").isNotNull())
             .withColumn("request_id", F.regexp_replace("request_id", ":repair$", ""))
             .withColumn("parse_status", F.lit("repaired")))
    keep = parsed.join(fixed.select("request_id"), "request_id", "left_anti")
    return keep.unionByName(fixed.select(*parsed.columns))


def complete_candidates(prompts: DataFrame, factory: Callable[[], Callable[[str, str], str]], max_retries: int = 3,
                        backoff: float = 1.0, partitions: int | None = None, log_dir: str | None = None, model: str = "model") -> DataFrame:
    """C5, D1, C6, D2 and D3 of generator prompts: one row per usable candidate, like D3's.

    A reply that can't be read is asked for again in JSON; where that answer can't be read either, candidates are
    salvaged from it, or from the reply if there was no answer; where there are none, the prompt itself is asked
    again, up to ``max_retries`` times. Calls that fail have had as many tries inside their task. Replies are written
    as they come, so every call is made once however often its reply is read, and only prompts without a result
    go on to the next pass; the loop is over passes, not over rows. ``log_dir``: where the call log is appended."""
    from ..sources.stages import written

    call = dict(max_retries=max_retries, backoff=backoff, partitions=partitions, log=log_dir is not None)
    pending, found = prompts, []
    for attempt in range(max_retries + 1):
        parsed = written(extract_json(batch_complete(pending, factory, **call)), "replies")
        repaired = written(extract_json(batch_complete(repair_requests(parsed), factory, **call)), "repaired")
        if log_dir:
            call_log(parsed, model).unionByName(call_log(repaired, model)).write.mode("append").parquet(log_dir)
        merged = merge_repaired(parsed, repaired)
        answer = repaired.select(F.regexp_replace("request_id", ":repair$", "").alias("request_id"), F.col("content").alias("_answer"))
        unread = merged.where(F.col("json").isNull() & F.col("content").isNotNull()).join(answer, "request_id", "left")
        salvaged = written(salvage_candidates(unread.withColumn("content", F.coalesce("_answer", "content"))), "salvaged")
        found += [normalize_candidates(merged), salvaged]
        lost = unread.join(salvaged.select("request_id").distinct(), "request_id", "left_anti")
        pending = written(pending.join(lost.select("request_id"), "request_id", "left_semi"), "pending")
        if attempt == max_retries or pending.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)
