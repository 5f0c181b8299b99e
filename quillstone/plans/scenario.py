"""Scenarios: reading, defaults, validation, introspection, and replay over recorded responses.

A scenario is a document of ordered steps with conditions, branches, retries, extractions and assertions. No traffic
is sent: a run's recorded responses, one per step and attempt, are walked by the step machine, one run at a
time, in groups of rows bounded by a run.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import duration_ns
from ..registry import Registry
from ..shared import folded, shared_folder
from ..views import table

R = Registry()

RULE = "struct<name:string,type:string,pattern:string,group:int,default:string>"
CHECK = "struct<type:string,target:string,expected:string,negate:boolean>"
STEP = (
    "struct<name:string,request:struct<method:string,url:string,headers:map<string,string>,body:string,content_type:string,timeout:string>,"
    f"extract:array<{RULE}>,assert:array<{CHECK}>,on_success:string,on_failure:string,condition:string,delay:string,"
    "retry:struct<count:int,delay:string,on_status:array<int>>,tags:array<string>>"
)
SCENARIO = f"struct<name:string,description:string,version:string,variables:map<string,string>,steps:array<{STEP}>>"
MOST_STEPS = 100


def yaml_to_json(text: str) -> str | None:
    """A YAML document as JSON; null where it does not parse or no YAML reader is installed."""
    try:
        import yaml
    except ImportError:
        return None
    try:
        return json.dumps(yaml.safe_load(text), default=str)
    except yaml.YAMLError:
        return None


def read_scenarios(spark: SparkSession, path: str, strict: bool = False, names: str = "*.{yaml,yml,json}") -> DataFrame:
    """(path, scenario) of a YAML or JSON file, or of those in a folder whose names fit; strict leaves out documents with unknown keys."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter=names).select(F.input_file_name().alias("path"), F.col("value").alias("text"))

    def convert(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([yaml_to_json(t) for t in texts], dtype=object)

    convert.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    as_json = F.when(F.try_parse_json("text").isNotNull(), F.col("text")).otherwise(F.pandas_udf(convert, "string")("text"))
    rows = files.withColumn("json", as_json)
    if strict:
        known = {"name", "description", "version", "variables", "steps"}
        keys = F.json_object_keys("json")
        rows = rows.where(F.size(F.array_except(keys, F.array(*[F.lit(k) for k in sorted(known)]))) == 0)
    return rows.select("path", F.from_json("json", SCENARIO).alias("scenario")).where("scenario is not null")


def inferred_content_type(body: Column) -> Column:
    start = F.ltrim(body)
    return F.when(start.rlike(r"^[{\[]"), "application/json").when(start.startswith("<"), "application/xml").when(start.contains("="), "application/x-www-form-urlencoded").otherwise("text/plain")


def with_defaults(steps: DataFrame) -> DataFrame:
    """steps (scenario, position, s) as flat rows with defaults: GET, 30 s, a content type from the body, three retries a second apart."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    body = F.col("s.request.body")
    return steps.select(
        "scenario",
        "position",
        F.col("s.name").alias("name"),
        F.upper(F.coalesce(blank("s.request.method"), F.lit("GET"))).alias("method"),
        F.col("s.request.url").alias("url"),
        F.coalesce(duration_ns(F.col("s.request.timeout")), F.lit(30_000_000_000)).alias("timeout_ns"),
        F.coalesce(blank("s.request.content_type"), F.when(blank(body).isNotNull(), inferred_content_type(body))).alias("content_type"),
        F.when(F.col("s.retry").isNotNull(), F.coalesce(F.nullif("s.retry.count", F.lit(0)), F.lit(3))).otherwise(0).alias("retries"),
        F.when(F.col("s.retry").isNotNull(), F.coalesce(duration_ns(F.col("s.retry.delay")), F.lit(1_000_000_000))).alias("retry_delay_ns"),
        blank("s.on_success").alias("on_success"),
        blank("s.on_failure").alias("on_failure"),
        blank("s.condition").alias("condition"),
    )


def step_rows(scenarios: DataFrame, key: str) -> DataFrame:
    return scenarios.select(F.col(key).alias("scenario"), F.posexplode("scenario.steps").alias("position", "s")) if key != "scenario" else scenarios


def violations(steps: DataFrame) -> DataFrame:
    """(scenario, problem, step) of flat steps: missing names, methods or urls, repeated names, unknown branch targets."""
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    missing = F.array(*[F.when(empty(c), F.lit(f"{c} is required")) for c in ("name", "method", "url")])
    first = steps.select("scenario", F.explode(F.filter(missing, lambda x: x.isNotNull())).alias("problem"), F.col("name").alias("step"))
    repeated = steps.groupBy("scenario", "name").agg(F.count("*").alias("n")).where("n > 1").select("scenario", F.lit("duplicate step name").alias("problem"), F.col("name").alias("step"))
    targets = steps.select("scenario", F.col("name").alias("step"), F.explode(F.filter(F.array("on_success", "on_failure"), lambda x: x.isNotNull())).alias("target"))
    unknown = targets.join(steps.select("scenario", F.col("name").alias("target")).distinct(), ["scenario", "target"], "left_anti")
    return first.unionByName(repeated).unionByName(unknown.select("scenario", F.lit("unknown branch target").alias("problem"), "step"))


def step_index(steps: Column, name: str) -> Column:
    """The first step with a name, from 0; -1 if there is none."""
    return F.array_position(F.transform(steps, lambda s: s["name"]), name).cast("int") - 1


def has_conditional_flow(steps: Column) -> Column:
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.exists(steps, lambda s: filled(s["condition"]) | filled(s["on_success"]) | filled(s["on_failure"]))


# --- The step machine -------------------------------------------------------------------------------------------


def condition_holds(condition: str, variables: dict[str, str]) -> bool:
    """`!c`, `exists:x`, `a == b`, `a != b`, else whether the variable is set to something but `false` and `0`."""
    c = condition.strip()
    if c.startswith("!"):
        return not condition_holds(c[1:], variables)
    if c.startswith("exists:"):
        return c[7:].strip() in variables
    value = lambda x: variables.get(x.strip(), x.strip().strip("\"'"))
    for sign, equal in (("!=", False), ("==", True)):
        if sign in c:
            left, right = c.split(sign, 1)
            return (value(left) == value(right)) is equal
    found = variables.get(c, "")
    return found not in ("", "false", "0")


def _check(check: dict, response: dict) -> bool:
    kind, expected, body = check["type"], check.get("expected") or "", response["body"] or ""
    found = {
        "status": lambda: expected.isdigit() and response["status_code"] == int(expected),
        "contains": lambda: expected in body,
        "not_contains": lambda: expected not in body,
        "regex": lambda: re.search(expected, body) is not None,
        "length": lambda: expected.lstrip("-").isdigit() and len(body.encode()) == int(expected),
    }.get(kind, lambda: False)()
    return found != bool(check.get("negate"))


def extracted_value(rule: dict, response: dict) -> str | None:
    """What a step's rule finds in a response: a match of a regex, a JSON path, a header whatever its case, or a cookie; None if nothing."""
    kind, pattern, body = rule["type"], rule["pattern"], response["body"] or ""
    if kind == "regex":
        m = re.search(pattern, body)
        return m.group(rule.get("group") or 0) if m else None
    if kind == "header":
        return next((v for k, v in sorted((response.get("headers") or {}).items()) if k.lower() == pattern.lower()), None)
    if kind == "cookie":
        return (response.get("cookies") or {}).get(pattern)
    if kind != "jsonpath":
        return None
    try:
        value = json.loads(body)
        for part in pattern.removeprefix("$.").split("."):
            value = value[int(part)] if isinstance(value, list) else value[part]
    except (ValueError, KeyError, IndexError, TypeError):
        return None
    return value if isinstance(value, str) else None if value is None else json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def walk(steps: list[dict], responses: dict[tuple[str, int], dict], variables: dict[str, str] | None = None, most: int = MOST_STEPS, on_step: Callable[[dict], None] | None = None) -> tuple[list[dict], bool, str]:
    """Walk one run: the steps taken, whether it succeeded, and the error.

    A skipped step counts towards the limit, and reaching the limit is a failure even at the last step. Attempts
    beyond the recorded ones repeat the last recorded response.
    """
    variables, taken, at, count = dict(variables or {}), [], 0, 0
    where: dict[str, int] = {}
    for k, s in enumerate(steps):
        where.setdefault(s["name"], k)
    error = ""
    while at < len(steps) and count < most:
        step = steps[at]
        count += 1
        if step.get("condition") and not condition_holds(step["condition"], variables):
            at += 1
            continue
        retry = step.get("retry") or {}
        response, ok, attempt = None, False, 0
        for attempt in range((retry.get("count") or 0) + 1):
            response = responses.get((step["name"], attempt), response)
            ok = response is not None and all(_check(c, response) for c in step.get("assert") or [])
            if ok or response is None or (retry.get("on_status") and response["status_code"] not in retry["on_status"]):
                break
        if response is not None:
            for rule in step.get("extract") or []:
                if (value := extracted_value(rule, response)) is not None:
                    variables[rule["name"]] = value
        result = {"step": step["name"], "order": len(taken), "success": ok, "retries": attempt, "status_code": response["status_code"] if response else None}
        taken.append(result)
        if on_step:
            on_step(result)
        target = step.get("on_success") if ok else step.get("on_failure")
        if target and target in where:
            at = where[target]
            continue
        if not ok:
            error = f"step '{step['name']}' failed"
            break
        at += 1
    if count >= most:
        return taken, False, "max steps exceeded (possible infinite loop)"
    return taken, not error, error


def replay(recorded: DataFrame, steps: list[dict], variables: dict[str, str] | None = None, most: int = MOST_STEPS) -> DataFrame:
    """(run_id, step, order, success, retries, status_code, run_success, error) for recorded rows (run_id, step_name, attempt, status_code, body).

    Rows may have headers and cookies (maps) as well. Runs are walked one after the other in sorted partitions; one run's
    responses are held at a time.
    """

    def keep(state: dict, row: dict) -> list[dict]:
        response = {"status_code": int(row["status_code"]), "body": row["body"]}
        response |= {c: dict(row[c] or {}) for c in ("headers", "cookies") if c in row}
        state.setdefault((row["step_name"], int(row["attempt"])), response)
        return []

    def finish(state: dict) -> list[dict]:
        taken, ok, error = walk(steps, state, variables, most)
        rows = taken or [{"step": None, "order": 0, "success": False, "retries": 0, "status_code": None}]
        return [r | {"run_success": ok, "error": error} for r in rows]

    return folded(recorded, "run_id", ["step_name", "attempt"], keep, "step string, order int, success boolean, retries int, status_code int, run_success boolean, error string", finish)


# --- Queries ----------------------------------------------------------------------------------------------------


def _scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scenario per nation, as JSON: some lack a name, repeat one or point nowhere."""
    k = F.col("n_nationkey")
    step = lambda name, extra="": F.concat(F.lit('{"name":"'), name, F.lit('","request":{"url":"https://x/","body":"a=1","timeout":"1m30s"}'), F.lit(extra), F.lit("}"))
    second = F.when(k % 4 == 0, F.lit("login")).when(k % 4 == 1, F.lit("")).otherwise(F.lit("read"))
    text = F.concat(F.lit('{"name":"s'), k, F.lit('","steps":['), step(F.lit("login"), ',"retry":{"delay":"2s"}'), F.lit(","), step(second, ',"on_failure":"nowhere"'), F.lit("]}"))
    return table(spark, sf_dir, "nation").select(k.alias("id"), F.from_json(text, SCENARIO).alias("scenario"))


@R.query("scenario_defaults", """SELECT n_nationkey AS scenario, CAST(p AS INTEGER) AS position, 'GET' AS method, CAST(90000000000 AS BIGINT) AS timeout_ns, 'application/x-www-form-urlencoded' AS content_type, CAST(CASE WHEN p = 0 THEN 3 ELSE 0 END AS INTEGER) AS retries, CASE WHEN p = 0 THEN CAST(2000000000 AS BIGINT) END AS retry_delay_ns FROM nation, range(2) r(p)""")
def scenario_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_defaults(step_rows(_scenarios(spark, sf_dir), "id"))
    return rows.select("scenario", "position", "method", "timeout_ns", "content_type", "retries", "retry_delay_ns")


@R.query("scenario_violations", """SELECT n_nationkey AS scenario, 'duplicate step name' AS problem, 'login' AS step FROM nation WHERE n_nationkey % 4 = 0 UNION ALL SELECT n_nationkey, 'name is required', '' FROM nation WHERE n_nationkey % 4 = 1
UNION ALL SELECT n_nationkey, 'unknown branch target', CASE n_nationkey % 4 WHEN 0 THEN 'login' WHEN 1 THEN '' ELSE 'read' END FROM nation""")
def scenario_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return violations(with_defaults(step_rows(_scenarios(spark, sf_dir), "id")))


@R.query("scenario_introspection", """SELECT n_nationkey AS id, CAST(CASE WHEN n_nationkey % 4 IN (2, 3) THEN 1 ELSE -1 END AS INTEGER) AS read_index, true AS conditional FROM nation""")
def scenario_introspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scenarios(spark, sf_dir)
    return s.select("id", step_index(F.col("scenario.steps"), "read").alias("read_index"), has_conditional_flow(F.col("scenario.steps")).alias("conditional"))


#: A conversation as a scenario: its first turn must be long, then short ones branch.
STEPS = [
    {"name": "0", "assert": [{"type": "contains", "expected": "."}], "on_failure": "2"},
    {"name": "1", "assert": [{"type": "not_contains", "expected": "zzzz"}], "condition": "!exists:stop"},
    {"name": "2", "assert": [{"type": "status", "expected": "200"}]},
]


@R.query("scenario_replay", """WITH t AS (SELECT conv_id, max(CASE WHEN turn = 0 THEN text END) AS a, max(CASE WHEN turn = 1 THEN text END) AS b, count(*) FILTER (turn = 2) AS c FROM conversations GROUP BY 1)
SELECT conv_id AS run_id, coalesce(contains(a, '.'), false) AND b IS NOT NULL AND NOT contains(b, 'zzzz') AND c > 0 OR (NOT coalesce(contains(a, '.'), false) AND c > 0) AS run_success FROM t""")
def scenario_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("turn < 3")
    recorded = c.select(F.col("conv_id").alias("run_id"), F.col("turn").cast("string").alias("step_name"), F.lit(0).alias("attempt"), F.lit(200).alias("status_code"), F.col("text").alias("body"))
    return replay(recorded, STEPS).groupBy("run_id").agg(F.bool_and("run_success").alias("run_success"))


#: Steps that go on what the first one extracted: a JSON path, a header and a cookie.
EXTRACTING = [
    {"name": "login", "extract": [{"name": "k", "type": "jsonpath", "pattern": "k"}, {"name": "kind", "type": "header", "pattern": "x-kind"}, {"name": "sid", "type": "cookie", "pattern": "sid"}, {"name": "none", "type": "cookie", "pattern": "absent"}]},
    {"name": "second", "condition": "k == 7"},
    {"name": "third", "condition": "kind == click"},
    {"name": "fourth", "condition": "sid != 5"},
    {"name": "fifth", "condition": "exists:none"},
]


@R.query("scenario_extraction", """SELECT event_id AS run_id, step, true AS run_success FROM events, (VALUES ('login'), ('second'), ('third'), ('fourth')) s(step)
WHERE step = 'login' OR (step = 'second' AND props->>'$.k' = '7') OR (step = 'third' AND event_type = 'click') OR (step = 'fourth' AND user_id <> 5)""")
def scenario_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run for each event, whose first response is the event and whose others are empty."""
    e = table(spark, sf_dir, "events")
    names = F.array(*[F.lit(s["name"]) for s in EXTRACTING])
    first = F.col("step_name") == "login"
    rows = e.select("event_id", "props", "event_type", "user_id", F.explode(names).alias("step_name"))
    none = F.create_map().cast("map<string,string>")
    recorded = rows.select(
        F.col("event_id").alias("run_id"), "step_name", F.lit(0).alias("attempt"), F.lit(200).alias("status_code"), F.when(first, F.col("props")).otherwise("").alias("body"),
        F.when(first, F.create_map(F.lit("X-Kind"), "event_type")).otherwise(none).alias("headers"), F.when(first, F.create_map(F.lit("sid"), F.col("user_id").cast("string"))).otherwise(none).alias("cookies"),
    )
    return replay(recorded, EXTRACTING).select("run_id", "step", "run_success")


@R.query("scenario_files", """SELECT n_nationkey AS id, 's' || n_nationkey AS name, CAST(2 AS INTEGER) AS steps FROM nation WHERE n_nationkey % 5 <> 4""")
def scenario_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenarios written as files in YAML and JSON and read strictly from their folder: those with an unknown key are left out."""
    k = F.col("n_nationkey")
    yaml = F.concat(F.lit("name: s"), k, F.lit("\nsteps:\n  - name: a\n    request: {url: 'https://x/'}\n  - name: b\n"))
    json_ = F.concat(F.lit('{"name":"s'), k, F.lit('","steps":[{"name":"a"},{"name":"b"}]}'))
    text = F.when(k % 5 == 4, F.concat(yaml, F.lit("surplus: 1\n"))).when(k % 2 == 0, yaml).otherwise(json_)
    folder = f"{shared_folder(spark)}/scenarios-{uuid.uuid4().hex}"
    files = table(spark, sf_dir, "nation").select(k.cast("string").alias("n"), text.alias("value"))
    files.repartition(25, "n").write.partitionBy("n").text(folder)
    read = read_scenarios(spark, f"{folder}/*/*.txt", strict=True, names="*")
    return read.select(F.regexp_extract("path", "n=([0-9]+)", 1).cast("int").alias("id"), F.col("scenario.name").alias("name"), F.size("scenario.steps").alias("steps"))
