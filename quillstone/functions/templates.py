"""Template strings: placeholders with defaults, conditionals and functions, resolved from variables, a pool and the environment."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import Registry
from ..views import table

R = Registry()

_CALL = re.compile(r"\{\{(\w+)\(([^)]*)\)\}\}")
_CHOICE = re.compile(r"\{\{\?([^|}]*)\|([^|}]*)\|([^}]*)\}\}")
_NAME = re.compile(r"\{\{(\w[\w.-]*)(?::([^}]*))?\}\}")


def _seeded(seed: str, n: int, alphabet: str) -> str:
    """n characters of an alphabet, fixed by a seed, so that a task that runs twice gives the same text."""
    out, block = [], 0
    while len(out) < n:
        out += [alphabet[b % len(alphabet)] for b in hashlib.sha256(f"{seed}/{block}".encode()).digest()]
        block += 1
    return "".join(out[:n])


#: Functions of (arguments, seed).
FUNCTIONS: dict[str, Callable[[list[str], str], str]] = {
    "random_str": lambda a, s: _seeded(s, int(a[0]) if a and a[0] else 8, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"),
    "random_hex": lambda a, s: _seeded(s, int(a[0]) if a and a[0] else 16, "0123456789abcdef"),
    "random_int": lambda a, s: str(int(a[0]) + int(hashlib.sha256(s.encode()).hexdigest()[:12], 16) % (int(a[1]) - int(a[0]) + 1)),
    "uuid": lambda a, s: "{}-{}-4{}-8{}-{}".format(*(lambda h: (h[:8], h[8:12], h[13:16], h[17:20], h[20:32]))(hashlib.sha256(s.encode()).hexdigest())),
    "upper": lambda a, s: ",".join(a).upper(),
    "lower": lambda a, s: ",".join(a).lower(),
    "base64": lambda a, s: base64.b64encode(",".join(a).encode()).decode(),
    "urlencode": lambda a, s: quote(",".join(a), safe="-_.~"),
    "seq": lambda a, s: a[int(hashlib.sha256(s.encode()).hexdigest()[:8], 16) % len(a)],
}


def condition_holds(condition: str, variables: dict[str, str]) -> bool:
    c = condition.strip()
    if c.startswith("exists:"):
        return c[7:] in variables
    for sign, equal in (("!=", False), ("==", True)):
        if sign in c:
            left, right = (x.strip() for x in c.split(sign, 1))
            return (variables.get(left, left) == right) is equal
    return variables.get(c, "") not in ("", "false", "0")


def substitute(template: str, variables: dict[str, str], seed: str = "", functions: dict | None = None) -> str:
    """Calls first, then conditionals, then names with defaults; what stays unresolved is kept as it is."""
    known = FUNCTIONS | (functions or {})

    def call(m: re.Match) -> str:
        if m[1] not in known:
            return m[0]
        try:
            return known[m[1]]([x.strip() for x in m[2].split(",")] if m[2].strip() else [], f"{seed}/{m.start()}")
        except (ValueError, IndexError):
            return m[0]

    text = _CALL.sub(call, template)
    text = _CHOICE.sub(lambda m: m[2] if condition_holds(m[1], variables) else m[3], text)
    return _NAME.sub(lambda m: variables.get(m[1], m[2] if m[2] is not None else m[0]), text)


def substituted(template: Column, variables: Column, seed: Column, functions: dict | None = None) -> Column:
    """Templates filled from a map column, in Arrow batches."""

    def fill(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, maps, seeds in batches:
            yield pd.Series([None if t is None else substitute(t, dict(m or {}), str(s), functions) for t, m, s in zip(texts, maps, seeds)], dtype=object)

    fill.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(fill, "string")(template, variables, seed)


def variables_in(template: Column) -> Column:
    """Distinct names of a template, in the order in which they first occur."""
    return F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{\{(\w[\w.-]*)(?::[^}]*)?\}\}"), F.lit(1)))


def resolved_names(names: DataFrame, static: DataFrame, pool: DataFrame, env: DataFrame) -> DataFrame:
    """(name, value, source): the static variable, else the newest unexpired pool value, else the environment, else the default."""
    newest = pool.where(F.col("expires").isNull() | (F.col("expires") >= F.col("asof"))).groupBy(F.col("key").alias("name")).agg(F.max_by("value", F.struct("ts", "seq")).alias("p"))
    j = names.join(static.select("name", F.col("value").alias("s")), "name", "left").join(newest, "name", "left").join(env.select("name", F.col("value").alias("e")), "name", "left")
    source = F.when(F.col("s").isNotNull(), "static").when(F.col("p").isNotNull(), "pool").when(F.col("e").isNotNull(), "env").when(F.col("default").isNotNull(), "default").otherwise("unresolved")
    return j.select("name", F.coalesce("s", "p", "e", "default").alias("value"), source.alias("source"))


@R.query("template_vars", """SELECT event_id AS seq, CASE WHEN event_id % 2 = 0 THEN 'user,host' ELSE 'host,path' END AS names FROM events""")
def template_vars(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("event_id") % 2 == 0, "https://{{user}}@{{host}}/{{user}}").otherwise("https://{{host:example.com}}/{{path}}?h={{host}}")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.array_join(variables_in(t), ",").alias("names"))


@R.query("template_substitution", """SELECT event_id AS seq, 'u' || user_id || '/' || CASE WHEN event_type = 'error' THEN 'bad' ELSE 'good' END || '/' || 'none' || '/' || upper(event_type) || '/{{missing}}' AS text FROM events""")
def template_substitution(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    variables = F.create_map(F.lit("user"), F.concat(F.lit("u"), "user_id"), F.lit("type"), "event_type")
    template = F.concat(F.lit("{{user}}/{{?type==error|bad|good}}/{{other:none}}/{{upper("), "event_type", F.lit(")}}/{{missing}}"))
    return e.select(F.col("event_id").alias("seq"), substituted(template, variables, F.col("event_id")).alias("text"))


@R.query("variable_resolution", """WITH n AS (SELECT DISTINCT user_id FROM events), p AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS p FROM events WHERE user_id % 2 = 0 GROUP BY 1)
SELECT CAST(n.user_id AS VARCHAR) AS name, CASE WHEN n.user_id % 5 = 0 THEN 'static' WHEN p IS NOT NULL THEN p WHEN n.user_id % 3 = 0 THEN 'env' ELSE 'fallback' END AS value, CASE WHEN n.user_id % 5 = 0 THEN 'static' WHEN p IS NOT NULL THEN 'pool' WHEN n.user_id % 3 = 0 THEN 'env' ELSE 'default' END AS source FROM n LEFT JOIN p USING (user_id)""")
def variable_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ids = e.select("user_id").distinct()
    named = ids.select(F.col("user_id").cast("string").alias("name"), F.lit("fallback").alias("default"))
    static = ids.where("user_id % 5 = 0").select(F.col("user_id").cast("string").alias("name"), F.lit("static").alias("value"))
    env = ids.where("user_id % 3 = 0").select(F.col("user_id").cast("string").alias("name"), F.lit("env").alias("value"))
    pool = e.where("user_id % 2 = 0").select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("value"), "ts", F.col("event_id").alias("seq"), F.lit(None).cast("timestamp_ntz").alias("expires"), F.col("ts").alias("asof"))
    return resolved_names(named, static, pool, env)


@R.query("template_functions", """SELECT event_id AS seq, to_base64(encode(event_type)) AS packed, replace(url_encode(props), '+', '%20') AS quoted FROM events""")
def template_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .text import url_encode_rfc3986

    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), F.base64(F.encode("event_type", "UTF-8")).alias("packed"), url_encode_rfc3986(F.col("props")).alias("quoted"))
