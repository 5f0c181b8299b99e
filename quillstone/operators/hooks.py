"""What callers may add: filters, functions, rewrites, strategies, detectors, checkers, report formats, handlers.

Each is a plain Python function that an operator takes as an argument; the queries here show one of each at work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.templates import condition_holds, substituted
from ..registry import Registry
from ..views import RESPONSES_SQL, pages, responses, table
from .filters import RULES, _rules_sql, api_urls, chain_any, findings, status_filter
from .variants import BOUNDARIES, _sql, boundary_values, variants

R = Registry()


def handled(tasks: DataFrame, handle: Callable[[dict], dict], schema: str) -> DataFrame:
    """The rows that a handler makes of each task, in Arrow batches; a handler that fails marks its task and stops nothing.

    schema: of the handler's results; `ok` (boolean) and `error` (string) are put behind.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for task in batch.to_dict("records"):
                try:
                    out.append({**handle(task), "ok": True, "error": None})
                except Exception as e:  # noqa: BLE001
                    out.append({n: task.get(n) for n in names} | {"ok": False, "error": str(e)})
            yield pd.DataFrame(out, columns=[*names, "ok", "error"])

    return tasks.mapInPandas(run, f"{schema}, ok boolean, error string")


@R.query("custom_filter", f"WITH {RESPONSES_SQL} SELECT CASE WHEN status_code = 500 THEN 'status' WHEN response_time_ns > 100000000 THEN 'slow' END AS name, count(*) AS n FROM responses GROUP BY 1")
def custom_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = {"status": status_filter(F.col("status_code"), hide=(500,)), "slow": F.when(F.col("response_time_ns") > 100_000_000, "takes too long")}
    return responses(spark, sf_dir).groupBy(chain_any(chain)["name"].alias("name")).agg(F.count("*").alias("n"))


@R.query("custom_function", "SELECT event_id AS seq, event_type || event_type || '/' || reverse(event_type) AS text FROM events")
def custom_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = {"twice": lambda a, seed: a[0] * 2, "turned": lambda a, seed: a[0][::-1]}
    template = F.concat(F.lit("{{twice("), "event_type", F.lit(")}}/{{turned("), "event_type", F.lit(")}}"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), substituted(template, F.create_map().cast("map<string,string>"), F.col("event_id"), own).alias("text"))


@R.query("custom_mutator", "SELECT page_id, CAST(k AS INTEGER) AS k, 'marked' AS mutator, url || '!' AS data FROM pages, range(2) r(k)")
def custom_mutator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two mutators, and a strategy that always takes the first by name."""
    own = {"marked": lambda data, seed: data + b"!", "untouched": lambda data, seed: data}
    made = variants(pages(spark, sf_dir), "page_id", "url", n=2, mutators=own, strategy=lambda seed, names: names[0])
    return made.select("page_id", "k", "mutator", F.decode("data", "UTF-8").alias("data"))


@R.query("mutation_never_taken", "SELECT page_id, '' AS mutator, url AS data FROM pages")
def mutation_never_taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probability gate shut: inputs come back as they are."""
    made = variants(pages(spark, sf_dir), "page_id", "url", n=1, chain=3, probability=0.0)
    return made.select("page_id", "mutator", F.decode("data", "UTF-8").alias("data"))


@R.query("custom_detector", "SELECT v, 'uuid' AS kind, boundary FROM (SELECT DISTINCT event_type AS v FROM events), (VALUES " + ", ".join(f"({_sql(b)})" for b in BOUNDARIES["uuid"]) + ") b(boundary)")
def custom_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundary_values(table(spark, sf_dir, "events").select(F.col("event_type").alias("v")).distinct(), "v", detector=lambda value: F.when(value.isNotNull(), "uuid"))


@R.query("custom_checker", f"SELECT * FROM ({_rules_sql()}) WHERE rule = 'cryptographic' UNION ALL SELECT page_id, 'long', url, 'info', 'CWE-0', 0.0::DOUBLE, 1.0::DOUBLE FROM pages WHERE length(url) > 45")
def custom_checker(spark: SparkSession, sf_dir: str) -> DataFrame:
    def long_urls(rows: DataFrame) -> DataFrame:
        fixed = {"rule": F.lit("long"), "evidence": F.col("url"), "severity": F.lit("info"), "cwe": F.lit("CWE-0"), "cvss": F.lit(0.0), "confidence": F.lit(1.0)}
        return rows.where(F.length("url") > 45).select("page_id", *[c.alias(n) for n, c in fixed.items()])

    return findings(pages(spark, sf_dir), RULES, "page_id", enabled=["cryptographic"], checkers=[long_urls])


@R.query("enabled_checkers", f"SELECT 'some' AS list, rule, count(*) AS n FROM ({_rules_sql()}) WHERE rule IN ('idor', 'misconfiguration') GROUP BY ALL UNION ALL SELECT 'empty', rule, count(*) FROM ({_rules_sql()}) GROUP BY ALL")
def enabled_checkers(spark: SparkSession, sf_dir: str) -> DataFrame:
    some, every = (findings(pages(spark, sf_dir), RULES, "page_id", enabled=names).withColumn("list", F.lit(k)) for k, names in (("some", ["idor", "misconfiguration"]), ("empty", [])))
    return some.unionByName(every).groupBy("list", "rule").agg(F.count("*").alias("n"))


@R.query("handled_tasks", "SELECT event_id AS seq, CASE WHEN event_id % 10 <> 0 THEN length(event_type) ELSE NULL END AS size, event_id % 10 <> 0 AS ok, CASE WHEN event_id % 10 = 0 THEN 'refused' END AS error FROM events")
def handled_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    def handle(task: dict) -> dict:
        if task["seq"] % 10 == 0:
            raise ValueError("refused")
        return {"seq": task["seq"], "size": len(task["payload"])}

    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("payload"))
    return handled(e, handle, "seq long, size long")


@R.query("api_endpoint_urls", """SELECT page_id, u AS url FROM (SELECT page_id, url || CASE page_id % 5 WHEN 0 THEN '/api/x' WHEN 1 THEN '.css' WHEN 2 THEN '/v2/y.js' ELSE '' END AS u, page_id % 7 = 0 AS json, page_id % 7 = 1 AS js FROM pages)
WHERE json OR (NOT js AND (contains(lower(u), '/api/') OR contains(lower(u), '/v1/') OR contains(lower(u), '/v2/') OR contains(lower(u), '/graphql')))""")
def api_endpoint_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 5
    p = pages(spark, sf_dir).select("page_id", F.concat("url", F.when(k == 0, "/api/x").when(k == 1, ".css").when(k == 2, "/v2/y.js").otherwise("")).alias("url"))
    kind = F.when(F.col("page_id") % 7 == 0, "application/json").when(F.col("page_id") % 7 == 1, "text/javascript").otherwise("text/html")
    return api_urls(p, "url", kind)


@R.query("conditions", """SELECT event_id AS seq, true AS has_user, event_type = 'click' AS is_click, event_type <> 'click' AS no_click, event_id % 3 = 1 AS flag, false AS absent FROM events""")
def conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each form of condition: exists, equal, not equal, truthy, unset."""
    forms = {"has_user": "exists:user", "is_click": "type == click", "no_click": "type != click", "flag": "flag", "absent": "nothing"}

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{"user": str(u), "type": t, "flag": f} for u, t, f in zip(b["user_id"], b["event_type"], b["flag"])]
            yield pd.DataFrame({"seq": b["event_id"], **{n: [condition_holds(c, r) for r in rows] for n, c in forms.items()}})

    flag = F.when(F.col("event_id") % 3 == 0, "false").when(F.col("event_id") % 3 == 1, "yes").otherwise("0")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", flag.alias("flag"))
    return e.mapInPandas(judge, "seq long, " + ", ".join(f"{n} boolean" for n in forms))
