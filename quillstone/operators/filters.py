"""Response filters, url rules and rule-based findings: predicates that Catalyst can push and prune.

A filter is a column holding the reason for which a row is hidden, null where it is shown. Filters that need only
numbers come before those that read bodies, since a chain stops at the first reason.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import line_count, word_count
from ..registry import Registry
from ..shared import gathered
from ..views import RESPONSES_SQL, docs, pages, responses, table

R = Registry()

#: The presets of status filters, and the words of the url and metadata rules.
HIDE_ERRORS = (404, 500, 502, 503, 504)
SHOW_SUCCESS = (200, 201, 202, 204)
SHOW_INTERESTING = (200, 201, 301, 302, 400, 401, 403, 405, 500)
SENSITIVE_PATHS = (".git", ".svn", ".env", "config", "backup", "admin", "debug", "test", "phpinfo")


def status_filter(status: Column, show: tuple[int, ...] = (), hide: tuple[int, ...] = ()) -> Column:
    """A list of shown codes wins over one of hidden codes."""
    if show:
        return F.when(~status.isin(*show), "status code not in show list")
    return F.when(status.isin(*hide) if hide else F.lit(False), "status code in hide list")


def number_filter(value: Column, name: str, least: int = 0, most: int = 0, exact: tuple[int, ...] = (), show: tuple[int, ...] = ()) -> Column:
    """Exact values first, then a list of shown ones, then below the least, then above the most; both bounds are shown, 0 is no bound."""
    reason = F.when(value.isin(*exact) if exact else F.lit(False), F.lit(f"exact {name} match"))
    if show:
        return reason.when(~value.isin(*show), F.lit(f"{name} not in show list"))
    reason = reason.when((value < least) if least > 0 else F.lit(False), F.lit(f"{name} below minimum"))
    return reason.when((value > most) if most > 0 else F.lit(False), F.lit(f"{name} above maximum"))


def regex_filter(text: Column, pattern: str, show: bool = False) -> Column:
    """Hides texts in which the pattern is found; with show, those in which it is not."""
    found = text.rlike(pattern)
    return F.when(~found if show else found, F.lit("pattern not matched" if show else "pattern matched"))


def chain_any(filters: dict[str, Column]) -> Column:
    """struct(name, reason) of the first filter that hides the row, else null."""
    if not filters:
        return F.lit(None).cast("struct<name:string,reason:string>")
    return F.coalesce(*[F.when(reason.isNotNull(), F.struct(F.lit(name).alias("name"), reason.alias("reason"))) for name, reason in filters.items()])


def chain_all(filters: dict[str, Column]) -> Column:
    """A reason only where every filter has one; an empty chain hides nothing."""
    if not filters:
        return F.lit(None).cast("string")
    every = reduce(lambda a, b: a & b, [reason.isNotNull() for reason in filters.values()])
    return F.when(every, "all filters triggered")


def url_host(url: Column) -> Column:
    """Host and port, without user information, in lower case."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(authority, r"^.*@", ""))


def domain_allowed(url: Column, domains: list[str], exclude: list[str] | None = None) -> Column:
    """The host is an allowed domain or below one (any, if none is given), and no exclusion is found in the url."""
    host = url_host(url)
    below = reduce(lambda a, b: a | b, [(host == d) | host.endswith("." + d) for d in domains]) if domains else F.lit(True)
    return reduce(lambda a, p: a & ~url.rlike(p), exclude or [], below)


def url_type(url: Column, content_type: Column) -> Column:
    """api, js, static or page, by content type first and then by the url."""
    u = F.lower(url)
    static = reduce(lambda a, s: a | u.endswith(s), (".css", ".png", ".jpg", ".gif", ".svg", ".ico", ".woff", ".woff2"), F.lit(False))
    return (
        F.when(content_type.contains("application/json"), "api")
        .when(content_type.contains("javascript"), "js")
        .when(u.contains("/api/") | u.contains("/v1/") | u.contains("/v2/") | u.contains("/graphql"), "api")
        .when(u.endswith(".js"), "js")
        .when(static, "static")
        .otherwise("page")
    )


def api_urls(rows: DataFrame, url_col: str, content_type: Column) -> DataFrame:
    """The rows whose url is an API's, by url_type."""
    return rows.where(url_type(F.col(url_col), content_type) == "api")


def searched(rows: DataFrame, term: str, columns: list[str]) -> DataFrame:
    """Rows that hold the term in any of the columns, whatever its case."""
    return rows.where(reduce(lambda a, b: a | b, [F.lower(F.col(c)).contains(term.lower()) for c in columns]))


def query_params(url: Column) -> Column:
    """The url's parameters as an array of (name, value)."""
    pairs = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda x: x != "")
    return F.transform(pairs, lambda x: F.struct(F.regexp_extract(x, "^[^=]*", 0).alias("name"), F.regexp_extract(x, "=(.*)$", 1).alias("value")))


def findings(rows: DataFrame, rules: list[dict], id_col: str, enabled: list[str] | None = None, checkers: list[Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """(id, rule, evidence, severity, cwe, cvss, confidence): what the rules find in each row's url, its parameters and its body.

    A rule on parameters finds each whose name, in lower case, holds one of its tokens (or whose value starts with
    `value_start`); one on a text finds it once, or with `each` once per token that it holds. The small rule table is
    unrolled into literals, so one scan tests all rules. enabled: names of rules, an empty list or None for all. checkers:
    further ones of the caller's, each from rows to such findings.
    """
    rules = [r for r in rules if not enabled or r["rule"] in enabled]
    made = []
    for rule in rules:
        tokens = rule["tokens"]
        if rule["on"] == "params":
            found = F.transform(F.filter(query_params(F.col(rule["column"])), _either(tokens, rule.get("value_start"))), lambda p: p["name"])
        else:
            text = F.lower(F.col(rule["column"])) if rule.get("fold") else F.col(rule["column"])
            held = F.filter(F.array(*[F.lit(t) for t in tokens]), _starting(text) if rule.get("start") else _holding(text))
            found = held if rule.get("each") else F.slice(held, 1, 1)
        made.append(F.transform(found, _finding(rule)))
    met = rows.select(id_col, F.explode(F.flatten(F.array(*made))).alias("f"))
    found = met.select(id_col, "f.rule", "f.evidence", "f.severity", "f.cwe", "f.cvss", "f.confidence")
    return reduce(lambda a, check: a.unionByName(check(rows)), checkers or [], found)


def _either(tokens: tuple[str, ...], start: str | None):
    def test(p: Column) -> Column:
        named = reduce(lambda a, b: a | b, [F.lower(p["name"]).contains(t) for t in tokens])
        return named | p["value"].startswith(start) if start else named

    return test


def _starting(text: Column):
    return lambda t: text.startswith(t)


def _holding(text: Column):
    return lambda t: text.contains(t)


def _finding(rule: dict):
    def build(evidence: Column) -> Column:
        fixed = [F.lit(rule[k]).alias(k) for k in ("rule", "severity", "cwe", "cvss", "confidence")]
        return F.struct(evidence.alias("evidence"), *fixed)

    return build


#: The metadata rules, with what a hit means.
RULES = [
    {"rule": "ssrf", "on": "params", "column": "url", "tokens": ("url", "uri", "path", "src", "href"), "value_start": "http", "severity": "high", "cwe": "CWE-918", "cvss": 8.6, "confidence": 0.5},
    {"rule": "idor", "on": "params", "column": "url", "tokens": ("id", "uid", "user", "account"), "severity": "high", "cwe": "CWE-639", "cvss": 7.5, "confidence": 0.4},
    {"rule": "os_command", "on": "params", "column": "url", "tokens": ("cmd", "exec", "command", "run", "ping", "host"), "severity": "critical", "cwe": "CWE-78", "cvss": 9.8, "confidence": 0.6},
    {"rule": "authentication", "on": "text", "column": "url", "fold": True, "tokens": ("login", "auth", "signin"), "severity": "high", "cwe": "CWE-287", "cvss": 7.5, "confidence": 0.5},
    {"rule": "misconfiguration", "on": "text", "column": "url", "fold": True, "each": True, "tokens": SENSITIVE_PATHS, "severity": "medium", "cwe": "CWE-200", "cvss": 5.3, "confidence": 0.4},
    {"rule": "cryptographic", "on": "text", "column": "url", "start": True, "tokens": ("http://",), "severity": "medium", "cwe": "CWE-319", "cvss": 5.9, "confidence": 1.0},
    {"rule": "deserialization", "on": "text", "column": "html", "each": True, "tokens": ("rO0AB", "O:", "@type", "__class__"), "severity": "critical", "cwe": "CWE-502", "cvss": 8.1, "confidence": 0.5},
    {"rule": "xxe", "on": "text", "column": "html", "tokens": ("<?xml", "<"), "severity": "high", "cwe": "CWE-611", "cvss": 7.5, "confidence": 0.5},
]


def _rules_sql() -> str:
    parts = []
    for r in RULES:
        fixed = f"'{r['rule']}' AS rule, {{e}} AS evidence, '{r['severity']}' AS severity, '{r['cwe']}' AS cwe, {r['cvss']}::DOUBLE AS cvss, {r['confidence']}::DOUBLE AS confidence"
        if r["on"] == "params":
            hit = " OR ".join(f"contains(lower(n), '{t}')" for t in r["tokens"]) + (f" OR starts_with(v, '{r['value_start']}')" if r.get("value_start") else "")
            parts.append(f"SELECT page_id, {fixed.format(e='n')} FROM (SELECT page_id, regexp_extract(x, '^[^=]*') AS n, regexp_extract(x, '=(.*)$', 1) AS v FROM (SELECT page_id, unnest(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&')) AS x FROM pages) WHERE x <> '') WHERE {hit}")
        else:
            text = f"lower({r['column']})" if r.get("fold") else r["column"]
            test = "starts_with" if r.get("start") else "contains"
            tokens = ", ".join(f"('{t}', {k})" for k, t in enumerate(r["tokens"]))
            once = "" if r.get("each") else " QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY k) = 1"
            parts.append(f"SELECT page_id, {fixed.format(e='t')} FROM (SELECT page_id, t, k FROM pages, (VALUES {tokens}) x(t, k) WHERE {test}({text}, t){once})")
    return " UNION ALL ".join(parts)


@R.query("filter_status_hide", f"WITH {RESPONSES_SQL} SELECT seq, status_code FROM responses WHERE status_code NOT IN (404, 500, 502, 503, 504)")
def filter_status_hide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses(spark, sf_dir).where(status_filter(F.col("status_code"), hide=HIDE_ERRORS).isNull()).select("seq", "status_code")


@R.query("filter_status_show", f"WITH {RESPONSES_SQL} SELECT seq, status_code FROM responses WHERE status_code IN (200, 201, 202, 204)")
def filter_status_show(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses(spark, sf_dir).where(status_filter(F.col("status_code"), show=SHOW_SUCCESS).isNull()).select("seq", "status_code")


@R.query("filter_interesting_status", f"WITH {RESPONSES_SQL} SELECT status_code, count(*) AS n FROM responses WHERE status_code IN (200, 201, 301, 302, 400, 401, 403, 405, 500) GROUP BY 1")
def filter_interesting_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = responses(spark, sf_dir).where(status_filter(F.col("status_code"), show=SHOW_INTERESTING).isNull())
    return shown.groupBy("status_code").agg(F.count("*").alias("n"))


@R.query("filter_length", f"WITH {RESPONSES_SQL} SELECT seq, content_length FROM responses WHERE NOT (content_length = 9 OR content_length < 8 OR content_length > 9)")
def filter_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = number_filter(F.col("content_length"), "length", least=8, most=9, exact=(9,))
    return responses(spark, sf_dir).where(reason.isNull()).select("seq", "content_length")


@R.query("filter_words", "SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '[\\p{L}\\p{Nd}]+')) BETWEEN 50 AND 500")
def filter_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).where(number_filter(word_count(F.col("text")), "word count", least=50, most=500).isNull()).select("doc_id")


@R.query("filter_lines", "SELECT doc_id FROM documents WHERE octet_length(encode(text)) = 0 OR length(text) - length(replace(text, chr(10), '')) + 1 <= 5")
def filter_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).where(number_filter(line_count(F.col("text")), "line count", most=5).isNull()).select("doc_id")


@R.query("filter_regex", "SELECT page_id FROM pages WHERE NOT regexp_matches(html, '(?i)<footer>[^<]*example\\.org')")
def filter_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).where(regex_filter(F.col("html"), r"(?i)<footer>[^<]*example\.org").isNull()).select("page_id")


@R.query("filter_regex_show", "SELECT page_id FROM pages WHERE regexp_matches(url, '^https://')")
def filter_regex_show(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).where(regex_filter(F.col("url"), "^https://", show=True).isNull()).select("page_id")


def _chain() -> dict[str, Column]:
    return {
        "status": status_filter(F.col("status_code"), hide=HIDE_ERRORS),
        "length": number_filter(F.col("content_length"), "length", least=8),
        "regex": regex_filter(F.col("body"), r'"k": 1'),
    }


_CHAIN_SQL = """c AS (SELECT seq, CASE WHEN status_code IN (404, 500, 502, 503, 504) THEN 'status code in hide list' END AS f1,
 CASE WHEN content_length < 8 THEN 'length below minimum' END AS f2, CASE WHEN regexp_matches(body, '"k": 1') THEN 'pattern matched' END AS f3 FROM responses)"""


@R.query("filter_chain_any", f"WITH {RESPONSES_SQL}, {_CHAIN_SQL} SELECT CASE WHEN f1 IS NOT NULL THEN 'status' WHEN f2 IS NOT NULL THEN 'length' WHEN f3 IS NOT NULL THEN 'regex' END AS name, coalesce(f1, f2, f3) AS reason, count(*) AS n FROM c GROUP BY 1, 2")
def filter_chain_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    hidden = responses(spark, sf_dir).select(chain_any(_chain()).alias("h"))
    return hidden.groupBy(F.col("h.name").alias("name"), F.col("h.reason").alias("reason")).agg(F.count("*").alias("n"))


@R.query("filter_chain_all", f"WITH {RESPONSES_SQL}, {_CHAIN_SQL} SELECT CASE WHEN f1 IS NOT NULL AND f2 IS NOT NULL AND f3 IS NOT NULL THEN 'all filters triggered' END AS reason, count(*) AS n FROM c GROUP BY 1")
def filter_chain_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses(spark, sf_dir).groupBy(chain_all(_chain()).alias("reason")).agg(F.count("*").alias("n"))


@R.query("url_domain_allow", "SELECT page_id FROM pages WHERE (lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', '')) = 'example.com' OR ends_with(lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', '')), '.example.com')) AND NOT regexp_matches(url, '\\.pdf$') AND NOT regexp_matches(url, '/de/')")
def url_domain_allow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).where(domain_allowed(F.col("url"), ["example.com"], [r"\.pdf$", "/de/"])).select("page_id")


@R.query(
    "url_type_counts",
    """SELECT CASE WHEN contains(ct, 'application/json') THEN 'api' WHEN contains(ct, 'javascript') THEN 'js' WHEN contains(u, '/api/') OR contains(u, '/v1/') OR contains(u, '/v2/') OR contains(u, '/graphql') THEN 'api'
 WHEN ends_with(u, '.js') THEN 'js' WHEN regexp_matches(u, '\\.(css|png|jpg|gif|svg|ico|woff|woff2)$') THEN 'static' ELSE 'page' END AS url_type, count(*) AS n
 FROM (SELECT lower(url || CASE page_id % 5 WHEN 0 THEN '/api/x' WHEN 1 THEN '.css' WHEN 2 THEN '.js' ELSE '' END) AS u, CASE WHEN page_id % 7 = 0 THEN 'application/json' ELSE 'text/html' END AS ct FROM pages) GROUP BY 1""",
)
def url_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 5
    url = F.concat("url", F.when(k == 0, "/api/x").when(k == 1, ".css").when(k == 2, ".js").otherwise(""))
    kind = url_type(url, F.when(F.col("page_id") % 7 == 0, "application/json").otherwise("text/html"))
    return pages(spark, sf_dir).groupBy(kind.alias("url_type")).agg(F.count("*").alias("n"))


@R.query("metadata_findings", _rules_sql())
def metadata_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(pages(spark, sf_dir), RULES, "page_id")


@R.query("misconfig_findings", f"SELECT severity, cwe, count(*) AS n FROM ({_rules_sql()}) WHERE rule IN ('cryptographic', 'misconfiguration') GROUP BY 1, 2")
def misconfig_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = [r for r in RULES if r["rule"] in ("cryptographic", "misconfiguration")]  # as a checker list enables some of all
    return findings(pages(spark, sf_dir), chosen, "page_id").groupBy("severity", "cwe").agg(F.count("*").alias("n"))


@R.query("entity_search", "SELECT doc_id FROM documents WHERE contains(lower(source), 'c1') OR contains(lower(lang), 'c1')")
def entity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searched(docs(spark, sf_dir), "C1", ["source", "lang"]).select("doc_id")


@R.query("status_split", "SELECT event_type = 'view' AS running, count(*) AS n FROM events GROUP BY 1")
def status_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy((F.col("event_type") == "view").alias("running")).agg(F.count("*").alias("n"))


def params_times_payloads(urls: DataFrame, payloads: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """(id, param, payload) for each parameter of each url and each row of a caller's list.

    The list is a dimension, of checked size, and gathered once, as a scalar subquery, so that no nested-loop join is planned.
    """
    query = F.regexp_extract(url_col, r"\?([^#]*)", 1)
    named = urls.select(id_col, F.explode(F.filter(F.split(query, "&"), lambda x: x != "")).alias("pair"))
    params = named.select(id_col, F.split("pair", "=", 2)[0].alias("param"))
    listed = gathered(payloads.where("payload is not null"), "payload")
    return params.withColumn("payloads", listed).select(id_col, "param", F.explode("payloads").alias("payload"))


@R.query("param_payload_product", """SELECT page_id, split_part(pair, '=', 1) AS param, payload FROM (SELECT page_id, unnest(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&')) AS pair FROM pages), (SELECT DISTINCT l_shipmode AS payload FROM (SELECT DISTINCT event_type AS l_shipmode FROM events)) WHERE pair <> ''""")
def param_payload_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    payloads = table(spark, sf_dir, "events").select(F.col("event_type").alias("payload")).distinct()
    return params_times_payloads(pages(spark, sf_dir), payloads, "page_id", "url")


def differential_indicators(pairs: DataFrame, indicators: list[str]) -> Column:
    """The first indicator that the variant body holds and the baseline body does not; null if there is none."""
    return F.get(F.filter(F.array(*[F.lit(x) for x in indicators]), lambda i: F.col("variant").contains(i) & ~F.col("baseline").contains(i)), F.lit(0))


@R.query("differential_indicator", """WITH p AS (SELECT conv_id, max(CASE WHEN turn = 0 THEN text END) AS baseline, max(CASE WHEN turn = 1 THEN text END) AS variant FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN contains(variant, 'the') AND NOT contains(baseline, 'the') THEN 'the' WHEN contains(variant, 'tion') AND NOT contains(baseline, 'tion') THEN 'tion' WHEN contains(variant, 'en') AND NOT contains(baseline, 'en') THEN 'en' END AS indicator FROM p""")
def differential_indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    pairs = c.groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("baseline"), F.max(F.when(F.col("turn") == 1, F.col("text"))).alias("variant"))
    return pairs.select("conv_id", differential_indicators(pairs, ["the", "tion", "en"]).alias("indicator"))
