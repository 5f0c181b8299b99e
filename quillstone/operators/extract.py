"""Value extraction by rules, pattern scans, header audits, assertions and link extraction over stored responses."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..registry import Registry
from ..shared import spread
from ..views import RESPONSES_SQL, pages, responses, table
from .paths import is_plain, json_value

R = Registry()


@dataclass(frozen=True)
class Rule:
    """One extraction: a name, a kind (regex, jsonpath, header, cookie, custom), a pattern, and what to do with the value."""

    name: str
    kind: str
    pattern: str
    group: int = 1
    required: bool = False
    default: str = ""
    transform: str = ""


#: Preset rules and the audited headers with the severity of their absence.
PRESETS = {
    "csrf_token": Rule("csrf_token", "regex", r"""name=["']?csrf[_-]?token["']?\s+value=["']?([^"'\s>]+)"""),
    "session_id": Rule("session_id", "cookie", "PHPSESSID"),
    "access_token": Rule("access_token", "jsonpath", "access_token"),
    "redirect": Rule("redirect", "header", "Location"),
}
HEADERS = (
    ("Strict-Transport-Security", True, "medium"),
    ("X-Content-Type-Options", True, "low"),
    ("X-Frame-Options", True, "medium"),
    ("X-XSS-Protection", False, "low"),
    ("Content-Security-Policy", True, "medium"),
    ("Referrer-Policy", False, "low"),
    ("Permissions-Policy", False, "low"),
)
DISCLOSING = ("Server", "X-Powered-By")
#: Response patterns by type.
PATTERNS = {
    "sql_error": (r"(?i)sql\s*syntax", r"(?i)mysql.*error", r"(?i)postgresql.*error", r"(?i)sqlite.*error", r"(?i)oracle.*error", r"(?i)ORA-\d{5}", r"(?i)quoted string not properly terminated", r"(?i)unclosed quotation", r"(?i)SQLSTATE\[", r"(?i)Warning:.*mysql_", r"(?i)Warning:.*pg_", r"(?i)Microsoft SQL Server", r"(?i)ODBC.*Driver"),
    "reflected_script": (r"<script[^>]*>.*?</script>", r"on\w+\s*=\s*['\"]*[^'\"]*['\"]", r"javascript:", r"<img[^>]+onerror\s*=", r"<svg[^>]+onload\s*="),
    "command_output": (r"uid=\d+\(.*?\)\s+gid=\d+", r"root:.*:0:0:", r"\[boot loader\]", r"(?i)volume\s+serial\s+number", r"(?i)directory\s+of\s+"),
    "file_content": (r"root:x:0:0:", r"\[fonts\]", r"\[extensions\]", r"(?i)warning:.*include\(", r"(?i)failed to open stream"),
    "xml_entity": (r"root:.*:0:0:", r"(?i)external entity", r"(?i)entity.*not defined", r"SYSTEM.*file:"),
    "metadata_service": (r"(?i)ami-[a-z0-9]+", r"(?i)instance-id", r"169\.254\.169\.254", r"(?i)internal\s+server"),
    "sensitive_data": (r"(?i)password\s*[:=]", r"(?i)api[_-]?key\s*[:=]", r"(?i)secret[_-]?key\s*[:=]", r"(?i)private[_-]?key", r"(?i)access[_-]?token", r"(?i)aws[_-]?secret", r"-----BEGIN.*PRIVATE KEY-----", r"(?i)jdbc:.*://", r"(?i)mongodb://.*@"),
    "verbose_error": (r"(?i)stack\s*trace", r"(?i)at\s+\w+\.\w+\(.*:\d+\)", r"(?i)exception\s+in\s+thread", r"(?i)traceback\s+\(most recent", r"(?i)Parse\s+error:", r"(?i)Fatal\s+error:", r"(?i)undefined\s+index"),
}
#: The names under which the findings of each type of pattern are reported.
FINDING_TYPES = {
    "sql_error": "A03_SQL_INJECTION",
    "reflected_script": "A03_XSS",
    "command_output": "A03_OS_COMMAND",
    "file_content": "A01_BROKEN_ACCESS_CONTROL",
    "xml_entity": "A05_XXE",
    "metadata_service": "A10_SSRF",
    "sensitive_data": "A02_SENSITIVE_DATA_EXPOSURE",
    "verbose_error": "A05_VERBOSE_ERRORS",
}


def finding_type(kind: Column) -> Column:
    """The reported name of a type of pattern; other types, such as callers' own, keep their names."""
    named = F.create_map(*[F.lit(x) for pair in FINDING_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(named, kind), kind)


def json_path(path: str) -> str:
    """A dotted path as JSONPath: `a.b.0` becomes `$.a.b[0]`."""
    return "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split("."))


def header_value(headers: Column, name: str) -> Column:
    """A header's value whatever its case; the first in order of keys, if several differ by case."""
    same = F.map_filter(headers, lambda k, v: F.lower(k) == name.lower())
    return F.get(F.transform(F.array_sort(F.map_entries(same)), lambda e: e["value"]), F.lit(0))


def transformed(value: Column, name: str) -> Column:
    known = {"": lambda v: v, "trim": F.trim, "lower": F.lower, "upper": F.upper, "urldecode": X.url_decode_lenient, "htmlunescape": X.html_unescape}
    return known[name](value)


def found_value(rule: Rule, body: Column, headers: Column, cookies: Column, status: Column, content_type: Column, scenario: bool = False) -> Column:
    """The raw value, null if it is not found. In scenarios group 0 is the whole match and bodies need not be valid JSON."""
    if rule.kind == "regex":
        group = rule.group if scenario or rule.group else (1 if "(" in rule.pattern else 0)
        return F.when(body.rlike(rule.pattern), F.regexp_extract(body, rule.pattern, group))
    if rule.kind == "jsonpath":
        if not is_plain(rule.pattern):
            return json_value(body, rule.pattern)
        value = F.get_json_object(body, json_path(rule.pattern))
        return value if scenario else F.when(F.try_parse_json(body).isNotNull(), value)
    if rule.kind == "header":
        return header_value(headers, rule.pattern)
    if rule.kind == "cookie":
        return F.try_element_at(cookies, F.lit(rule.pattern))
    if rule.kind == "custom":
        special = {"status_code": status.cast("string"), "content_type": content_type, "body_length": F.octet_length(body).cast("string")}
        return special[rule.pattern] if rule.pattern in special else F.when(body.rlike(rule.pattern), F.regexp_extract(body, rule.pattern, 0))
    return F.lit(None).cast("string")  # an unknown kind finds nothing


def extracted(rows: DataFrame, rules: list[Rule], id_col: str) -> DataFrame:
    """(id, name, value, found, error) for each row and rule: found values are transformed, else the default stands, else a required rule errs.

    rows have body, headers, cookies, status_code and content_type. The rules are unrolled into one scan.
    """
    parts = []
    for rule in rules:
        raw = found_value(rule, F.col("body"), F.col("headers"), F.col("cookies"), F.col("status_code"), F.col("content_type"))
        value = F.when(raw.isNotNull(), transformed(raw, rule.transform)).otherwise(F.lit(rule.default or None))
        error = F.when(value.isNull() & F.lit(rule.required), F.lit(f"required value {rule.name!r} not found"))
        parts.append(F.struct(F.lit(rule.name).alias("name"), value.alias("value"), raw.isNotNull().alias("found"), error.alias("error")))
    return rows.select(id_col, F.explode(F.array(*parts)).alias("x")).select(id_col, "x.name", "x.value", "x.found", "x.error")


def extracted_maps(rows: DataFrame, rules: list[Rule], id_col: str) -> DataFrame:
    """(id, values): found or default values as a map."""
    one = extracted(rows, rules, id_col).where(F.col("value").isNotNull())
    return one.groupBy(id_col).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("values"))


def stored_values(rows: DataFrame, rules: list[Rule], id_col: str, source: str, ts: Column) -> DataFrame:
    """What an extraction adds to the value pool: found, non-empty values with their source and time."""
    return extracted(rows, rules, id_col).where(F.col("found") & (F.col("value") != "")).select(F.col("name").alias("key"), "value", F.lit(source).alias("source"), ts.alias("created_at"), F.col(id_col).alias("seq"))


def pattern_matches(rows: DataFrame, id_col: str, body: str, patterns: dict[str, tuple[str, ...]] = PATTERNS) -> DataFrame:
    """(id, type, pattern, match, position): every match; position is the byte offset at which the matched text first occurs."""
    scans = []
    for kind, regexes in patterns.items():
        for p in regexes:
            found = F.regexp_extract_all(body, F.lit(p), F.lit(0))
            scans.append(F.struct(F.lit(kind).alias("type"), F.lit(p).alias("pattern"), found.alias("matches")))
    hit = rows.select(id_col, F.col(body).alias("__b"), F.explode(F.filter(F.array(*scans), lambda s: F.size(s["matches"]) > 0)).alias("s"))
    one = hit.select(id_col, "__b", "s.type", "s.pattern", F.explode("s.matches").alias("match"))
    before = F.expr("left(__b, instr(__b, match) - 1)")
    return one.select(id_col, "type", "pattern", "match", F.octet_length(before).alias("position"))


def header_audit(rows: DataFrame, id_col: str) -> DataFrame:
    """(id, header, issue, severity): missing headers, empty required ones, and disclosures; names are compared exactly."""
    parts = []
    for name, required, severity in HEADERS:
        value = F.try_element_at("headers", F.lit(name))
        issue = F.when(value.isNull(), "missing").when((value == "") & F.lit(required), "empty")
        parts.append(F.when(issue.isNotNull(), F.struct(F.lit(name).alias("header"), issue.alias("issue"), F.lit(severity).alias("severity"))))
    for name in DISCLOSING:
        value = F.try_element_at("headers", F.lit(name))
        parts.append(F.when(value.isNotNull() & (value != ""), F.struct(F.lit(name).alias("header"), F.lit("disclosed").alias("issue"), F.lit("low").alias("severity"))))
    met = rows.select(id_col, F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("x"))
    return met.select(id_col, "x.header", "x.issue", "x.severity")


def assertion(kind: str, target: str, expected: str, negate: bool = False, compare_lengths: bool = False) -> Column:
    """Whether a recorded response meets an assertion; rows have status_code, body, headers, response_time_ns.

    A length must equal the number; `>` and `<` before it can never hold, as in the reference, unless compare_lengths.
    """
    body, size = F.col("body"), F.octet_length("body")
    number = F.lit(expected).try_cast("bigint")
    bound = F.lit(expected[1:].strip() if expected[:1] in "<>" else None).try_cast("bigint")
    compared = F.when(F.lit(expected[:1] == ">"), size > bound).when(F.lit(expected[:1] == "<"), size < bound)
    found = {
        "status": lambda: F.col("status_code") == number,
        "contains": lambda: body.contains(expected),
        "not_contains": lambda: ~body.contains(expected),
        "regex": lambda: body.rlike(expected),
        "jsonpath": lambda: (F.get_json_object(body, json_path(target)) if is_plain(target) else json_value(body, target)) == expected,
        "header": lambda: header_value(F.col("headers"), target) == expected,
        "length": lambda: F.coalesce(compared, size == number) if compare_lengths else size == number,
        "time": lambda: F.col("response_time_ns") <= X.duration_ns(F.lit(expected)),
    }[kind]()
    met = F.coalesce(found, F.lit(False))
    return ~met if negate else met


# --- Links and forms --------------------------------------------------------------------------------------------

_SOURCES = {"a": "href", "link": "href", "script": "src", "img": "src", "iframe": "src", "embed": "src", "video": "src", "audio": "src", "source": "src"}
_SKIPPED = ("#", "javascript:", "mailto:", "tel:", "data:")


def resolved(base: str, link: str | None) -> str:
    """The link against its base by RFC 3986; empty for what leads nowhere."""
    link = (link or "").strip()
    if not link or link.lower().startswith(_SKIPPED):
        return ""
    try:
        return urljoin(base, link)
    except ValueError:
        return ""


class _Links(HTMLParser):
    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.links, self.forms = base, [], []
        self.form: dict | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag in _SOURCES and (url := resolved(self.base, a.get(_SOURCES[tag]))):
            self.links.append((tag, url))
        elif tag == "form":
            self.form = {"action": resolved(self.base, a.get("action")) or self.base, "method": (a.get("method") or "GET").upper(), "enctype": a.get("enctype") or "application/x-www-form-urlencoded", "inputs": []}
            self.forms.append(self.form)
        elif tag in ("input", "textarea", "select") and self.form is not None and a.get("name"):
            self.form["inputs"].append(a["name"])

    def handle_endtag(self, tag: str) -> None:
        if tag == "form":
            self.form = None


def links_and_forms(rows: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(id, kind, tag, url, method, inputs) of every link and form of each page, parsed with a tolerant parser in Arrow batches."""

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, url, page in zip(batch.iloc[:, 0], batch.iloc[:, 1], batch.iloc[:, 2]):
                parser = _Links(url or "")
                parser.feed(page or "")
                out += [(key, "link", tag, link, None, None) for tag, link in parser.links]
                out += [(key, "form", "form", f["action"], f["method"], ",".join(f["inputs"])) for f in parser.forms]
            yield pd.DataFrame(out, columns=[id_col, "kind", "tag", "url", "method", "inputs"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, url_col, html_col).mapInPandas(parsed, f"`{id_col}` {kind}, kind string, tag string, url string, method string, inputs string")


# --- Queries ----------------------------------------------------------------------------------------------------


def _recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses with headers and cookies made from their columns."""
    r = spread(responses(spark, sf_dir))
    odd = F.col("seq") % 2 == 1
    headers = F.map_concat(
        F.create_map(F.lit("Content-Type"), F.lit("application/json"), F.lit("X-Frame-Options"), F.when(F.col("seq") % 3 == 0, "").otherwise("DENY")),
        F.when(odd, F.create_map(F.lit("Server"), F.concat(F.lit("srv/"), F.col("target")))).otherwise(F.create_map().cast("map<string,string>")),
    )
    return r.withColumns({"headers": headers, "cookies": F.create_map(F.lit("PHPSESSID"), F.md5(F.col("target").cast("string"))), "content_type": F.lit("application/json")})


_RULES = [
    Rule("k", "jsonpath", "k", required=True),
    Rule("digits", "regex", r'"k":\s*(\d\d)', default="none"),
    Rule("server", "header", "server", transform="upper"),
    Rule("session", "cookie", "PHPSESSID"),
    Rule("status", "custom", "status_code"),
    Rule("size", "custom", "body_length"),
    Rule("absent", "jsonpath", "missing.0.id", required=True),
]
_EXTRACT_SQL = f"""WITH {RESPONSES_SQL},
x AS (SELECT seq, 'k' AS name, body->>'$.k' AS value, (body->>'$.k') IS NOT NULL AS found, CASE WHEN (body->>'$.k') IS NULL THEN 'required value ''k'' not found' END AS error FROM responses
UNION ALL SELECT seq, 'digits', CASE WHEN regexp_matches(body, '"k":\\s*(\\d\\d)') THEN regexp_extract(body, '"k":\\s*(\\d\\d)', 1) ELSE 'none' END, regexp_matches(body, '"k":\\s*(\\d\\d)'), NULL FROM responses
UNION ALL SELECT seq, 'server', CASE WHEN seq % 2 = 1 THEN 'SRV/' || target END, seq % 2 = 1, NULL FROM responses
UNION ALL SELECT seq, 'session', md5(CAST(target AS VARCHAR)), true, NULL FROM responses UNION ALL SELECT seq, 'status', CAST(status_code AS VARCHAR), true, NULL FROM responses
UNION ALL SELECT seq, 'size', CAST(content_length AS VARCHAR), true, NULL FROM responses UNION ALL SELECT seq, 'absent', NULL, false, 'required value ''absent'' not found' FROM responses)"""


@R.query("extract_rules", _EXTRACT_SQL + " SELECT * FROM x")
def extract_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(_recorded(spark, sf_dir), _RULES, "seq")


@R.query("extract_and_store", _EXTRACT_SQL + " SELECT name AS key, count(*) AS n, count(DISTINCT value) AS distinct_values FROM x WHERE found AND value <> '' GROUP BY 1")
def extract_and_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = stored_values(_recorded(spark, sf_dir), _RULES, "seq", "response", F.current_timestamp())
    return stored.groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("value").alias("distinct_values"))


@R.query("json_extract", "SELECT event_id AS seq, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.get_json_object("props", json_path("k")).cast("bigint").alias("k"))


_SCAN = {"title": (r"<title>[^<]*</title>",), "script": (r"<script>[^<]*",), "utm": (r"utm_[a-z]+",), "heading": (r"<h[1-6]>[^<]{0,20}",)}


@R.query("regex_pattern_scan", " UNION ALL ".join(f"SELECT page_id, '{k}' AS type, '{p}' AS pattern, m AS match, CAST(octet_length(encode(left(html, strpos(html, m) - 1))) AS INTEGER) AS position FROM (SELECT page_id, html, unnest(regexp_extract_all(html, '{p}')) AS m FROM pages)" for k, v in _SCAN.items() for p in v))
def regex_pattern_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pattern_matches(pages(spark, sf_dir), "page_id", "html", _SCAN)


@R.query("response_findings", "SELECT type, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS type, unnest(regexp_extract_all(html, '{p.replace("'", "''")}')) AS m FROM pages" for k, v in PATTERNS.items() for p in v) + ") GROUP BY 1")
def response_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pattern_matches(pages(spark, sf_dir), "page_id", "html").groupBy("type").agg(F.count("*").alias("n"))


#: A text with one place for each pattern of the registry, and its near misses.
_ODD_TEXTS = (
    "You have an error in your SQL syntax near x", "MySQL server error", "PostgreSQL query error", "SQLite disk error", "Oracle listener error ORA-00933", "quoted string not properly terminated", "Unclosed quotation mark SQLSTATE[42000]", "Warning: mysql_query() and Warning: pg_exec()", "Microsoft SQL Server ODBC 17 Driver",
    "<a onclick = 'x()'>javascript:void <img src=x onerror =1> <svg/x onload=1>", "uid=0(root) gid=0", "root:x:0:0:root", "[boot loader] Volume Serial Number; Directory of C", "[fonts] [extensions] Warning: include(a) failed to open stream", "external entity, entity x not defined, SYSTEM file:", "ami-0abc instance-id 169.254.169.254 Internal  Server",
    "password : a api_key= b secret-key: c private_key access-token aws_secret", "-----BEGIN RSA PRIVATE KEY----- jdbc:x://y mongodb://u:p@h", "Stack trace: at a.b(C.java:12) Exception in thread Traceback (most recent Parse error: Fatal error: Undefined index", "nothing here: uid= root: at a b ami",
)


@R.query("response_findings_by_pattern", "WITH t AS (SELECT event_id AS seq, list_extract([" + ", ".join("'" + t.replace("'", "''") + "'" for t in _ODD_TEXTS) + f"], CAST(event_id % {len(_ODD_TEXTS)} + 1 AS BIGINT)) AS body FROM events) SELECT type, pattern, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS type, '{q}' AS pattern, unnest(regexp_extract_all(body, '{q}')) AS m FROM t" for k, v in PATTERNS.items() for p in v for q in [p.replace("'", "''")]) + ") GROUP BY 1, 2")
def response_findings_by_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pattern of the registry over texts that hold each of them."""
    body = F.element_at(F.array(*[F.lit(t) for t in _ODD_TEXTS]), (F.col("event_id") % len(_ODD_TEXTS) + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), body.alias("body"))
    return pattern_matches(rows, "seq", "body").groupBy("type", "pattern").agg(F.count("*").alias("n"))


_NAMED_SQL = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FINDING_TYPES.items()) + " END"


@R.query("reported_findings", "WITH t AS (SELECT event_id AS seq, list_extract([" + ", ".join("'" + t.replace("'", "''") + "'" for t in _ODD_TEXTS) + f"], CAST(event_id % {len(_ODD_TEXTS)} + 1 AS BIGINT)) AS body FROM events) SELECT {_NAMED_SQL} AS type, count(*) AS findings, count(DISTINCT seq) AS responses FROM (" + " UNION ALL ".join(f"SELECT seq, '{k}' AS type, unnest(regexp_extract_all(body, '{q}')) AS m FROM t" for k, v in PATTERNS.items() for p in v for q in [p.replace("'", "''")]) + ") GROUP BY 1")
def reported_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings under the names that stored reports carry, so that they can be joined with them."""
    body = F.element_at(F.array(*[F.lit(t) for t in _ODD_TEXTS]), (F.col("event_id") % len(_ODD_TEXTS) + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), body.alias("body"))
    found = pattern_matches(rows, "seq", "body").select(finding_type(F.col("type")).alias("type"), F.col("seq"))
    return found.groupBy("type").agg(F.count("*").alias("findings"), F.count_distinct("seq").alias("responses"))


@R.query("header_audit", f"""WITH {RESPONSES_SQL}, h AS (SELECT * FROM (VALUES ('Strict-Transport-Security', 'medium'), ('X-Content-Type-Options', 'low'), ('X-XSS-Protection', 'low'), ('Content-Security-Policy', 'medium'), ('Referrer-Policy', 'low'), ('Permissions-Policy', 'low')) v(header, severity))
SELECT header, 'missing' AS issue, severity, count(*) AS n FROM responses, h GROUP BY ALL UNION ALL SELECT 'X-Frame-Options', 'empty', 'medium', count(*) FILTER (seq % 3 = 0) FROM responses UNION ALL SELECT 'Server', 'disclosed', 'low', count(*) FILTER (seq % 2 = 1) FROM responses""")
def header_audit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return header_audit(_recorded(spark, sf_dir), "seq").groupBy("header", "issue", "severity").agg(F.count("*").alias("n"))


_CHECKS = [("ok", "status", "", "200", False), ("has_k", "contains", "", '"k"', False), ("no_two", "regex", "", r'"k": 2\d', True), ("k_is_7", "jsonpath", "k", "7", False), ("ct", "header", "content-type", "application/json", False), ("len9", "length", "", "9", False), ("longer", "length", "", ">8", False), ("fast", "time", "", "50ms", False)]


@R.query("assertions", f"""WITH {RESPONSES_SQL} SELECT count(*) FILTER (status_code = 200) AS ok, count(*) FILTER (contains(body, '"k"')) AS has_k, count(*) FILTER (NOT regexp_matches(body, '"k": 2\\d')) AS no_two, count(*) FILTER (body->>'$.k' = '7') AS k_is_7, count(*) AS ct,
 count(*) FILTER (content_length = 9) AS len9, CAST(0 AS BIGINT) AS longer, count(*) FILTER (response_time_ns <= 50000000) AS fast FROM responses""")
def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recorded(spark, sf_dir).agg(*[F.count_if(assertion(kind, target, expected, negate)).alias(name) for name, kind, target, expected, negate in _CHECKS])


@R.query("links_extracted", """SELECT tag, count(*) AS n FROM (SELECT 'a' AS tag, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS h FROM pages) WHERE h <> '' GROUP BY 1""")
def links_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links_and_forms(pages(spark, sf_dir), "page_id", "url", "html").where("kind = 'link'").groupBy("tag").agg(F.count("*").alias("n"))


@R.query("links_resolved", """SELECT page_id, regexp_extract(url, '^[A-Za-z]+://[^/?#]*') || h AS url FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)) AS h FROM pages)""")
def links_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link of an anchor, against its page's url."""
    return links_and_forms(pages(spark, sf_dir), "page_id", "url", "html").where("kind = 'link' and tag = 'a'").select("page_id", "url")


@R.query("preset_rules", """SELECT event_id AS seq, name, CASE name WHEN 'csrf_token' THEN CASE WHEN event_id % 2 = 0 THEN 't' || user_id END WHEN 'session_id' THEN 's' || user_id WHEN 'access_token' THEN CASE WHEN event_id % 2 = 1 THEN 'a' || user_id END ELSE '/to/' || user_id END AS value
FROM events, (VALUES ('csrf_token'), ('session_id'), ('access_token'), ('redirect')) n(name)""")
def preset_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All presets over responses whose bodies are in turn a form and a JSON document."""
    e = table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    body = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('<input name="csrf_token" value="t'), user, F.lit('">'))).otherwise(F.concat(F.lit('{"access_token": "a'), user, F.lit('"}')))
    rows = e.select(F.col("event_id").alias("seq"), body.alias("body"), F.create_map(F.lit("location"), F.concat(F.lit("/to/"), user)).alias("headers"), F.create_map(F.lit("PHPSESSID"), F.concat(F.lit("s"), user)).alias("cookies"), F.lit(200).alias("status_code"), F.lit("").alias("content_type"))
    return extracted(rows, list(PRESETS.values()), "seq").select("seq", "name", "value")


@R.query("forms_extracted", "SELECT page_id, regexp_extract(url, '^[A-Za-z]+://[^/?#]*') || '/login' AS url, 'POST' AS method, 'user,note,s' AS inputs FROM pages")
def forms_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a login form put behind their html, so that there is something to find."""
    form = '<form action="/login" method="post"><input name="user"><textarea name="note"></textarea><select name="s"></select></form>'
    p = pages(spark, sf_dir).withColumn("html", F.concat("html", F.lit(form)))
    return links_and_forms(p, "page_id", "url", "html").where("kind = 'form'").select("page_id", "url", "method", "inputs")
