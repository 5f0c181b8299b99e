"""Files that hold lists, corpora, caches and reports: readers, writers and renderers."""

from __future__ import annotations

import functools
import html
import json
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import truncated
from ..operators.ordered import resident_after
from ..operators.stats import ANOMALIES_SQL, anomalies
from ..registry import Registry
from ..shared import settled, shared_folder
from ..streaming.stateful import pruned_periodically
from ..views import responses, table

R = Registry()

RESPONSES_SCHEMA = "url string, method string, status_code int, headers map<string,string>, body binary, response_time_ns bigint, error string, ts timestamp"
SEVERITIES = ("critical", "high", "medium", "low", "info")


def read_responses(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Recorded responses; JSON gets the schema, so that nothing is inferred in a pass of its own."""
    reader = spark.read.schema(RESPONSES_SCHEMA) if kind == "json" else spark.read
    return reader.format(kind).load(path)


def stream_responses(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """The same rows as a stream; the number of files per trigger bounds a micro-batch."""
    return spark.readStream.schema(RESPONSES_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path)


def read_wordlist(spark: SparkSession, path: str) -> DataFrame:
    """(value) of a list with one value per line; blank lines and lines that start with # are left out."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where((F.col("value") != "") & ~F.col("value").startswith("#"))


def write_corpus(entries: DataFrame, path: str) -> None:
    """Corpus entries by kind (queue or crashes): partitions, so that a kind is read alone."""
    entries.write.mode("append").partitionBy("kind").parquet(path)


def read_corpus(spark: SparkSession, path: str, kind: str = "queue") -> DataFrame:
    return spark.read.parquet(path).where(F.col("kind") == kind)


def read_corpus_files(spark: SparkSession, data_path: str, meta_path: str) -> DataFrame:
    """Entries stored as a file per hash with metadata in `<hash>.json` beside it."""
    data = spark.read.format("binaryFile").option("pathGlobFilter", "[!.]*").load(data_path)
    data = data.where(~F.col("path").endswith(".json")).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("hash"), F.col("content").alias("data"))
    meta = spark.read.schema("hash string, edges int, is_seed boolean, favored boolean").json(meta_path)
    return data.join(meta, "hash", "left")


def cache_store(entries: DataFrame, path: str) -> None:
    """Append cache entries with the file name of their key, its SHA-256."""
    entries.withColumn("file", F.concat(F.sha2("key", 256), F.lit(".cache"))).write.mode("append").parquet(path)


def cache_delete(keys: DataFrame, path: str, moment: Column) -> None:
    """Append a tombstone for each key: it hides every entry of the key that is not newer than `moment`."""
    marked = keys.select("key").distinct().withColumns({"created": moment, "deleted": F.lit(True)})
    cache_store(marked, path)


def cache_read(spark: SparkSession, path: str) -> DataFrame:
    """Everything that was written, with `deleted`: parts with and without tombstones have one schema."""
    rows = spark.read.option("mergeSchema", True).parquet(path)
    return rows.withColumn("deleted", F.coalesce("deleted", F.lit(False)) if "deleted" in rows.columns else F.lit(False))


def cache_live(spark: SparkSession, path: str, moment: Column, versions: bool = False) -> DataFrame:
    """What a read at `moment` finds: each key's newest entry by `created`, unless that has expired or was deleted; older ones are overwritten.

    Of entries of one time a tombstone decides. With `versions` a store keeps what was overwritten, and an older entry that has
    not expired, if it is newer than the key's last tombstone, stands in for a newer one that has. One aggregate that
    combines before the shuffle.
    """
    rows = cache_read(spark, path)
    alive = F.col("expires").isNull() | (F.col("expires") >= moment)
    rest = [c for c in rows.columns if c not in ("key", "created", "deleted")]
    if not versions:
        newest = rows.groupBy("key").agg(F.max(F.struct("created", "deleted", *rest)).alias("r")).select("key", "r.*")
        return newest.where(~F.col("deleted") & alive).drop("deleted")
    last = F.max(F.when(~F.col("deleted") & alive, F.struct("created", *rest))).alias("r")
    found = rows.groupBy("key").agg(last, F.max(F.when(F.col("deleted"), F.col("created"))).alias("gone"))
    return found.where(F.col("r").isNotNull() & (F.col("gone").isNull() | (F.col("r.created") > F.col("gone")))).select("key", "r.*")


def cache_compact(spark: SparkSession, path: str, target: str, moment: Column, capacity: int | None = None) -> None:
    """Write what is live at `moment`, within `capacity` bytes if given, to a new store; readers change over when it is complete."""
    live = cache_live(spark, path, moment)
    (live if capacity is None else cache_evicted(live, capacity)).write.mode("errorifexists").parquet(target)


def cache_put(entries: DataFrame, path: str, moment: Column, capacity: int) -> None:
    """Append entries (key, created, expires, size, ...), then tombstones for the oldest live ones beyond `capacity` bytes.

    A tombstone carries its entry's own time, so that a later write of the key counts again.
    """
    cache_store(entries, path)
    live = settled(cache_live(entries.sparkSession, path, moment))
    gone = live.join(cache_evicted(live, capacity).select("key"), "key", "left_anti")
    cache_store(gone.select("key", "created").withColumn("deleted", F.lit(True)), path)


def cache_evicted(rows: DataFrame, capacity: int) -> DataFrame:
    """What stays of a cache's entries (key, created, size) within `capacity` bytes: the oldest created go first."""
    entries = rows.select(*rows.columns, F.timestamp_seconds("created").alias("ts"), F.xxhash64("key").alias("seq"))
    kept = resident_after(entries, capacity)
    return kept.select(*rows.columns)


# --- Reports ----------------------------------------------------------------------------------------------------


def report(rows: DataFrame, most: int = 1000) -> dict:
    """A report of anomalies (id, severity, type, description): counts over all rows, details of the first `most` by id."""
    by = rows.groupBy("severity", "type").agg(F.count("*").alias("n")).collect()  # severities x types
    severity, kind = {}, {}
    for r in by:
        severity[r.severity] = severity.get(r.severity, 0) + r.n
        kind[r.type] = kind.get(r.type, 0) + r.n
    details = rows.orderBy("id").limit(most).select("id", "severity", "type", truncated(F.col("description"), 500).alias("description")).collect()
    return {"found": sum(severity.values()), "severity": severity, "type": kind, "anomalies": [r.asDict() for r in details]}


def as_json(content: dict) -> str:
    return json.dumps(content, indent=2, ensure_ascii=False, default=str)


def as_markdown(content: dict) -> str:
    """Totals, severities in fixed order (those that occur), then the details."""
    lines = ["# Report", "", "| Metric | Value |", "|---|---|", f"| Anomalies | {content['found']} |", "", "| Severity | Count |", "|---|---|"]
    lines += [f"| {s} | {content['severity'][s]} |" for s in SEVERITIES if content["severity"].get(s)]
    for a in content["anomalies"]:
        short = a["description"] if len(a["description"]) <= 100 else a["description"][:100] + "..."
        lines += ["", f"## {a['id']} ({a['severity']}, {a['type']})", "", short]
    return "\n".join(lines) + "\n"


def as_html(content: dict, template: str = "<html><body><h1>Report</h1><p>{found}</p><table>{rows}</table></body></html>") -> str:
    rows = "".join(f'<tr class="{a["severity"]}"><td>{html.escape(str(a["id"]))}</td><td>{html.escape(a["type"])}</td><td>{html.escape(a["description"])}</td></tr>' for a in content["anomalies"])
    return template.format(found=content["found"], rows=rows)


class Reports:
    """Named generators; a format may be added, and `all` writes each file ending once."""

    def __init__(self) -> None:
        self.formats: dict[str, tuple[str, Callable[[dict], str]]] = {"json": ("json", as_json), "html": ("html", as_html), "markdown": ("md", as_markdown), "md": ("md", as_markdown)}

    def register(self, name: str, ending: str, generate: Callable[[dict], str]) -> None:
        self.formats[name] = (ending, generate)

    def render(self, content: dict, name: str) -> str:
        return self.formats[name][1](content)

    def all(self, content: dict, moment: datetime) -> dict[str, str]:
        first: dict[str, Callable[[dict], str]] = {}
        for ending, generate in self.formats.values():
            first.setdefault(ending, generate)
        return {f"report_{moment:%Y%m%d_%H%M%S}.{ending}": generate(content) for ending, generate in first.items()}


#: Report sections by format, each a column over (id, severity, type, description); callers may add their own.
SECTIONS: dict[str, Callable[[], Column]] = {
    "json": lambda: F.to_json(F.struct("id", "severity", "type", "description")),
    "markdown": lambda: F.concat(F.lit("## "), F.col("id"), F.lit(" ("), "severity", F.lit(", "), "type", F.lit(")\n\n"), truncated(F.col("description"), 100)),
    "html": lambda: F.concat(F.lit('<tr class="'), "severity", F.lit('"><td>'), F.col("id"), F.lit("</td><td>"), _escaped(F.col("type")), F.lit("</td><td>"), _escaped(F.col("description")), F.lit("</td></tr>")),
}
ENDINGS = {"json": "json", "html": "html", "markdown": "md"}


def _escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def report_sections(rows: DataFrame, kind: str, formats: dict[str, Callable[[], Column]] | None = None) -> DataFrame:
    """(id, section): one section for each anomaly, none left out, made by the executors."""
    return rows.select("id", (SECTIONS | (formats or {}))[kind]().alias("section"))


def write_reports(rows: DataFrame, folder: str, moment: datetime, formats: dict[str, Callable[[], Column]] | None = None, endings: dict[str, str] | None = None) -> list[str]:
    """All formats as folders of text files in order of id, each file ending once; their paths.

    Nothing is gathered: sections are dealt out by ranges of id, and part files are in that order.
    """
    made, known = {}, ENDINGS | (endings or {})
    for kind in SECTIONS | (formats or {}):
        made.setdefault(known.get(kind, kind), kind)
    paths = []
    for ending, kind in made.items():
        path = f"{folder}/report_{moment:%Y%m%d_%H%M%S}.{ending}"
        report_sections(rows, kind, formats).repartitionByRange("id").sortWithinPartitions("id").select(F.col("section").alias("value")).write.text(path)
        paths.append(path)
    return paths


def stats(rows: DataFrame) -> DataFrame:
    """What the read endpoint gives: all anomalies, and those of each severity."""
    return rows.agg(F.count("*").alias("total"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])


def logs(rows: DataFrame, after: int = 0, most: int = 100) -> DataFrame:
    """A page of a log: rows (id, ...) behind an id, in order."""
    return rows.where(F.col("id") > after).orderBy("id").limit(most)


# --- Queries: what is written is read again, from a folder of its own below the shared one ------------------------


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stores-{uuid.uuid4().hex}"


@R.query("wordlist_values", """SELECT doc_id % 100 AS k, count(*) AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY 1""")
def wordlist_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list with comments, blank lines and blanks around its values, written and read."""
    d = table(spark, sf_dir, "documents").where("lang is not null and source is not null")
    lines = d.select(F.explode(F.array(F.concat(F.lit("  "), (F.col("doc_id") % 100).cast("string"), F.lit(" ")), F.lit("# a comment"), F.lit("   "))).alias("value"))
    lines.write.text(path := _folder(spark))
    return read_wordlist(spark, path).groupBy(F.col("value").cast("long").alias("k")).agg(F.count("*").alias("n"))


_RECORDS_SQL = "SELECT 'https://h/' || user_id AS url, 'GET' AS method, CAST(CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS INTEGER) AS status_code, CAST(octet_length(encode(props)) AS INTEGER) AS size, count(*) AS n FROM events GROUP BY ALL"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = responses(spark, sf_dir)
    named = r.select(F.concat(F.lit("https://h/"), "target").alias("url"), F.lit("GET").alias("method"), F.col("status_code"), F.create_map(F.lit("A"), F.lit("b")).alias("headers"), F.encode("body", "UTF-8").alias("body"), "response_time_ns", F.lit(None).cast("string").alias("error"), F.col("ts").cast("timestamp"))
    return named.withColumn("status_code", F.col("status_code").cast("int"))


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("url", "method", "status_code", F.octet_length("body").alias("size")).agg(F.count("*").alias("n"))


@R.query("recorded_responses", _RECORDS_SQL)
def recorded_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    _records(spark, sf_dir).write.json(path := _folder(spark))
    return _counted(read_responses(spark, path, "json"))


@R.query("streamed_responses", _RECORDS_SQL)
def streamed_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files read as a stream until none is left, and written as a table."""
    folder = _folder(spark)
    _records(spark, sf_dir).repartition(3).write.json(f"{folder}/in")
    query = stream_responses(spark, f"{folder}/in", 1).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
    query.awaitTermination()
    return _counted(spark.read.parquet(f"{folder}/out"))


@R.query("stored_corpus", "SELECT sha256(text) AS hash, doc_id FROM documents WHERE doc_id % 4 = 0 AND text IS NOT NULL")
def stored_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of two kinds, of which one is read back."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    kind = F.when(F.col("doc_id") % 4 == 0, "crashes").otherwise("queue")
    write_corpus(d.select("doc_id", F.sha2("text", 256).alias("hash"), kind.alias("kind")), path := _folder(spark))
    return read_corpus(spark, path, "crashes").select("hash", "doc_id")


@R.query("cache_live_entries", """SELECT CAST(user_id AS VARCHAR) AS key, max(event_id) AS value FROM events WHERE event_id % 3 <> 0 GROUP BY 1""")
def cache_live_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries stored in two appends, a third of them expired: the newest live one of each key."""
    e = table(spark, sf_dir, "events")
    moment = F.lit("2030-01-01").cast("timestamp_ntz")
    expires = F.when(F.col("event_id") % 3 == 0, F.lit("2029-12-31").cast("timestamp_ntz")).when(F.col("event_id") % 3 == 1, moment)
    entries = e.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("created"), expires.alias("expires"), F.col("event_id").alias("value"))
    path = _folder(spark)
    for part in (0, 1):
        cache_store(entries.where(F.col("created") % 2 == part), path)
    return cache_live(spark, path, moment, versions=True).select("key", "value")


#: What is written, deleted and read: as a log per key, of which the last line decides.
_STORE_SQL = """w AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id AS created, false AS deleted, event_id % 3 <> 0 AS alive, CAST(octet_length(encode(props)) AS BIGINT) AS size FROM events),
d AS (SELECT CAST(user_id AS VARCHAR) AS key, (SELECT max(event_id) FROM events) // 2 AS created, true AS deleted, false AS alive, NULL::BIGINT AS size FROM events WHERE user_id % 5 = 0 GROUP BY 1),
n AS (SELECT * FROM (SELECT * FROM w UNION ALL SELECT * FROM d) QUALIFY row_number() OVER (PARTITION BY key ORDER BY created DESC, deleted DESC) = 1), live AS (SELECT * FROM n WHERE NOT deleted AND alive)"""


def _overwritten(spark: SparkSession, sf_dir: str, path: str) -> Column:
    """Entries in two appends, a third of them expired at the moment that is returned, and every fifth key deleted half way."""
    e = table(spark, sf_dir, "events")
    moment = F.lit("2030-01-01").cast("timestamp_ntz")
    expires = F.when(F.col("event_id") % 3 == 0, F.lit("2029-12-31").cast("timestamp_ntz")).when(F.col("event_id") % 3 == 1, moment)
    entries = e.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("created"), expires.alias("expires"), F.octet_length("props").cast("long").alias("size"))
    for part in (0, 1):
        cache_store(entries.where(F.col("created") % 2 == part), path)
    half = e.agg(F.max("event_id")).first()[0] // 2  # one number
    cache_delete(e.where("user_id % 5 = 0").select(F.col("user_id").cast("string").alias("key")), path, F.lit(half).cast("long"))
    return moment


@R.query("cache_overwrites", f"WITH {_STORE_SQL} SELECT key, created FROM live")
def cache_overwrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key whose newest entry has expired or was deleted is a miss, whatever was stored before."""
    path = _folder(spark)
    return cache_live(spark, path, _overwritten(spark, sf_dir, path)).select("key", "created")


@R.query("cache_compacted", f"WITH {_STORE_SQL}, u AS (SELECT *, sum(size) OVER (ORDER BY created DESC) AS used FROM live) SELECT key, created, size FROM u WHERE used <= 600")
def cache_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store written anew within a capacity."""
    path = _folder(spark)
    cache_compact(spark, path, f"{path}-next", _overwritten(spark, sf_dir, path), 600)
    return spark.read.parquet(f"{path}-next").select("key", "created", "size")


@R.query("cache_puts", """WITH a AS (SELECT CAST(user_id AS VARCHAR) AS key, max(event_id) AS created, CAST(arg_max(octet_length(encode(props)), event_id) AS BIGINT) AS size FROM events WHERE event_id % 2 = 0 GROUP BY 1),
b AS (SELECT key, created, size FROM (SELECT *, sum(size) OVER (ORDER BY created DESC) AS used FROM a) WHERE used <= 300), c AS (SELECT CAST(user_id AS VARCHAR) AS key, max(event_id) AS created, CAST(arg_max(octet_length(encode(props)), event_id) AS BIGINT) AS size FROM events WHERE event_id % 2 = 1 GROUP BY 1),
n AS (SELECT * FROM (SELECT * FROM b UNION ALL SELECT * FROM c) QUALIFY row_number() OVER (PARTITION BY key ORDER BY created DESC) = 1) SELECT key, created, size FROM (SELECT *, sum(size) OVER (ORDER BY created DESC) AS used FROM n) WHERE used <= 300""")
def cache_puts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of writes into a cache of 300 bytes: each evicts what is beyond it."""
    e = table(spark, sf_dir, "events")
    moment, path = F.lit("2030-01-01").cast("timestamp_ntz"), _folder(spark)
    entries = e.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("created"), F.lit(None).cast("timestamp_ntz").alias("expires"), F.octet_length("props").cast("long").alias("size"))
    for part in (0, 1):
        cache_put(entries.where(F.col("created") % 2 == part), path, moment, 300)
    return cache_live(spark, path, moment).select("key", "created", "size")


@R.query("cache_evictions", """WITH l AS (SELECT CAST(user_id AS VARCHAR) AS key, max(event_id) AS created, CAST(arg_max(octet_length(encode(props)), event_id) AS BIGINT) AS size FROM events GROUP BY 1), u AS (SELECT *, sum(size) OVER (ORDER BY created DESC) AS used FROM l) SELECT key, created, size FROM u WHERE used <= 500""")
def cache_evictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("created"), F.octet_length("props").cast("long").alias("size"))
    return cache_evicted(e, 500)


@R.query("pruned_batches", "SELECT count(*) AS entries, CAST(sum(event_id) AS BIGINT) AS total FROM events WHERE event_id % 3 <> 0")
def pruned_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus that comes in as a stream of files, pruned batch by batch until none is left."""
    folder = _folder(spark)
    table(spark, sf_dir, "events").select("event_id").repartition(3).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("event_id long").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = pruned_periodically(stream, f"{folder}/out", lambda batch: batch.where("event_id % 3 <> 0"), available=True)
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out").agg(F.count("*").alias("entries"), F.sum("event_id").alias("total"))


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomalies(spark, sf_dir).withColumn("description", F.concat(F.lit("<b> & 'x' "), F.repeat("type", 30)))


_DESCRIBED_SQL = ANOMALIES_SQL + ", described AS (SELECT *, '<b> & ''x'' ' || repeat(type, 30) AS description FROM anomalies)"


@R.query("report_markdown", f"WITH {_DESCRIBED_SQL} SELECT id, '## ' || id || ' (' || severity || ', ' || type || ')' || chr(10) || chr(10) || CASE WHEN length(description) > 100 THEN left(description, 100) || '...' ELSE description END AS section FROM described")
def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_sections(_described(spark, sf_dir), "markdown")


@R.query("report_html", f"""WITH {_DESCRIBED_SQL} SELECT id, '<tr class="' || severity || '"><td>' || id || '</td><td>' || type || '</td><td>&lt;b&gt; &amp; &#x27;x&#x27; ' || repeat(type, 30) || '</td></tr>' AS section FROM described""")
def report_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_sections(_described(spark, sf_dir), "html")


@R.query("custom_report", "WITH " + ANOMALIES_SQL + " SELECT id, severity || ';' || type AS section FROM anomalies")
def custom_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_sections(anomalies(spark, sf_dir), "csv", {"csv": lambda: F.concat_ws(";", "severity", "type")})


@R.query("written_reports", "WITH " + ANOMALIES_SQL + " SELECT ending, count(*) AS lines FROM anomalies, (VALUES ('csv'), ('html'), ('json')) e(ending) GROUP BY 1 UNION ALL SELECT 'md', 3 * count(*) FROM anomalies")
def written_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every format once, written as text and counted by lines; a Markdown section has three."""
    own = {"csv": lambda: F.concat_ws(";", "severity", "type"), "again": lambda: F.lit("x")}
    paths = write_reports(_described(spark, sf_dir), _folder(spark), datetime(2024, 1, 31), own, {"again": "csv"})
    read = [spark.read.text(p).groupBy(F.lit(p.rsplit(".", 1)[1]).alias("ending")).agg(F.count("*").alias("lines")) for p in paths]
    return functools.reduce(DataFrame.unionByName, read)


@R.query("read_endpoints", "WITH " + ANOMALIES_SQL + " SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in SEVERITIES) + " FROM anomalies")
def read_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats(anomalies(spark, sf_dir))


@R.query("log_page", "WITH " + ANOMALIES_SQL + " SELECT id, severity, type FROM anomalies WHERE id > 500 ORDER BY id LIMIT 50")
def log_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs(anomalies(spark, sf_dir), 500, 50).select("id", "severity", "type")


@R.query("report_json", """SELECT id, '{"id":' || id || ',"severity":"' || severity || '","type":"' || type || '"}' AS line FROM (SELECT o_orderkey AS id, CASE left(o_orderpriority, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' WHEN '4' THEN 'low' ELSE 'info' END AS severity, CASE o_orderstatus WHEN 'F' THEN 'status' WHEN 'O' THEN 'time' ELSE 'length' END AS type FROM orders)""")
def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON sink's lines, made by the executors."""
    return anomalies(spark, sf_dir).select("id", F.to_json(F.struct("id", "severity", "type")).alias("line"))


def monitor_payload(snapshot: DataFrame) -> DataFrame:
    """One JSON event per snapshot: its time, the running entities and how many there are."""
    running = F.count_if(F.col("status") == "running")
    return snapshot.groupBy("ts").agg(F.to_json(F.struct(F.lit("stats").alias("type"), running.alias("running"), F.count("*").alias("total"))).alias("value"))


@R.query("monitor_payloads", """SELECT CAST(o_orderdate AS DATE) AS ts, '{"type":"stats","running":' || count(*) FILTER (o_orderstatus = 'O') || ',"total":' || count(*) || '}' AS value FROM orders GROUP BY 1""")
def monitor_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return monitor_payload(o.select(F.to_date("o_orderdate").alias("ts"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("exited").alias("status")))
