"""Lookups and differences as joins: baselines, fingerprints, caches, snapshots, registrations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import Registry
from ..views import RESPONSES_SQL, docs, responses, snapshots, table

R = Registry()


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in order; the maximum of a struct, which combines before the shuffle."""
    rest = [c for c in rows.columns if c not in (*keys, *order)]
    return rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("__row")).select(*keys, "__row.*").select(*rows.columns)


def baseline_diff(current: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """What changed against the baseline of the same key; keys without one give no row.

    Times differ where they are off by more than half the baseline, in whole ns, and the baseline is positive.
    """
    b = baseline.select(key, *[F.col(c).alias(f"b_{c}") for c in ("status_code", "content_hash", "content_length", "response_time_ns")])
    j = current.join(b, key)
    delta = F.col("response_time_ns") - F.col("b_response_time_ns")
    out = j.withColumns(
        {
            "status_changed": F.col("status_code") != F.col("b_status_code"),
            "content_changed": F.col("content_hash") != F.col("b_content_hash"),
            "size_delta": F.col("content_length") - F.col("b_content_length"),
            "timing_changed": (F.col("b_response_time_ns") > 0) & (F.abs(delta) > F.expr("b_response_time_ns div 2")),
        }
    )
    changed = F.col("status_changed") | F.col("content_changed") | (F.col("size_delta") != 0) | F.col("timing_changed")
    return out.withColumn("has_changes", changed)


def keep_first_flags(rows: DataFrame, fingerprint: list[str], order: list[str]) -> DataFrame:
    """rows with `is_new`: no earlier row, in order, has the same fingerprint."""
    return rows.withColumn("is_new", F.row_number().over(Window.partitionBy(*fingerprint).orderBy(*order)) == 1)


def cache_key(method: Column, url: Column, body: Column) -> Column:
    """SHA-256 of method, url and body, without separators."""
    return F.sha2(F.concat(method, url, body), 256)


def tiered_lookup(keys: DataFrame, memory: DataFrame, disk: DataFrame, key: str) -> DataFrame:
    """(key, value, tier): from memory, else from disk, else null."""
    m = memory.select(key, F.col("value").alias("__m"), F.lit(True).alias("__hm"))
    d = disk.select(key, F.col("value").alias("__d"), F.lit(True).alias("__hd"))
    j = keys.join(m, key, "left").join(d, key, "left")
    tier = F.when(F.col("__hm"), "memory").when(F.col("__hd"), "disk").otherwise("miss")
    return j.select(key, F.when(F.col("__hm"), F.col("__m")).otherwise(F.col("__d")).alias("value"), tier.alias("tier"))


def snapshot_diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """(id, name, from_status, to_status) between two snapshots; missing ones are `removed`, new ones give no row."""
    a = before.select("id", F.col("name").alias("a_name"), F.col("status").alias("from_status"))
    b = now.select("id", F.col("name").alias("b_name"), F.col("status").alias("to_status"))
    j = a.join(b, "id", "full_outer").where(F.col("from_status").isNotNull() & (F.col("to_status").isNull() | (F.col("to_status") != F.col("from_status"))))
    name = F.when(F.col("to_status").isNull(), F.left(F.col("id").cast("string"), F.lit(12))).otherwise(F.col("b_name"))
    return j.select("id", name.alias("name"), "from_status", F.coalesce("to_status", F.lit("removed")).alias("to_status"))


def status_transitions(rows: DataFrame) -> DataFrame:
    """Each change of status of an entity, in order of (ts, seq)."""
    before = F.lag("status").over(Window.partitionBy("id").orderBy("ts", "seq"))
    return rows.withColumn("from_status", before).where(F.col("from_status").isNotNull() & (F.col("from_status") != F.col("status"))).withColumnRenamed("status", "to_status")


def worker_states(registrations: DataFrame, heartbeats: DataFrame) -> DataFrame:
    """The latest state per worker: a registration sets `idle`, a heartbeat updates only known workers."""
    known = heartbeats.join(registrations.groupBy("worker").agg(F.min("ts").alias("__since")), "worker").where(F.col("ts") >= F.col("__since")).drop("__since")
    both = registrations.withColumn("state", F.lit("idle")).select("worker", "ts", "seq", "state").unionByName(known.select("worker", "ts", "seq", "state"))
    return latest(both, ["worker"], ["ts", "seq"])


def ids_changed(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row, `changed`: whether the two sets of ids differ, from set differences instead of gathered lists."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    extra = x.exceptAll(y).unionAll(y.exceptAll(x))
    return extra.agg((F.count("*") > 0).alias("changed"))


def hashed_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = responses(spark, sf_dir)
    return r.withColumns({"content_hash": F.sha2("body", 256), "half": F.when(F.col("seq") % 2 == 0, 0).otherwise(1)})


_HASHED_SQL = f"{RESPONSES_SQL}, h AS (SELECT *, sha256(body) AS content_hash, seq % 2 AS half FROM responses)"


@R.query(
    "baseline_diff_join",
    f"""WITH {_HASHED_SQL}, l AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY target, half ORDER BY ts DESC, seq DESC) = 1), a AS (SELECT * FROM l WHERE half = 0), b AS (SELECT * FROM l WHERE half = 1)
SELECT b.target, b.status_code <> a.status_code AS status_changed, b.content_hash <> a.content_hash AS content_changed, b.content_length - a.content_length AS size_delta,
 a.response_time_ns > 0 AND abs(b.response_time_ns - a.response_time_ns) > a.response_time_ns // 2 AS timing_changed FROM a JOIN b USING (target)""",
)
def baseline_diff_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = latest(hashed_responses(spark, sf_dir), ["target", "half"], ["ts", "seq"])
    diff = baseline_diff(last.where("half = 1"), last.where("half = 0"), "target")
    return diff.select("target", "status_changed", "content_changed", "size_delta", "timing_changed")


@R.query("baseline_upsert", f"WITH {RESPONSES_SQL} SELECT target, seq, response_time_ns FROM responses QUALIFY row_number() OVER (PARTITION BY target ORDER BY ts DESC, seq DESC) = 1")
def baseline_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(responses(spark, sf_dir), ["target"], ["ts", "seq"]).select("target", "seq", "response_time_ns")


@R.query("exact_dup_keep_first", "SELECT doc_id, row_number() OVER (PARTITION BY md5(text), octet_length(encode(text)) ORDER BY doc_id) = 1 AS is_new FROM documents")
def exact_dup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select("doc_id", F.md5("text").alias("md5"), F.octet_length("text").alias("size"))
    return keep_first_flags(d, ["md5", "size"], ["doc_id"]).select("doc_id", "is_new")


@R.query("dup_semi", "SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM documents e WHERE e.source = 'src1' AND md5(e.text) = md5(d.text) AND e.doc_id <> d.doc_id)")
def dup_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select("doc_id", "source", F.md5("text").alias("md5"))
    known = d.where("source = 'src1'").select(F.col("md5").alias("k"), F.col("doc_id").alias("other"))
    return d.join(known, (F.col("md5") == F.col("k")) & (F.col("other") != F.col("doc_id")), "left_semi").select("doc_id")


@R.query("new_docs_anti", "SELECT doc_id FROM documents d WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE source = 'src1')")
def new_docs_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select("doc_id", "source", F.md5("text").alias("md5"))
    return d.join(d.where("source = 'src1'").select("md5"), "md5", "left_anti").select("doc_id")


@R.query("response_cache_key", "SELECT page_id, sha256('GET' || url || html) AS key FROM pages")
def response_cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", cache_key(F.lit("GET"), F.col("url"), F.col("html")).alias("key"))


@R.query("response_cache_lookup", "SELECT p.page_id, min(q.page_id) AS first_hit FROM pages p JOIN pages q ON sha256('GET' || q.url || q.html) = sha256('GET' || p.url || p.html) GROUP BY 1")
def response_cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = response_cache_key(spark, sf_dir)
    store = keyed.groupBy("key").agg(F.min("page_id").alias("first_hit"))
    return keyed.join(store, "key").select("page_id", "first_hit")


@R.query("tiered_lookup", """WITH k AS (SELECT DISTINCT user_id AS key FROM events), m AS (SELECT user_id AS key, max(event_id) AS value FROM events WHERE event_type = 'click' AND user_id % 3 = 0 GROUP BY 1), d AS (SELECT user_id AS key, min(event_id) AS value FROM events WHERE user_id % 2 = 0 GROUP BY 1)
SELECT k.key, coalesce(m.value, d.value) AS value, CASE WHEN m.key IS NOT NULL THEN 'memory' WHEN d.key IS NOT NULL THEN 'disk' ELSE 'miss' END AS tier FROM k LEFT JOIN m USING (key) LEFT JOIN d USING (key)""")
def tiered_lookup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("key", F.col("user_id"))
    memory = e.where("event_type = 'click' AND user_id % 3 = 0").groupBy("key").agg(F.max("event_id").alias("value"))
    disk = e.where("user_id % 2 = 0").groupBy("key").agg(F.min("event_id").alias("value"))
    return tiered_lookup(e.select("key").distinct(), memory, disk, "key")


def _two_snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The last state of each entity in the first and in the second half of January; some entities vanish."""
    s = snapshots(spark, sf_dir)
    before = latest(s.where("ts < timestamp'2024-01-16'"), ["id"], ["ts", "seq"])
    now = latest(s.where("ts >= timestamp'2024-01-16' AND id % 10 <> 3"), ["id"], ["ts", "seq"])
    return before, now


_TWO_SQL = """s AS (SELECT ts, event_id AS seq, user_id AS id, event_type AS status, 'c' || user_id AS name FROM events),
a AS (SELECT * FROM s WHERE ts < TIMESTAMP '2024-01-16' QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, seq DESC) = 1),
b AS (SELECT * FROM s WHERE ts >= TIMESTAMP '2024-01-16' AND id % 10 <> 3 QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, seq DESC) = 1)"""


@R.query("snapshot_diff", f"WITH {_TWO_SQL} SELECT a.id, CASE WHEN b.id IS NULL THEN left(CAST(a.id AS VARCHAR), 12) ELSE b.name END AS name, a.status AS from_status, coalesce(b.status, 'removed') AS to_status FROM a LEFT JOIN b ON a.id = b.id WHERE b.id IS NULL OR a.status <> b.status")
def snapshot_diff_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_diff(*_two_snapshots(spark, sf_dir))


@R.query("snapshot_removed", f"WITH {_TWO_SQL} SELECT id FROM a WHERE id NOT IN (SELECT id FROM b)")
def snapshot_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, now = _two_snapshots(spark, sf_dir)
    return before.join(now, "id", "left_anti").select("id")


@R.query("snapshot_ids_changed", f"WITH {_TWO_SQL} SELECT count(*) > 0 AS changed FROM ((SELECT id FROM a EXCEPT SELECT id FROM b) UNION ALL (SELECT id FROM b EXCEPT SELECT id FROM a))")
def snapshot_ids_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, now = _two_snapshots(spark, sf_dir)
    return ids_changed(before, now, "id")


@R.query("snapshot_stats_join", f"WITH {_TWO_SQL} SELECT b.id, b.status, count(e.event_id) AS samples, round(sum(e.value), 4) AS used FROM b JOIN events e ON e.user_id = b.id WHERE b.status = 'view' GROUP BY 1, 2")
def snapshot_stats_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, now = _two_snapshots(spark, sf_dir)
    samples = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_id", "value")
    j = now.where("status = 'view'").join(samples, "id")
    return j.groupBy("id", "status").agg(F.count("event_id").alias("samples"), F.round(F.sum("value"), 4).alias("used"))


@R.query("status_transitions", "SELECT id, seq, from_status, to_status FROM (SELECT user_id AS id, event_id AS seq, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_status, event_type AS to_status FROM events) WHERE from_status <> to_status")
def status_transitions_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status_transitions(snapshots(spark, sf_dir)).select("id", "seq", "from_status", "to_status")


def _workers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("worker"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("state"))
    return e.where("state = 'signup' AND worker % 4 <> 0"), e.where("state <> 'signup'")


@R.query("worker_upsert", """WITH e AS (SELECT user_id AS worker, ts, event_id AS seq, event_type AS state FROM events), r AS (SELECT * FROM e WHERE state = 'signup' AND worker % 4 <> 0), f AS (SELECT worker, min(ts) AS since FROM r GROUP BY 1),
u AS (SELECT worker, ts, seq, 'idle' AS state FROM r UNION ALL SELECT e.worker, e.ts, e.seq, e.state FROM e JOIN f USING (worker) WHERE e.state <> 'signup' AND e.ts >= since) SELECT worker, seq, state FROM u QUALIFY row_number() OVER (PARTITION BY worker ORDER BY ts DESC, seq DESC) = 1""")
def worker_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worker_states(*_workers(spark, sf_dir)).select("worker", "seq", "state")


@R.query("worker_liveness", "SELECT user_id AS worker, max(ts) AS last_seen, max(ts) < TIMESTAMP '2024-01-30 12:00:00' AS offline FROM events GROUP BY 1")
def worker_liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("worker")).agg(F.max("ts").alias("last_seen"))
    return e.withColumn("offline", F.col("last_seen") < F.expr("timestamp_ntz'2024-01-30 12:00:00'"))


@R.query("registry_probe", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def registry_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r.where("r_name = 'ASIA'"), n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")


@R.query("corpus_point_lookup", "SELECT doc_id FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id IN (3, 11, 45))")
def corpus_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("hash"))
    return d.join(d.where(F.col("doc_id").isin(3, 11, 45)).select("hash"), "hash", "left_semi").select("doc_id")


@R.query("findings_concat", "SELECT kind, count(*) AS n FROM (SELECT 'http' AS kind FROM pages WHERE starts_with(url, 'http://') UNION ALL SELECT 'query' FROM pages WHERE contains(url, '?') UNION ALL SELECT 'fragment' FROM pages WHERE contains(url, '#')) GROUP BY 1")
def findings_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    parts = [p.where(test).select(F.lit(kind).alias("kind")) for kind, test in (("http", F.col("url").startswith("http://")), ("query", F.col("url").contains("?")), ("fragment", F.col("url").contains("#")))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("kind").agg(F.count("*").alias("n"))
