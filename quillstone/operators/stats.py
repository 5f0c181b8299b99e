"""Roll-ups: request, severity, detector, cache, pool, cluster, disk and stability statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import Registry
from ..shared import folded
from ..views import RESPONSES_SQL, responses, table

R = Registry()
#: Nanoseconds that stand for a least response time where no request was recorded.
NO_REQUEST_NS = 3_600_000_000_000


def request_stats(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Total, success, failure, timeout, and sum, least and greatest response time; an empty input gives zeros and the sentinel."""
    ok = F.col("error").isNull() & (F.col("status_code") < 500)
    return rows.groupBy(*(keys or [])).agg(
        F.count("*").alias("total"),
        F.count_if(ok).alias("success"),
        F.count_if(~ok).alias("failure"),
        F.count_if(F.col("error") == "timeout").alias("timeouts"),
        F.coalesce(F.sum("response_time_ns"), F.lit(0)).alias("sum_ns"),
        F.coalesce(F.min("response_time_ns"), F.lit(NO_REQUEST_NS)).alias("min_ns"),
        F.coalesce(F.max("response_time_ns"), F.lit(0)).alias("max_ns"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


def derived_rates(stats: DataFrame, planned: Column) -> DataFrame:
    """Rate, mean, success share, progress and whole seconds to go, from request_stats and the number of planned requests."""
    seconds = (F.unix_micros(F.col("last_ts").cast("timestamp")) - F.unix_micros(F.col("first_ts").cast("timestamp"))) / 1e6
    rps = F.when(seconds >= 1, F.col("total") / seconds).otherwise(0.0)
    return stats.select(
        "*",
        rps.alias("rps"),
        F.when(F.col("total") > 0, F.expr("sum_ns div total")).otherwise(0).alias("avg_ns"),
        F.when(F.col("total") > 0, F.col("success") / F.col("total") * 100).otherwise(0.0).alias("success_percent"),
        F.when(planned > 0, F.col("total") / planned).otherwise(0.0).alias("progress"),
        F.when(rps > 0, F.floor(F.greatest(planned - F.col("total"), F.lit(0)) / rps)).otherwise(0).alias("eta_s"),
    )


def severity_rollup(rows: DataFrame, severity: str = "severity") -> DataFrame:
    """Three buckets: critical counts as high and info as low; other values count only in the total."""
    s = F.lower(severity)
    return rows.agg(
        F.count("*").alias("found"),
        F.count_if(s.isin("critical", "high")).alias("high"),
        F.count_if(s == "medium").alias("medium"),
        F.count_if(s.isin("low", "info")).alias("low"),
    )


def report_counts(rows: DataFrame) -> DataFrame:
    """Counts by severity, by type and in all, from one aggregation over grouping sets."""
    rows.createOrReplaceTempView("__report_rows")
    return rows.sparkSession.sql(
        "SELECT CASE WHEN grouping(severity) = 0 THEN 'severity' WHEN grouping(type) = 0 THEN 'type' ELSE 'all' END AS kind, "
        "coalesce(severity, type, 'all') AS value, count(*) AS n FROM __report_rows GROUP BY GROUPING SETS ((severity), (type), ())"
    )


def cache_stats(log: DataFrame) -> DataFrame:
    """Hits, misses, evictions, stored bytes and items of an access log (op, hit, key, size)."""
    return log.agg(
        F.count_if((F.col("op") == "get") & F.col("hit")).alias("hits"),
        F.count_if((F.col("op") == "get") & ~F.col("hit")).alias("misses"),
        F.count_if(F.col("op") == "evict").alias("evictions"),
        F.coalesce(F.sum(F.when(F.col("op") == "set", F.col("size"))), F.lit(0)).alias("bytes_set"),
        F.count_distinct(F.when(F.col("op") == "set", F.col("key"))).alias("items"),
    )


def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report rows over orders: severity from priority, type from status."""
    o = table(spark, sf_dir, "orders")
    p = F.left("o_orderpriority", F.lit(1))
    severity = F.when(p == "1", "critical").when(p == "2", "high").when(p == "3", "medium").when(p == "4", "low").otherwise("info")
    kind = F.when(F.col("o_orderstatus") == "F", "status").when(F.col("o_orderstatus") == "O", "time").otherwise("length")
    return o.select(F.col("o_orderkey").alias("id"), severity.alias("severity"), kind.alias("type"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("score"))


ANOMALIES_SQL = """anomalies AS (SELECT o_orderkey AS id, CASE left(o_orderpriority, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' WHEN '4' THEN 'low' ELSE 'info' END AS severity,
 CASE o_orderstatus WHEN 'F' THEN 'status' WHEN 'O' THEN 'time' ELSE 'length' END AS type, o_orderdate AS ts, o_totalprice AS score FROM orders)"""


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.when(F.col("event_type") == "error", F.when(F.col("seq") % 3 == 0, "timeout").otherwise("refused"))
    return responses(spark, sf_dir).withColumn("error", error)


_REQ_SQL = f"""WITH {RESPONSES_SQL}, q AS (SELECT *, CASE WHEN event_type = 'error' THEN CASE WHEN seq % 3 = 0 THEN 'timeout' ELSE 'refused' END END AS error FROM responses),
s AS (SELECT count(*) AS total, count(*) FILTER (error IS NULL AND status_code < 500) AS success, count(*) FILTER (NOT (error IS NULL AND status_code < 500)) AS failure, count(*) FILTER (error = 'timeout') AS timeouts,
 CAST(sum(response_time_ns) AS BIGINT) AS sum_ns, min(response_time_ns) AS min_ns, max(response_time_ns) AS max_ns, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS sec FROM q)"""


@R.query("request_stats", _REQ_SQL + " SELECT total, success, failure, timeouts, sum_ns, min_ns, max_ns FROM s")
def request_stats_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return request_stats(_requests(spark, sf_dir)).drop("first_ts", "last_ts")


@R.query("request_rates", _REQ_SQL + """ SELECT round(CASE WHEN sec >= 1 THEN total / sec ELSE 0 END, 6) AS rps, CAST(sum_ns // total AS BIGINT) AS avg_ns, round(success / total * 100, 6) AS success_percent, round(total / 50000, 6) AS progress,
 CAST(floor(greatest(50000 - total, 0) / (total / sec)) AS BIGINT) AS eta_s FROM s""")
def request_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = derived_rates(request_stats(_requests(spark, sf_dir)), F.lit(50000))
    return d.select(F.round("rps", 6).alias("rps"), "avg_ns", F.round("success_percent", 6).alias("success_percent"), F.round("progress", 6).alias("progress"), "eta_s")


@R.query("engine_stats", f"WITH {RESPONSES_SQL} SELECT count(*) AS total, count(*) FILTER (status_code < 500) AS success, count(*) FILTER (status_code >= 500) AS failed FROM responses")
def engine_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(F.col("status_code") < 500).alias("success"), F.count_if(F.col("status_code") >= 500).alias("failed"))


@R.query("severity_rollup", f"WITH {ANOMALIES_SQL} SELECT count(*) AS found, count(*) FILTER (severity IN ('critical', 'high')) AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity IN ('low', 'info')) AS low FROM anomalies")
def severity_rollup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return severity_rollup(anomalies(spark, sf_dir))


@R.query("report_grouping_sets", f"WITH {ANOMALIES_SQL} SELECT CASE WHEN grouping(severity) = 0 THEN 'severity' WHEN grouping(type) = 0 THEN 'type' ELSE 'all' END AS kind, coalesce(severity, type, 'all') AS value, count(*) AS n FROM anomalies GROUP BY GROUPING SETS ((severity), (type), ())")
def report_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_counts(anomalies(spark, sf_dir))


@R.query("report_filter", f"WITH {ANOMALIES_SQL} SELECT id, severity, type FROM anomalies WHERE severity = 'critical' AND type = 'time'")
def report_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomalies(spark, sf_dir).where((F.col("severity") == "critical") & (F.col("type") == "time")).select("id", "severity", "type")


@R.query("detector_stats", f"WITH {ANOMALIES_SQL} SELECT severity, type, count(*) AS findings, round(max(score), 2) AS top_score FROM anomalies GROUP BY ROLLUP (severity, type)")
def detector_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomalies(spark, sf_dir).rollup("severity", "type").agg(F.count("*").alias("findings"), F.round(F.max("score"), 2).alias("top_score"))


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "purchase", "set").when(F.col("event_type") == "signup", "evict").otherwise("get")
    return e.select("ts", F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").alias("key"), (F.col("event_id") % 3 > 0).alias("hit"), F.octet_length("props").cast("bigint").alias("size"))


ACCESS_SQL = """access_log AS (SELECT ts, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'set' WHEN 'signup' THEN 'evict' ELSE 'get' END AS op, user_id AS key, event_id % 3 > 0 AS hit, CAST(octet_length(encode(props)) AS BIGINT) AS size FROM events)"""


@R.query("cache_stats", f"WITH {ACCESS_SQL} SELECT count(*) FILTER (op = 'get' AND hit) AS hits, count(*) FILTER (op = 'get' AND NOT hit) AS misses, count(*) FILTER (op = 'evict') AS evictions, CAST(sum(size) FILTER (op = 'set') AS BIGINT) AS bytes_set, count(DISTINCT key) FILTER (op = 'set') AS items FROM access_log")
def cache_stats_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache_stats(access_log(spark, sf_dir))


@R.query("cluster_stats", "SELECT count(*) AS tasks, count(*) FILTER (event_type <> 'error') AS completed, count(*) FILTER (event_type = 'error') AS failed, count(DISTINCT user_id) FILTER (event_type IN ('view', 'click')) AS active_workers FROM events")
def cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.agg(
        F.count("*").alias("tasks"),
        F.count_if(F.col("event_type") != "error").alias("completed"),
        F.count_if(F.col("event_type") == "error").alias("failed"),
        F.count_distinct(F.when(F.col("event_type").isin("view", "click"), F.col("user_id"))).alias("active_workers"),
    )


def disk_usage(items: DataFrame) -> DataFrame:
    """(kind, total, active, size, reclaimable) over rows (kind, size, in_use); unknown sizes, below 0, count 0."""
    size = F.when(F.col("size") >= 0, F.col("size")).otherwise(0)
    return items.groupBy("kind").agg(
        F.count("*").alias("total"),
        F.count_if("in_use").alias("active"),
        F.sum(size).alias("size"),
        F.sum(F.when(~F.col("in_use"), size).otherwise(0)).alias("reclaimable"),
    )


@R.query("disk_usage", "SELECT event_type AS kind, count(*) AS total, count(*) FILTER (user_id % 2 = 0) AS active, CAST(sum(greatest(event_id - 50, 0)) AS BIGINT) AS size, CAST(sum(CASE WHEN user_id % 2 <> 0 THEN greatest(event_id - 50, 0) ELSE 0 END) AS BIGINT) AS reclaimable FROM events GROUP BY 1")
def disk_usage_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return disk_usage(e.select(F.col("event_type").alias("kind"), (F.col("event_id") - 50).alias("size"), (F.col("user_id") % 2 == 0).alias("in_use")))


@R.query("stability_summary", f"WITH {RESPONSES_SQL} SELECT round(100.0 * count(*) FILTER (status_code < 500) / count(*), 6) AS success_percent, round(avg(response_time_ns), 3) AS avg_ns, min(response_time_ns) AS min_ns, max(response_time_ns) AS max_ns, round(arg_max(response_time_ns, (ts, seq)) / arg_min(response_time_ns, (ts, seq)), 6) AS growth FROM responses")
def stability_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct("ts", "seq")
    return responses(spark, sf_dir).agg(
        F.round(100.0 * F.count_if(F.col("status_code") < 500) / F.count("*"), 6).alias("success_percent"),
        F.round(F.avg("response_time_ns"), 3).alias("avg_ns"),
        F.min("response_time_ns").alias("min_ns"),
        F.max("response_time_ns").alias("max_ns"),
        F.round(F.max_by("response_time_ns", order) / F.min_by("response_time_ns", order), 6).alias("growth"),
    )


def truncating_mean(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """(key, mean): the running integer mean avg += (x - avg) / n, replayed in order, division cut towards zero."""

    def step(state: dict, row: dict) -> list[dict]:
        n, avg = state.get("n", 0) + 1, state.get("avg", 0)
        apart = int(row["x"]) - avg
        state["n"], state["avg"] = n, avg + (apart // n if apart >= 0 else -(-apart // n))
        return []

    return folded(rows.select(key, *order, F.col(value).alias("x")), key, order, step, "mean long", lambda state: [{"mean": state["avg"]}])


@R.query("running_latency_mean", f"""WITH RECURSIVE {RESPONSES_SQL}, r AS (SELECT target, response_time_ns AS x, row_number() OVER (PARTITION BY target ORDER BY ts, seq) AS n FROM responses),
w AS (SELECT target, n, x AS a FROM r WHERE n = 1 UNION ALL SELECT r.target, r.n, w.a + CASE WHEN r.x >= w.a THEN (r.x - w.a) // r.n ELSE -((w.a - r.x) // r.n) END FROM w JOIN r ON r.target = w.target AND r.n = w.n + 1)
SELECT target, CAST(arg_max(a, n) AS BIGINT) AS mean FROM w GROUP BY 1""")
def running_latency_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncating_mean(responses(spark, sf_dir), "target", "response_time_ns", ["ts", "seq"])


@R.query("timing_ratios", f"""WITH {RESPONSES_SQL}, b AS (SELECT target, min_by(response_time_ns, (ts, seq)) AS base FROM responses GROUP BY 1)
SELECT event_type, count(*) FILTER (response_time_ns / base >= 2.0) AS suspicious, count(*) AS n FROM responses JOIN b USING (target) WHERE base > 0 GROUP BY 1""")
def timing_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.scoring import timing_ratio

    rows = responses(spark, sf_dir)
    base = rows.groupBy("target").agg(F.min_by("response_time_ns", F.struct("ts", "seq")).alias("base"))
    ratio = timing_ratio(F.col("response_time_ns"), F.col("base"))
    joined = rows.join(base, "target").withColumn("ratio", ratio).where(F.col("ratio").isNotNull())
    return joined.groupBy("event_type").agg(F.count_if(F.col("ratio") >= 2.0).alias("suspicious"), F.count("*").alias("n"))


@R.query("tumbling_stats", f"WITH {RESPONSES_SQL} SELECT time_bucket(INTERVAL '6 hours', ts) AS start, count(*) AS n, CAST(sum(response_time_ns) AS BIGINT) AS sum_ns FROM responses GROUP BY 1")
def tumbling_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = responses(spark, sf_dir).groupBy(F.window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"), F.sum("response_time_ns").alias("sum_ns"))
    return rows.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "sum_ns")


@R.query("session_stats", f"""WITH {RESPONSES_SQL}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL '4 hours' THEN 0 ELSE 1 END AS new FROM responses WINDOW w AS (PARTITION BY target ORDER BY ts, seq)),
s AS (SELECT *, sum(new) OVER (PARTITION BY target ORDER BY ts, seq) AS s FROM g) SELECT target, count(DISTINCT s) AS sessions, CAST(max(n) AS BIGINT) AS longest FROM (SELECT target, s, count(*) AS n FROM s GROUP BY 1, 2) GROUP BY 1""")
def session_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = responses(spark, sf_dir).groupBy("target", F.session_window("ts", "4 hours")).agg(F.count("*").alias("n"))
    return sessions.groupBy("target").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))
