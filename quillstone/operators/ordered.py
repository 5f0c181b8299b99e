"""Order-dependent operators: bounded histories, priorities, weighted picks, evictions, limiters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scoring import cpu_percent, memory_percent
from ..registry import Registry
from ..shared import TOGETHER, counted, numbered, running_total, up_to_border
from ..views import snapshots, table
from .joins import latest
from .stats import ACCESS_SQL, access_log

R = Registry()


def last_n(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The last n rows of each key; Spark limits each group below the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def pop_order(tasks: DataFrame) -> DataFrame:
    """Tasks in the order in which they are taken: highest priority first, then first come; negative ones never."""
    return tasks.where("priority >= 0").orderBy(F.desc("priority"), "seq")


def weighted_pick(options: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, name): for each target in 0..1 the first option whose cumulative weight share reaches it; options are a dimension."""
    w = Window.orderBy("name").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = options.withColumns({"upper": F.sum("weight").over(w), "total": options.agg(F.sum("weight")).scalar()})
    ladder = ranges.agg(F.sort_array(F.collect_list(F.struct((F.col("upper") / F.col("total")).alias("u"), "name")))).scalar()
    return targets.withColumn("ladder", ladder).select("target", F.get(F.filter("ladder", lambda x: x["u"] >= F.col("target")), F.lit(0))["name"].alias("name"))


def resident_after(log: DataFrame, capacity: int, keys: list[str] | None = None) -> DataFrame:
    """What a cache of `capacity` bytes holds after a log of sets: the most recent keys whose running size fits, with `used`.

    Eviction takes the least recently set first, so residents are a prefix by recency; sizes are not negative. With keys there is one
    window per cache. Of a single cache of many keys, sums by digits of recency find the border first, and only what is more
    recent is dealt by ranges and summed up.
    """
    if keys:
        newest = latest(log, [*keys, "key"], ["ts", "seq"])
        w = Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("seq")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return newest.withColumn("used", F.sum("size").over(w)).where(F.col("used") <= capacity)
    since = {"__since": -F.unix_micros(F.col("ts").cast("timestamp")), "__since_turn": F.bitwise_not(F.col("seq").cast("long"))}
    newest, n = counted(latest(log, ["key"], ["ts", "seq"]).withColumns(since))
    recent = newest if n <= TOGETHER else up_to_border(newest, ["__since", "__since_turn"], "size", capacity)
    summed = running_total(recent, ["__since", "__since_turn"], "size").withColumnRenamed("total", "used")
    return summed.where(F.col("used") <= capacity).drop("__since", "__since_turn")


def as_of(entries: DataFrame, moment: str) -> DataFrame:
    """Entries that have not expired at a moment; null never expires."""
    return entries.where(F.col("expires").isNull() | (F.col("expires") >= F.expr(f"timestamp_ntz'{moment}'")))


@R.query("last_n_per_entity", "SELECT user_id AS id, event_id AS seq FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def last_n_per_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_n(snapshots(spark, sf_dir), ["id"], ["ts", "seq"], 5).select("id", "seq")


@R.query("rolling_30", "SELECT event_id AS seq, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 6) AS rolling FROM events")
def rolling_30(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-29, 0)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.round(F.avg("value").over(w), 6).alias("rolling"))


@R.query("task_pop_order", "SELECT row_number() OVER (ORDER BY priority DESC, seq) AS place, seq FROM (SELECT event_id AS seq, CASE event_type WHEN 'purchase' THEN 10 WHEN 'click' THEN 5 WHEN 'view' THEN 1 WHEN 'signup' THEN 0 ELSE -1 END AS priority FROM events) WHERE priority >= 0 ORDER BY 1 LIMIT 500")
def task_pop_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    priority = F.when(t == "purchase", 10).when(t == "click", 5).when(t == "view", 1).when(t == "signup", 0).otherwise(-1)
    first = pop_order(table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), priority.alias("priority"))).limit(500)
    place = F.row_number().over(Window.orderBy(F.desc("priority"), "seq"))
    return first.select(place.cast("bigint").alias("place"), "seq")


@R.query("task_order", "SELECT row_number() OVER (ORDER BY priority DESC, seq) AS place, seq, priority FROM (SELECT event_id AS seq, CASE event_type WHEN 'purchase' THEN 10 WHEN 'click' THEN 5 WHEN 'view' THEN 1 WHEN 'signup' THEN 0 ELSE -1 END AS priority FROM events) WHERE priority >= 0")
def task_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole order in which tasks are taken, none left out."""
    t = F.col("event_type")
    priority = F.when(t == "purchase", 10).when(t == "click", 5).when(t == "view", 1).when(t == "signup", 0).otherwise(-1)
    tasks = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), priority.alias("priority")).where("priority >= 0")
    return numbered(tasks.withColumn("last", -F.col("priority")), ["last", "seq"]).select(F.col("number").alias("place"), "seq", "priority")


@R.query("weighted_pick", """WITH o AS (SELECT event_type AS name, CAST(1 + length(event_type) AS BIGINT) AS weight FROM events GROUP BY 1), c AS (SELECT name, sum(weight) OVER (ORDER BY name) / (SELECT sum(weight) FROM o) AS u FROM o), t AS (SELECT DISTINCT (event_id % 100) / 100 AS target FROM events)
SELECT target, min_by(name, u) AS name FROM t JOIN c ON u >= target GROUP BY 1""")
def weighted_pick_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    options = e.groupBy(F.col("event_type").alias("name")).agg((1 + F.max(F.length("event_type"))).cast("bigint").alias("weight"))
    return weighted_pick(options, e.select((F.col("event_id") % 100 / 100).alias("target")).distinct())


@R.query("cache_residents", f"WITH {ACCESS_SQL}, l AS (SELECT * FROM access_log WHERE op = 'set' QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) = 1), u AS (SELECT key, CAST(sum(size) OVER (ORDER BY ts DESC, seq DESC) AS BIGINT) AS used FROM l) SELECT key, used FROM u WHERE used <= 400")
def cache_residents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resident_after(access_log(spark, sf_dir).where("op = 'set'"), 400).select("key", "used")


@R.query("latest_sample", "SELECT event_id AS seq, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def latest_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = table(spark, sf_dir, "events").agg(F.max(F.struct("ts", "event_id", "value")).alias("r"))
    return row.select(F.col("r.event_id").alias("seq"), F.col("r.value").alias("value"))


@R.query("capped_rows", "SELECT event_id AS seq FROM events ORDER BY ts, event_id LIMIT 100")
def capped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").orderBy("ts", "event_id").limit(100).select(F.col("event_id").alias("seq"))


@R.query("sorted_keys", "SELECT DISTINCT source AS key FROM documents ORDER BY 1")
def sorted_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("key")).distinct().orderBy("key")


@R.query("cpu_memory_percent", """WITH d AS (SELECT event_id AS seq, value * 1000 - lag(value * 1000) OVER w AS cpu, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1000.0 AS sys, value * 1000 AS usage FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT seq, round(CASE WHEN cpu > 0 AND sys > 0 THEN cpu / sys * 4 * 100.0 ELSE 0 END, 2) AS cpu_percent, round(usage / 500000 * 100.0, 2) AS memory_percent FROM d""")
def cpu_memory_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, sf_dir, "events").withColumns({"cpu": F.col("value") * 1000 - F.lag(F.col("value") * 1000).over(w), "sys": (us - F.lag(us).over(w)) / 1000.0})
    return e.select(F.col("event_id").alias("seq"), cpu_percent(F.col("cpu"), F.col("sys"), F.lit(4)).alias("cpu_percent"), memory_percent(F.col("value") * 1000, F.lit(500000)).alias("memory_percent"))


_POOL_SQL = """pool AS (SELECT event_type AS key, CAST(user_id AS VARCHAR) AS value, ts, event_id AS seq, CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts + INTERVAL '30 minutes' END AS expires FROM events)"""


def pool_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    expires = F.when(F.col("event_id") % 5 != 0, F.expr("ts + interval 30 minutes"))
    return e.select(F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("value"), "ts", F.col("event_id").alias("seq"), expires.alias("expires"))


MOMENT = "2024-01-15 12:00:00"


def pool_reads(entries: DataFrame, moment: str) -> DataFrame:
    """Per key at a moment: first and last unexpired value, and how many there are."""
    live = as_of(entries.where(F.col("ts") <= F.expr(f"timestamp_ntz'{moment}'")), moment)
    order = F.struct("ts", "seq")
    return live.groupBy("key").agg(F.min_by("value", order).alias("first"), F.max_by("value", order).alias("latest"), F.count("*").alias("n"))


@R.query("pool_latest_asof", f"WITH {_POOL_SQL} SELECT key, arg_min(value, (ts, seq)) AS first, arg_max(value, (ts, seq)) AS latest, count(*) AS n FROM pool WHERE ts <= TIMESTAMP '{MOMENT}' AND (expires IS NULL OR expires >= TIMESTAMP '{MOMENT}') GROUP BY 1")
def pool_latest_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool_reads(pool_entries(spark, sf_dir), MOMENT)


@R.query("pool_ttl_active", f"WITH {_POOL_SQL}, d AS (SELECT * FROM pool WHERE ts <= TIMESTAMP '{MOMENT}' QUALIFY row_number() OVER (PARTITION BY key, value ORDER BY ts DESC, seq DESC) = 1) SELECT key, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS n FROM d) WHERE n <= 100 AND (expires IS NULL OR expires >= TIMESTAMP '{MOMENT}')")
def pool_ttl_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the value pool: one entry per value (the newest refreshes), at most 100 a key, unexpired ones."""
    seen = pool_entries(spark, sf_dir).where(F.col("ts") <= F.expr(f"timestamp_ntz'{MOMENT}'"))
    newest = latest(seen, ["key", "value"], ["ts", "seq"])
    return as_of(last_n(newest, ["key"], ["ts", "seq"], 100), MOMENT).select("key", "value", "seq")


@R.query("pool_stats", f"WITH {_POOL_SQL} SELECT count(*) AS entries, count(DISTINCT key) AS keys, count(*) FILTER (expires < TIMESTAMP '{MOMENT}') AS expired FROM pool WHERE ts <= TIMESTAMP '{MOMENT}'")
def pool_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = pool_entries(spark, sf_dir).where(F.col("ts") <= F.expr(f"timestamp_ntz'{MOMENT}'"))
    return seen.agg(F.count("*").alias("entries"), F.count_distinct("key").alias("keys"), F.count_if(F.col("expires") < F.expr(f"timestamp_ntz'{MOMENT}'")).alias("expired"))


@R.query("pool_keys", f"WITH {_POOL_SQL} SELECT DISTINCT key FROM pool")
def pool_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool_entries(spark, sf_dir).select("key").distinct()


def memory_alerts(samples: DataFrame, most_heap: int = 1 << 30, most_share: float = 0.8) -> DataFrame:
    """One row for each threshold that a sample exceeds; stateless, so the same for batch and stream."""
    share = F.col("heap") / F.col("sys")
    found = F.array(
        F.when(F.col("heap") > most_heap, F.struct(F.lit("heap_high").alias("alert"), F.col("heap").cast("double").alias("value"))),
        F.when(share > most_share, F.struct(F.lit("usage_high").alias("alert"), F.round(share * 100, 4).alias("value"))),
    )
    return samples.select("seq", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("a")).select("seq", "a.alert", "a.value")


@R.query("memory_alerts", "WITH s AS (SELECT event_id AS seq, CAST(value * 1e7 AS BIGINT) AS heap, CAST(2000000000 AS BIGINT) AS sys FROM events) SELECT seq, 'heap_high' AS alert, CAST(heap AS DOUBLE) AS value FROM s WHERE heap > 1073741824 UNION ALL SELECT seq, 'usage_high', round(heap / sys * 100, 4) FROM s WHERE heap / sys > 0.8")
def memory_alerts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return memory_alerts(e.select(F.col("event_id").alias("seq"), F.round(F.col("value") * 1e7).cast("bigint").alias("heap"), F.lit(2000000000).cast("bigint").alias("sys")))


@R.query("log_tail", "SELECT * FROM (SELECT event_id AS seq, event_type AS line FROM events WHERE user_id = 8 ORDER BY event_id DESC LIMIT 20) ORDER BY seq")
def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = table(spark, sf_dir, "events").where("user_id = 8").orderBy(F.desc("event_id")).limit(20)
    return tail.select(F.col("event_id").alias("seq"), F.col("event_type").alias("line")).orderBy("seq")
