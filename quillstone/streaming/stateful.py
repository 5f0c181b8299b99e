"""Stateful streams, each with a batch form that gives the same rows: learning, value pool, limiter, throttle, liveness, snapshot changes.

A processor is a plain function of (state, rows in order) so that batch and stream share it. Streams keep one
state per key with applyInPandasWithState; batches fold each key's rows in order, batch by batch, in sorted partitions.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..registry import Registry
from ..shared import folded
from ..views import responses, snapshots, table

R = Registry()
State = dict[str, Any]
Fold = Callable[[State, dict], list[dict]]

#: The pool's limits and times, in seconds, and the samples that a baseline learns from.
POOL_TTL_S, POOL_PER_KEY, POOL_TOTAL = 1800.0, 100, 10_000
MAX_SAMPLES = 100


def learn_then_score(most: int = MAX_SAMPLES) -> Fold:
    """The first `most` samples of a key make its baseline, an integer mean; later rows are scored against it."""

    def fold(state: State, row: dict) -> list[dict]:
        n, total = state.get("n", 0), state.get("total", 0)
        if n < most:
            state["n"], state["total"] = n + 1, total + int(row["response_time_ns"])
            return []
        mean = total // n
        return [{"seq": row["seq"], "skew": row["response_time_ns"] / mean if mean > 0 else 0.0}]

    return fold


def pool_put(state: State, row: dict) -> list[dict]:
    """The value pool of one key: equal values refresh their expiry, the oldest go beyond the limit; emits what each row did.

    A row's op is put where it has none; remove_value drops the first entry of its value, remove and clear drop all of the key.
    """
    now, entries = row["t"], state.setdefault("entries", [])
    entries[:] = [e for e in entries if e[2] >= now]
    op = row.get("op") or "put"
    if op in ("remove", "clear"):
        n = len(entries)
        entries.clear()
        return [{"seq": row["seq"], "action": "removed" if n else "absent", "size": 0}]
    if op == "remove_value":
        place = next((k for k, e in enumerate(entries) if e[0] == row["value"]), None)
        if place is not None:
            del entries[place]
        return [{"seq": row["seq"], "action": "absent" if place is None else "removed", "size": len(entries)}]
    for e in entries:
        if e[0] == row["value"]:
            e[2] = now + POOL_TTL_S
            return [{"seq": row["seq"], "action": "refreshed", "size": len(entries)}]
    entries.append([row["value"], now, now + POOL_TTL_S])
    dropped = len(entries) > POOL_PER_KEY
    if dropped:
        del entries[0]
    return [{"seq": row["seq"], "action": "replaced" if dropped else "added", "size": len(entries)}]


def token_bucket(per_second: int, burst: int) -> Fold:
    """Tokens grow by whole ones; the clock moves on even if none was added, so that a fast caller can starve, as in the reference."""

    def fold(state: State, row: dict) -> list[dict]:
        last, tokens = state.get("last", row["t"]), state.get("tokens", burst)
        tokens = min(burst, tokens + int((row["t"] - last) * per_second))
        allowed = tokens > 0
        state["last"], state["tokens"] = row["t"], tokens - allowed
        return [{"seq": row["seq"], "allowed": bool(allowed)}]

    return fold


def throttle(interval_s: float) -> Fold:
    """A row passes if the last one that passed is at least an interval ago."""

    def fold(state: State, row: dict) -> list[dict]:
        passes = "last" not in state or row["t"] - state["last"] >= interval_s
        if passes:
            state["last"] = row["t"]
        return [{"seq": row["seq"], "allowed": passes}]

    return fold


def status_changes(state: State, row: dict) -> list[dict]:
    """Changes of one entity's status; the first sighting is no change."""
    before, state["status"] = state.get("status"), row["status"]
    return [{"seq": row["seq"], "from_status": before, "to_status": row["status"]}] if before is not None and before != row["status"] else []


def lru_cache(capacity: int) -> Fold:
    """An access log against one cache of `capacity` bytes with recency and expiry: hits refresh only what is resident."""

    def fold(state: State, row: dict) -> list[dict]:
        held: dict[str, list] = state.setdefault("held", {})  # in order of recency, oldest first
        key, now = str(row["key"]), row["t"]
        entry = held.pop(key, None)
        state["used"] = state.get("used", 0) - (entry[0] if entry is not None else 0)
        if entry is not None and entry[1] < now:
            entry = None
        if row["op"] == "get":
            if entry is not None:
                held[key] = entry
                state["used"] += entry[0]
            return [{"seq": row["seq"], "result": "hit" if entry is not None else "miss", "evicted": 0}]
        held[key] = [int(row["size"]), now + row["ttl"]]
        state["used"] += int(row["size"])
        evicted = 0
        while state["used"] > capacity and len(held) > 1:
            state["used"] -= held.pop(next(iter(held)))[0]
            evicted += 1
        return [{"seq": row["seq"], "result": "set", "evicted": evicted}]

    return fold


def in_batch(rows: DataFrame, key: str, order: list[str], fold: Fold, schema: str) -> DataFrame:
    """The fold over each key's rows in order; the key comes first in the result. Memory: a batch and one key's state."""
    return folded(rows, key, order, fold, schema)


def in_stream(rows: DataFrame, key: str, order: list[str], fold: Fold, schema: str, idle_s: int = 0) -> DataFrame:
    """The same fold over a stream: the state of a key is one JSON document; with idle_s it is dropped after that processing time without rows."""
    kind = rows.schema[key].dataType.simpleString()
    names = [c.split()[0] for c in schema.split(", ")]

    def run(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held: State = json.loads(state.get[0]) if state.exists else {}
        batch = pd.concat(list(parts)).sort_values(order)
        out = [{key: keys[0]} | made for row in batch.to_dict("records") for made in fold(held, row)]
        state.update((json.dumps(held),))
        if idle_s:
            state.setTimeoutDuration(idle_s * 1000)
        yield pd.DataFrame(out, columns=[key, *names])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_s else GroupStateTimeout.NoTimeout
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {schema}", "state string", "append", timeout)


def windowed_stats(rows: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Requests per window of event time; rows later than the watermark are left out. For streams and batches alike."""
    ok = F.col("status_code") < 500
    return rows.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.count("*").alias("n"), F.count_if(ok).alias("success"), F.sum("response_time_ns").alias("sum_ns"))


def liveness(heartbeats: DataFrame, asof: str, timeout_s: int = 30) -> DataFrame:
    """(worker, offline) at a moment: no heartbeat for longer than the timeout."""
    last = heartbeats.groupBy("worker").agg(F.max("ts").alias("last"))
    return last.select("worker", (F.col("last") < F.expr(f"timestamp_ntz'{asof}' - interval {timeout_s} seconds")).alias("offline"))


def pruned_periodically(stream: DataFrame, path: str, prune: Callable[[DataFrame], DataFrame], every: str = "10 minutes", available: bool = False):
    """Start a query that, each time, writes what pruning leaves of the batch to a table of its own per batch; with `available`, until none is left."""

    def write(batch: DataFrame, number: int) -> None:
        prune(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(write)
    if available:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=every)


# --- Queries: the batch forms -----------------------------------------------------------------------------------


def _timed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


@R.query("learned_scores", """WITH r AS (SELECT user_id AS target, event_id AS seq, CAST(round(value * 1e6) AS BIGINT) AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
b AS (SELECT target, sum(x) // count(*) AS m FROM r WHERE rn <= 20 GROUP BY 1) SELECT r.target, r.seq, round(CASE WHEN m > 0 THEN x / m ELSE 0 END, 6) AS skew FROM r JOIN b USING (target) WHERE rn > 20""")
def learned_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = in_batch(responses(spark, sf_dir).select("target", "seq", "ts", "response_time_ns"), "target", ["ts", "seq"], learn_then_score(20), "seq long, skew double")
    return out.withColumn("skew", F.round("skew", 6))


def learn_profile(most: int = MAX_SAMPLES) -> Fold:
    """The first `most` samples of a key make its baseline: mean time, length and words, and the bodies' hashes; later rows are compared with it."""

    def fold(state: State, row: dict) -> list[dict]:
        body = row["body"] or ""
        n, words, hashed = state.get("n", 0), len(body.split()), hashlib.md5(body.encode()).hexdigest()
        sums = state.setdefault("sums", [0, 0, 0])
        known = state.setdefault("hashes", [])
        if n < most:
            state["n"] = n + 1
            for k, x in enumerate((row["response_time_ns"], row["content_length"], words)):
                sums[k] += int(x)
            if hashed not in known:
                known.append(hashed)
            return []
        time, length, count = (x // n for x in sums)
        return [{"seq": row["seq"], "skew": row["response_time_ns"] / time if time > 0 else 0.0, "length_off": int(row["content_length"]) - length, "words_off": words - count, "known_body": hashed in known}]

    return fold


@R.query("learned_profiles", """WITH r AS (SELECT user_id AS target, event_id AS seq, CAST(round(value * 1e6) AS BIGINT) AS x, octet_length(encode(props)) AS l, len(list_filter(regexp_split_to_array(props, '\\s+'), lambda w: w <> '')) AS w, md5(props) AS h, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
b AS (SELECT target, sum(x) // count(*) AS x, sum(l) // count(*) AS l, sum(w) // count(*) AS w, list(DISTINCT h) AS hs FROM r WHERE rn <= 20 GROUP BY 1)
SELECT r.target, r.seq, round(CASE WHEN b.x > 0 THEN r.x / b.x ELSE 0 END, 6) AS skew, CAST(r.l - b.l AS BIGINT) AS length_off, CAST(r.w - b.w AS BIGINT) AS words_off, list_contains(hs, h) AS known_body FROM r JOIN b USING (target) WHERE rn > 20""")
def learned_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = responses(spark, sf_dir).select("target", "seq", "ts", "response_time_ns", "content_length", "body")
    out = in_batch(r, "target", ["ts", "seq"], learn_profile(20), "seq long, skew double, length_off long, words_off long, known_body boolean")
    return out.withColumn("skew", F.round("skew", 6))


@R.query("stream_status_changes", "SELECT id, seq, from_status, to_status FROM (SELECT user_id AS id, event_id AS seq, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_status, event_type AS to_status FROM events) WHERE from_status <> to_status")
def stream_status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_batch(snapshots(spark, sf_dir), "id", ["ts", "seq"], status_changes, "seq long, from_status string, to_status string")


@R.query("throttled_rows", """WITH RECURSIVE e AS (SELECT user_id, event_id AS seq, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
w AS (SELECT user_id, seq, rn, ts AS last, true AS allowed FROM e WHERE rn = 1 UNION ALL SELECT e.user_id, e.seq, e.rn, CASE WHEN e.ts - w.last >= INTERVAL '6 hours' THEN e.ts ELSE w.last END, e.ts - w.last >= INTERVAL '6 hours' FROM w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1) SELECT user_id, seq, allowed FROM w""")
def throttled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _timed(table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), "ts"))
    return in_batch(e, "user_id", ["ts", "seq"], throttle(6 * 3600), "seq long, allowed boolean")


@R.query("limited_rows", """WITH RECURSIVE e AS (SELECT event_type, event_id AS seq, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events),
w AS (SELECT event_type, seq, rn, t AS last, 4 AS tokens, true AS allowed FROM e WHERE rn = 1
UNION ALL SELECT event_type, seq, rn, t, CAST(g - (g > 0)::INT AS INTEGER), g > 0 FROM (SELECT e.event_type, e.seq, e.rn, e.t, least(5, w.tokens + CAST(trunc(e.t - w.last) AS BIGINT)) AS g FROM w JOIN e ON e.event_type = w.event_type AND e.rn = w.rn + 1)) SELECT event_type, seq, allowed FROM w""")
def limited_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _timed(table(spark, sf_dir, "events").select("event_type", F.col("event_id").alias("seq"), "ts"))
    return in_batch(e, "event_type", ["ts", "seq"], token_bucket(1, 5), "seq long, allowed boolean")


@R.query("pool_actions", f"""WITH RECURSIVE e AS (SELECT event_type, event_id AS seq, epoch_us(ts) / 1e6 AS t, CAST(user_id AS VARCHAR) AS value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events),
w AS (SELECT event_type, seq, rn, [{{'v': value, 'x': t + {POOL_TTL_S}}}] AS held, 'added' AS action FROM e WHERE rn = 1
UNION ALL SELECT event_type, seq, rn, CASE WHEN len(made) > {POOL_PER_KEY} THEN made[2:] ELSE made END, CASE WHEN has THEN 'refreshed' WHEN len(made) > {POOL_PER_KEY} THEN 'replaced' ELSE 'added' END
FROM (SELECT *, CASE WHEN has THEN list_transform(live, lambda x: {{'v': x.v, 'x': CASE WHEN x.v = value THEN t + {POOL_TTL_S} ELSE x.x END}}) ELSE list_append(live, {{'v': value, 'x': t + {POOL_TTL_S}}}) END AS made
FROM (SELECT *, len(list_filter(live, lambda x: x.v = value)) > 0 AS has FROM (SELECT e.*, list_filter(w.held, lambda x: x.x >= e.t) AS live FROM w JOIN e ON e.event_type = w.event_type AND e.rn = w.rn + 1))))
SELECT event_type, seq, action, CAST(len(held) AS INTEGER) AS size FROM w""")
def pool_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _timed(table(spark, sf_dir, "events").select("event_type", F.col("event_id").alias("seq"), "ts", F.col("user_id").cast("string").alias("value")))
    return in_batch(e, "event_type", ["ts", "seq"], pool_put, "seq long, action string, size int")


#: The last thing that happened to a value before a row decides whether it is held: a put within its time, no removal since.
_HELD_SQL = """WITH e AS (SELECT event_type AS key, event_id AS seq, ts, CAST(user_id AS VARCHAR) AS value, CASE WHEN event_id % 11 = 3 THEN 'remove_value' WHEN event_id % 211 = 7 THEN 'remove' ELSE 'put' END AS op FROM events WHERE user_id % 40 = 1),
w AS (SELECT *, max(CASE WHEN op = 'remove' THEN struct_pack(ts := ts, seq := seq) END) OVER (PARTITION BY key ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS swept,
 lag(struct_pack(ts := ts, seq := seq)) OVER (PARTITION BY key, value, op <> 'remove' ORDER BY ts, seq) AS before, lag(op) OVER (PARTITION BY key, value, op <> 'remove' ORDER BY ts, seq) AS before_op FROM e)
SELECT key, seq, CASE WHEN op = 'put' THEN CASE WHEN held THEN 'refreshed' ELSE 'added' END ELSE CASE WHEN held THEN 'removed' ELSE 'absent' END END AS action
FROM (SELECT *, coalesce(before_op = 'put' AND (swept IS NULL OR before > swept) AND before.ts + INTERVAL '1800 seconds' >= ts, false) AS held FROM w) WHERE op <> 'remove'"""


@R.query("pool_removals", _HELD_SQL)
def pool_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Puts and removals of single values, between removals of whole keys; the values are few, so that no pool meets its limit."""
    op = F.when(F.col("event_id") % 11 == 3, "remove_value").when(F.col("event_id") % 211 == 7, "remove").otherwise("put")
    e = _timed(table(spark, sf_dir, "events").where("user_id % 40 = 1").select(F.col("event_type").alias("key"), F.col("event_id").alias("seq"), "ts", F.col("user_id").cast("string").alias("value"), op.alias("op")))
    done = in_batch(e, "key", ["ts", "seq"], pool_put, "seq long, action string, size int")
    return done.join(e.where("op <> 'remove'").select("seq"), "seq", "left_semi").select("key", "seq", "action")


@R.query("pool_removals_whole", _HELD_SQL.replace("event_type AS key", "user_id AS key").replace("CAST(user_id AS VARCHAR) AS value", "event_type AS value").replace(" WHERE user_id % 40 = 1", ""))
def pool_removals_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over all users, each with a pool of event types, which are fewer than its limit."""
    op = F.when(F.col("event_id") % 11 == 3, "remove_value").when(F.col("event_id") % 211 == 7, "remove").otherwise("put")
    e = _timed(table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("value"), op.alias("op")))
    done = in_batch(e, "key", ["ts", "seq"], pool_put, "seq long, action string, size int")
    return done.join(e.where("op <> 'remove'").select("seq"), "seq", "left_semi").select("key", "seq", "action")


@R.query("lru_replay", """WITH RECURSIVE e AS (SELECT day(ts) AS day, event_id AS seq, epoch_us(ts) / 1e6 AS t, event_type = 'purchase' AS puts, CAST(user_id AS VARCHAR) AS key, octet_length(encode(props)) AS size, row_number() OVER (PARTITION BY day(ts) ORDER BY ts, event_id) AS rn FROM events),
w AS (SELECT day, NULL::BIGINT AS seq, 0::BIGINT AS rn, []::STRUCT(k VARCHAR, s BIGINT, x DOUBLE)[] AS held, NULL::VARCHAR AS result, 0 AS evicted FROM (SELECT DISTINCT day FROM e)
UNION ALL SELECT day, seq, rn, made[gone + 1:], CASE WHEN puts THEN 'set' WHEN len(own) > 0 THEN 'hit' ELSE 'miss' END, CAST(gone AS INTEGER)
FROM (SELECT *, CASE WHEN puts THEN coalesce(list_filter(range(0, len(made)), lambda n: list_sum(list_transform(made[n + 1:], lambda x: x.s)) <= 120)[1], len(made) - 1) ELSE 0 END AS gone
FROM (SELECT *, CASE WHEN puts THEN list_append(rest, {'k': key, 's': CAST(size AS BIGINT), 'x': t + 7200.0}) ELSE list_concat(rest, own) END AS made
FROM (SELECT e.*, list_filter(w.held, lambda x: x.k <> e.key) AS rest, list_filter(w.held, lambda x: x.k = e.key AND x.x >= e.t) AS own FROM w JOIN e ON e.day = w.day AND e.rn = w.rn + 1))))
SELECT CAST(day AS INTEGER) AS day, seq, result, evicted FROM w WHERE seq IS NOT NULL""")
def lru_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache per event day; day-long keys bound each group."""
    e = _timed(table(spark, sf_dir, "events"))
    log = e.select(F.dayofmonth("ts").alias("day"), F.col("event_id").alias("seq"), "ts", "t", F.when(F.col("event_type") == "purchase", "set").otherwise("get").alias("op"), F.col("user_id").alias("key"), F.octet_length("props").alias("size"), F.lit(7200.0).alias("ttl"))
    return in_batch(log, "day", ["ts", "seq"], lru_cache(120), "seq long, result string, evicted int")


@R.query("windowed_stats", "SELECT time_bucket(INTERVAL '5 minutes', ts) AS start, count(*) AS n, count(*) FILTER (event_type <> 'error') AS success, CAST(sum(CAST(round(value * 1e6) AS BIGINT)) AS BIGINT) AS sum_ns FROM events GROUP BY 1")
def windowed_stats_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windowed_stats(responses(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n", "success", "sum_ns")


@R.query("heartbeat_liveness", "SELECT user_id AS worker, max(ts) < TIMESTAMP '2024-01-30 23:59:30' AS offline FROM events GROUP BY 1")
def heartbeat_liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return liveness(table(spark, sf_dir, "events").select(F.col("user_id").alias("worker"), "ts"), "2024-01-31 00:00:00")
