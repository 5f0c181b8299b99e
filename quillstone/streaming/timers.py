"""Streams with event-time timers and keyed maps: silence that is reported though no row comes, and value pools with a cap over all keys.

Both are stateful processors: the state of one key is a few named values, read and written apart, not one document.
They need a session whose spark.sql.streaming.stateStore.providerClass is the RocksDB one; the queries make a session of their own
for it and leave the caller's settings alone.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..registry import Registry
from ..shared import folded, shared_folder
from ..views import table

R = Registry()
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# --- Liveness ---------------------------------------------------------------------------------------------------


class Liveness(StatefulProcessor):
    """Online and offline changes of one worker, in event time.

    Heartbeats wait until the watermark has passed them, so that late ones within it count in their place. A timer stands at
    the end of the silence that would take the worker offline: if the watermark passes it first, that is reported.
    """

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t array<long>")  # an array for each batch, not a row for each heartbeat
        self.last = handle.getValueState("last", "t long, online boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = sorted(set().union(*(part["t"].tolist() for part in rows)))
        self.waiting.appendValue((times,))
        self.handle.registerTimer(times[0])  # each call is a round trip; what waits behind it gets its timer when this one is due
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        waiting = sorted({t for (times,) in self.waiting.get() for t in times}) if self.waiting.exists() else []
        last, online = self.last.get() if self.last.exists() else (None, False)
        out = []
        for t in [x for x in waiting if x <= now]:
            if online and t - last > self.timeout_ms:
                out.append((key[0], last + self.timeout_ms, False))
                online = False
            if not online:
                out.append((key[0], t, True))
            last, online = t if last is None else max(t, last), True
        left = [t for t in waiting if t > now]
        if online and not (left and left[0] <= last + self.timeout_ms) and last + self.timeout_ms <= now:
            out.append((key[0], last + self.timeout_ms, False))
            online = False
        self.waiting.put([(left,)]) if left else self.waiting.clear()
        if last is not None:
            self.last.update((last, online))
        due = set(self.handle.listTimers())
        for t in ([left[0]] if left else []) + ([last + self.timeout_ms] if online else []):
            if t > now and t not in due:
                self.handle.registerTimer(t)
        yield pd.DataFrame(out, columns=["worker", "t", "online"])

    def close(self) -> None:
        pass


def liveness_stream(heartbeats: DataFrame, timeout_s: int = 30, late: str = "0 seconds") -> DataFrame:
    """(worker, at, online) for every change of a stream of heartbeats (worker, ts): online at a heartbeat behind silence, offline when
    no heartbeat came for longer than the timeout, reported once the watermark has passed that moment, in milliseconds."""
    kind = heartbeats.schema["worker"].dataType.simpleString()
    rows = heartbeats.select("worker", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late).withColumn("t", F.unix_millis("ts"))
    made = rows.groupBy("worker").transformWithStateInPandas(Liveness(timeout_s * 1000), f"worker {kind}, t long, online boolean", "append", "eventTime")
    return made.select("worker", F.timestamp_millis("t").alias("at"), "online")


def liveness_changes(heartbeats: DataFrame, until: datetime, timeout_s: int = 30) -> DataFrame:
    """The same changes of a finished table, as known at `until`."""
    end = int(until.replace(tzinfo=timezone.utc).timestamp() * 1000)
    rows = heartbeats.select("worker", F.unix_millis(F.col("ts").cast("timestamp")).alias("t")).where(F.col("t") <= end)
    w = Window.partitionBy("worker").orderBy("t")
    gap = timeout_s * 1000
    marked = rows.withColumns({"before": F.lag("t").over(w), "after": F.lead("t").over(w)})
    on = marked.where(F.col("before").isNull() | (F.col("t") - F.col("before") > gap)).select("worker", "t", F.lit(True).alias("online"))
    silent = F.when(F.col("after").isNull(), F.col("t") + gap <= end).otherwise(F.col("after") - F.col("t") > gap)
    off = marked.where(silent).select("worker", (F.col("t") + gap).alias("t"), F.lit(False).alias("online"))
    return on.unionByName(off).select("worker", F.timestamp_millis("t").alias("at"), "online")


# --- Value pools with a cap over all keys -----------------------------------------------------------------------


class Pool:
    """The entries of one pool by key, in order of arrival, as [value, expiry]; expired ones count until a sweep takes them.

    A put of a full pool sweeps first and is refused if that made no room. A value that its key holds unexpired is refreshed. Beyond
    the limit per key the oldest entry goes; the total counts puts less what sweeps and removals took, as in the reference,
    so that a replaced entry still counts. No entry expires before `soonest`, so that a full pool looks through its entries only
    where one of them can go, not at each refused put.
    """

    def __init__(self, per_key: int, most: int, ttl_s: float, entries: dict[str, list[list]] | None = None, total: int = 0):
        self.per_key, self.most, self.ttl_s = per_key, most, ttl_s
        self.entries, self.total, self.touched = entries or {}, total, set()
        self.soonest = self._soonest()

    def _soonest(self) -> float:
        times = [e[1] for held in self.entries.values() for e in held]
        return -math.inf if any(math.isnan(x) for x in times) else min(times, default=math.inf)

    def sweep(self, now: float) -> int:
        if self.soonest >= now:
            return 0
        gone = 0
        for key in list(self.entries):
            kept = [e for e in self.entries[key] if e[1] >= now]
            if len(kept) < len(self.entries[key]):
                gone += len(self.entries[key]) - len(kept)
                self.touched.add(key)
                if kept:
                    self.entries[key] = kept
                else:
                    del self.entries[key]
        self.total -= gone
        self.soonest = self._soonest()
        return gone

    def put(self, key: str, value: str, now: float) -> str:
        if self.total >= self.most:
            self.sweep(now)
            if self.total >= self.most:
                return "refused"
        held = self.entries.get(key, [])
        self.touched.add(key)
        for e in held:
            if e[0] == value and e[1] >= now:
                e[1] = now + self.ttl_s
                return "refreshed"
        replaced, expiry = len(held) >= self.per_key, now + self.ttl_s
        self.entries[key] = [*held[replaced:], [value, expiry]]
        if not expiry >= self.soonest:
            self.soonest = -math.inf if math.isnan(expiry) else expiry
        self.total += 1
        return "replaced" if replaced else "added"

    def did(self, op: str, key: str, value: str, t: float) -> tuple[str, int, int]:
        """Action, gone and total of one row."""
        action = self.put(str(key), str(value), float(t)) if op == "put" else "swept"
        gone = self.sweep(float(t)) if op == "sweep" else 0
        return action, gone, self.total

    def step(self, row: dict) -> dict:
        action, gone, total = self.did(row["op"], row["key"], row["value"], row["t"])
        return {"seq": int(row["seq"]), "action": action, "gone": gone, "total": total}


ACTIONS = "seq long, action string, gone int, total int"
#: What a pool's rows have besides the pool.
PACKED = ("key", "value", "op", "t", "seq")


def pool_batch(rows: DataFrame, per_key: int, most: int, ttl_s: float) -> DataFrame:
    """What each row (pool, key, value, op, t, seq) of a log did, in order of (t, seq): pools are dealt out, and one pool's state is bounded by its cap."""

    def fold(state: dict, row: dict) -> list[dict]:
        return [state.setdefault("pool", Pool(per_key, most, ttl_s)).step(row)]

    return folded(rows, "pool", ["t", "seq"], fold, ACTIONS)


class PoolProcessor(StatefulProcessor):
    """The same over a stream: a map from key to its entries, of which a batch writes back only those that it touched."""

    def __init__(self, per_key: int, most: int, ttl_s: float):
        self.limits = (per_key, most, ttl_s)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "key string", "value array<string>, expires array<double>")
        self.total = handle.getValueState("total", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {k[0]: [list(e) for e in zip(v[0], v[1])] for k, v in self.entries.iterator()} if self.entries.exists() else {}
        pool = Pool(*self.limits, held, self.total.get()[0] if self.total.exists() else 0)
        packs = pd.concat(list(rows))  # of packed()
        batch = {c: np.concatenate(packs[c].tolist()) for c in PACKED}
        order = np.lexsort((batch["seq"], batch["t"], ~np.isnan(batch["t"])))  # rows without a time first, as Spark sorts them
        for start in range(0, len(order), STEPS):
            part = {c: batch[c][order[start : start + STEPS]].tolist() for c in PACKED}
            action, gone, total = zip(*[pool.did(*row) for row in zip(part["op"], part["key"], part["value"], part["t"])])
            yield pd.DataFrame({"pool": [key[0]], "seq": [part["seq"]], "action": [list(action)], "gone": [list(gone)], "total": [list(total)]})
        for k in pool.touched:
            if k in pool.entries:
                values, expires = zip(*pool.entries[k])
                self.entries.updateValue((k,), (list(values), list(expires)))
            elif self.entries.containsKey((k,)):
                self.entries.removeKey((k,))
        self.total.update((pool.total,))

    def close(self) -> None:
        pass


def packed(rows: DataFrame) -> DataFrame:
    """rows (pool, key, value, op, t, seq), each Arrow batch as one row of arrays a pool.

    Spark hands a stateful processor its rows as Python objects, one by one, which costs more than the pool does.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.Table.from_batches([batch]).group_by("pool", use_threads=False).aggregate([(c, "list") for c in PACKED])
            yield from pa.table([made["pool"], *(made[f"{c}_list"] for c in PACKED)], names=["pool", *PACKED]).to_batches()

    return rows.select("pool", *PACKED).mapInArrow(pack, ", ".join([f"pool {kinds['pool']}", *(f"{c} array<{kinds[c]}>" for c in PACKED)]))


def packed_pool_stream(packs: DataFrame, per_key: int, most: int, ttl_s: float) -> DataFrame:
    """pool_stream over packed rows; the results of STEPS rows leave the processor as one row, too.

    Pools go by their names: pandas makes numbers with a null among them floats, and a null key unequal to itself.
    """
    lists = ", ".join(f"{name} array<{of}>" for name, of in (x.split() for x in ACTIONS.split(", ")))
    named = packs.withColumn("pool", F.col("pool").cast("string"))
    made = named.groupBy("pool").transformWithStateInPandas(PoolProcessor(per_key, most, ttl_s), f"pool string, {lists}", "append", "none")
    return made.select(F.col("pool").cast(packs.schema["pool"].dataType).alias("pool"), F.inline(F.arrays_zip("seq", "action", "gone", "total")))


def pool_stream(rows: DataFrame, per_key: int, most: int, ttl_s: float) -> DataFrame:
    """pool_batch over a stream whose micro-batches come in order; a task holds a pool's rows of one micro-batch (see written_in_order)."""
    return packed_pool_stream(packed(rows), per_key, most, ttl_s)


# --- Queries ----------------------------------------------------------------------------------------------------


def state_session(spark: SparkSession, most: int | None = None) -> SparkSession:
    """A session like spark whose state stores are RocksDB's; with at most `most` of them, where a stream has few keys: each micro-batch
    runs a task, opens a store and writes it for each one, also where it has no rows."""
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    if most is not None:
        own.conf.set("spark.sql.shuffle.partitions", str(min(most, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return own


def run_to_end(stream: DataFrame, folder: str, out: str = "out") -> None:
    """Run a stream until no input is left, into Parquet below folder; a later run goes on where this one ended."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/{out}")
    query.awaitTermination()


#: Rows of a micro-batch, about, and rows of a pool that are objects at a time.
BATCH_ROWS, STEPS = 1 << 20, 4_096


def written_in_order(rows: DataFrame, order: list[str], folder: str, most: int, form: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
    """rows as files of about `most` rows, by ranges of order, for a stream that reads one file at a time; form is what each file's rows are written as.

    A stream takes files by their times of change, which are set in the order of the ranges: tasks end in any order.
    """
    form(rows.repartitionByRange(max(1, -(-rows.count() // most)), *order)).write.parquet(folder)
    sc = rows.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(sc._jsc.hadoopConfiguration())
    files = sorted((f for f in store.listStatus(path) if f.getPath().getName().startswith("part-")), key=lambda f: f.getPath().getName())
    first = max((f.getModificationTime() for f in files), default=0) // 1000 * 1000 - 1000 * len(files)
    for k, f in enumerate(files):
        store.setTimes(f.getPath(), first + 1000 * k, -1)


SILENCE_S, CLOCK = 6 * 3600, datetime(2024, 3, 1)


@R.query("liveness_stream", f"""WITH h AS (SELECT user_id AS worker, epoch_us(ts) // 1000 AS t FROM events), m AS (SELECT *, lag(t) OVER w AS before, lead(t) OVER w AS after FROM h WINDOW w AS (PARTITION BY worker ORDER BY t))
SELECT worker, make_timestamp(t * 1000) AS at, true AS online FROM m WHERE before IS NULL OR t - before > {SILENCE_S * 1000} UNION ALL SELECT worker, make_timestamp((t + {SILENCE_S * 1000}) * 1000), false FROM m WHERE after IS NULL OR after - t > {SILENCE_S * 1000}""")
def liveness_stream_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workers that fall silent for six hours, as a stream of files in order of time; a last heartbeat of a clock ends it."""
    folder, own = f"{shared_folder(spark)}/liveness-{uuid.uuid4().hex}", state_session(spark)
    beats = table(spark, sf_dir, "events").select(F.col("user_id").alias("worker"), F.col("ts").cast("timestamp").alias("ts"))
    clock = spark.range(1).select(F.lit(-1).cast("long").alias("worker"), F.lit(CLOCK.isoformat(" ")).cast("timestamp").alias("ts"))
    beats.repartitionByRange(3, "ts").write.parquet(f"{folder}/in")
    clock.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = own.readStream.schema("worker long, ts timestamp").parquet(f"{folder}/in")
    run_to_end(liveness_stream(stream, SILENCE_S), folder)
    return spark.read.parquet(f"{folder}/out").where("worker >= 0").select("worker", F.col("at").cast("timestamp_ntz").alias("at"), "online")


PER_KEY, MOST, TTL_S = 20, 60, 5 * 3600.0
#: State stores of the log's four pools, which Spark's hash deals to one each.
STORES = 4

#: The pool's log in SQL: one step per row of a pool, the entries as one list in order of arrival.
_POOL_SQL = f"""WITH RECURSIVE e AS (SELECT CAST(user_id % 4 AS BIGINT) AS pool, event_type AS key, CAST(event_id % 40 AS VARCHAR) AS value, CASE WHEN event_id % 97 = 5 THEN 'sweep' ELSE 'put' END AS op, epoch_us(ts) / 1e6 AS t, event_id AS seq, row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) AS rn FROM events),
w AS (SELECT DISTINCT pool, 0::BIGINT AS rn, NULL::BIGINT AS seq, []::STRUCT(k VARCHAR, v VARCHAR, x DOUBLE)[] AS held, 0 AS total, NULL::VARCHAR AS action, 0 AS gone FROM e
UNION ALL SELECT pool, rn, seq,
 CASE WHEN action IN ('swept', 'refused') THEN live WHEN action = 'refreshed' THEN list_transform(live, lambda x: {{'k': x.k, 'v': x.v, 'x': CASE WHEN x.k = key AND x.v = value AND x.x >= t THEN t + {TTL_S} ELSE x.x END}})
  WHEN action = 'replaced' THEN list_append(list_concat(live[:first - 1], live[first + 1:]), {{'k': key, 'v': value, 'x': t + {TTL_S}}}) ELSE list_append(live, {{'k': key, 'v': value, 'x': t + {TTL_S}}}) END,
 CAST(room + CASE WHEN action IN ('added', 'replaced') THEN 1 ELSE 0 END AS INTEGER), action, CAST(CASE WHEN op = 'sweep' THEN gone ELSE 0 END AS INTEGER)
FROM (SELECT *, CASE WHEN op = 'sweep' THEN 'swept' WHEN room >= {MOST} THEN 'refused' WHEN len(list_filter(live, lambda x: x.k = key AND x.v = value AND x.x >= t)) > 0 THEN 'refreshed'
  WHEN len(list_filter(live, lambda x: x.k = key)) >= {PER_KEY} THEN 'replaced' ELSE 'added' END AS action, list_position(list_transform(live, lambda x: x.k), key) AS first
FROM (SELECT e.*, CASE WHEN sweeps THEN list_filter(held, lambda x: x.x >= e.t) ELSE held END AS live, CASE WHEN sweeps THEN total - len(list_filter(held, lambda x: x.x < e.t)) ELSE total END AS room, len(list_filter(held, lambda x: x.x < e.t)) AS gone
FROM (SELECT w.*, w.total >= {MOST} OR n.op = 'sweep' AS sweeps FROM w JOIN e n ON n.pool = w.pool AND n.rn = w.rn + 1) w JOIN e ON e.pool = w.pool AND e.rn = w.rn + 1)))
SELECT pool, seq, action, gone, total FROM w WHERE seq IS NOT NULL"""


def pool_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four pools of values by event type, swept now and then."""
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_id") % 97 == 5, "sweep").otherwise("put")
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return e.select((F.col("user_id") % 4).alias("pool"), F.col("event_type").alias("key"), (F.col("event_id") % 40).cast("string").alias("value"), op.alias("op"), t.alias("t"), F.col("event_id").alias("seq"))


@R.query("capped_pool_actions", _POOL_SQL)
def capped_pool_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Puts that find their pool full are refused unless a sweep makes room."""
    return pool_batch(pool_log(spark, sf_dir), PER_KEY, MOST, TTL_S)


@R.query("capped_pool_stream", _POOL_SQL)
def capped_pool_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log as a stream of files in order of time, its state a map by key."""
    folder, own = f"{shared_folder(spark)}/pools-{uuid.uuid4().hex}", state_session(spark, STORES)
    log = pool_log(spark, sf_dir)
    written_in_order(log, ["t", "seq"], f"{folder}/in", BATCH_ROWS, packed)
    stream = own.readStream.schema(packed(log).schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    run_to_end(packed_pool_stream(stream, PER_KEY, MOST, TTL_S), folder)
    return spark.read.parquet(f"{folder}/out")
