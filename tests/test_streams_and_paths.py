"""Timers, pools with a cap, sample sources, overwritten caches and JSON paths."""

import random
import uuid
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from quillstone.operators import paths
from quillstone.sources import samples, stores
from quillstone.streaming import timers

START = datetime(2024, 1, 1)


def at(seconds):
    return START + timedelta(seconds=seconds)


def beats_plain(rows, timeout, end):
    """(worker, second, online) by going through each worker's heartbeats."""
    out = []
    for worker in {w for w, _ in rows}:
        last = None
        for t in sorted(t for w, t in rows if w == worker):
            if last is not None and t - last > timeout:
                out.append((worker, last + timeout, False))
            if last is None or t - last > timeout:
                out.append((worker, t, True))
            last = t
        if last + timeout <= end:
            out.append((worker, last + timeout, False))
    return sorted(out)


def seconds(rows):
    epoch = START.replace(tzinfo=timezone.utc)
    return sorted((r.worker, int((r.at.replace(tzinfo=timezone.utc) - epoch).total_seconds()), r.online) for r in rows)


def test_silence_is_reported_by_a_stream_that_starts_again(spark, tmp_path):
    """Late heartbeats within the watermark, one worker with half of all, a restart in between, and a clock at the end."""
    rng = random.Random(1)
    rows = sorted({(rng.choice([1, 1, 1, 2, 3, 4]), rng.randint(0, 3_000)) for _ in range(500)} | {(5, 10), (6, 2_990)}, key=lambda r: r[1])
    parts = [rows[:150], rows[150:300], rows[300:]]
    parts[1].append(parts[0].pop(100))  # a late one, but not later than the watermark allows
    schema, folder = "worker long, ts timestamp", str(tmp_path)
    own = timers.state_session(spark)
    own.conf.set("spark.sql.shuffle.partitions", "2")

    def run():
        stream = own.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        timers.run_to_end(timers.liveness_stream(stream, 60, "30 minutes"), folder)

    for k, part in enumerate([*parts, [(-1, 100_000)]]):
        spark.createDataFrame([(w, at(t)) for w, t in part], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        if k != 1:
            run()  # each time a new query from where the last one ended
    got = seconds(spark.read.parquet(f"{folder}/out").where("worker >= 0").collect())
    assert got == beats_plain(rows, 60, 100_000)
    table = spark.createDataFrame([(w, at(t)) for w, t in rows], schema)
    assert seconds(timers.liveness_changes(table, at(100_000), 60).collect()) == got
    early = [(w, t) for w, t in rows if t <= 2_000]
    assert seconds(timers.liveness_changes(table, at(2_000), 60).collect()) == beats_plain(early, 60, 2_000)


def test_pools_refuse_what_is_beyond_their_cap(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b"]), rng.choice("xyz"), str(rng.randint(0, 30)), "sweep" if rng.random() < 0.02 else "put", float(k), k) for k in range(800)]
    schema = "pool string, key string, value string, op string, t double, seq long"
    frame = spark.createDataFrame(rows, schema)
    batch = {tuple(r) for r in timers.pool_batch(frame, 5, 12, 40.0).collect()}
    assert {r[2] for r in batch} == {"added", "refreshed", "replaced", "refused", "swept"}
    own = timers.state_session(spark)
    own.conf.set("spark.sql.shuffle.partitions", "2")
    for first, last in ((0, 300), (300, 800)):  # the second run reads the state that the first one left
        spark.createDataFrame(rows[first:last], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = own.readStream.schema(schema).parquet(f"{tmp_path}/in")
        timers.run_to_end(timers.pool_stream(stream, 5, 12, 40.0), str(tmp_path))
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == batch


def test_expired_entries_stay_until_a_sweep():
    pool = timers.Pool(2, 3, 10.0)
    assert [pool.put("k", v, t) for v, t in (("a", 0), ("b", 1))] == ["added", "added"] and pool.total == 2
    assert pool.put("k", "a", 30) == "replaced" and pool.total == 3  # the expired ones still count for the key
    assert pool.put("l", "a", 31) == "added" and pool.total == 3  # full, so that a sweep came first
    assert pool.put("l", "b", 32) == "refused" and pool.total == 3  # a replaced entry counts on, as in the reference
    assert pool.sweep(100) == 2 and pool.total == 1


def test_samples_as_batch_and_stream(spark, tmp_path):
    samples.register(spark)
    made = spark.range(100).select(*[(F.col("id") * (1 if c in samples.NARROW else 3)).cast(kind).alias(c) for c, kind in samples.KINDS.items() if c != "stack_sys"], F.timestamp_seconds("id").alias("timestamp"), F.lit("x").alias("other"))
    made.repartitionByRange(4, "timestamp").write.parquet(f"{tmp_path}/in")
    batch = spark.read.format("memory_samples").load(f"{tmp_path}/in")
    assert batch.columns == [*samples.COUNTERS, "timestamp"] and batch.rdd.getNumPartitions() == 4
    assert batch.count() == 100 and batch.where("stack_sys is not null").count() == 0 and batch.agg(F.sum("alloc")).first()[0] == 14_850
    assert samples.quick_stats(batch).first().num_gc == 99

    def read(files):
        stream = spark.readStream.format("memory_samples").option("files_per_batch", files).load(f"{tmp_path}/in")
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").start(f"{tmp_path}/out")
        query.processAllAvailable()
        sizes = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
        query.stop()
        return sizes

    assert read(2) == [50, 50]
    made.where("num_gc < 10").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    read(2)
    assert spark.read.parquet(f"{tmp_path}/out").count() >= 100


def test_overwritten_deleted_and_expired_entries(spark, tmp_path):
    path, moment = f"{tmp_path}/{uuid.uuid4().hex}", F.lit(100)
    schema = "key string, created long, expires long, size long, value string"
    entries = [("a", 1, None, 5, "old"), ("a", 2, 50, 5, "new, expired"), ("b", 1, 50, 5, "expired"), ("b", 3, 100, 5, "live"), ("c", 4, None, 5, "deleted"), ("d", 5, None, 5, "again"), ("e", 9, None, 5, None)]
    stores.cache_store(spark.createDataFrame(entries, schema), path)
    assert {r.key for r in stores.cache_live(spark, path, moment).collect()} == {"b", "c", "d", "e"}  # no tombstones yet
    stores.cache_delete(spark.createDataFrame([("c",), ("d",), ("never",)], "key string"), path, F.lit(5).cast("long"))
    stores.cache_store(spark.createDataFrame([("d", 6, None, 7, "written again")], schema), path)
    live = {r.key: r.value for r in stores.cache_live(spark, path, moment).collect()}
    assert live == {"b": "live", "d": "written again", "e": None}
    assert {r.key: r.value for r in stores.cache_live(spark, path, moment, versions=True).collect()} == {"a": "old", "b": "live", "d": "written again", "e": None}
    stores.cache_compact(spark, path, f"{path}-next", moment, capacity=12)
    assert {r.key for r in spark.read.parquet(f"{path}-next").collect()} == {"e", "d"}
    with pytest.raises(Exception, match="(?i)exist"):
        stores.cache_compact(spark, path, f"{path}-next", moment)


def test_puts_evict_and_let_keys_come_back(spark, tmp_path):
    path, schema, moment = f"{tmp_path}/puts", "key string, created long, expires long, size long", F.lit(0)
    put = lambda *rows: stores.cache_put(spark.createDataFrame(list(rows), schema), path, moment, 10)
    live = lambda: {(r.key, r.created) for r in stores.cache_live(spark, path, moment).collect()}
    put(("a", 1, None, 6), ("b", 2, None, 6))
    assert live() == {("b", 2)}
    put(("c", 3, None, 4))
    assert live() == {("b", 2), ("c", 3)}
    put(("a", 4, None, 6))
    assert live() == {("a", 4), ("c", 3)}


@pytest.mark.parametrize("path", ["", ".a", "a..b", "a.", "a.#(b", "a.@nothing", "#(a==1)x"])
def test_paths_that_are_none(path):
    with pytest.raises(paths.PathError):
        paths.parse_path(path)


BODY = r"""{"a": {"b c": [1, 2.5, "x", null, true, {"d": []}]}, "q": "it's \"quoted\"", "it's": 7, "n": null, "list": [{"a": 1, "b": [{"c": 1}, {"c": 2}]}, {"a": "1", "b": [{"c": 3}]}, {"b": []}], "0": "zero", "x*y": "star"}"""


@pytest.mark.parametrize(
    "path, wanted",
    [
        ("a.b c.#", "6"), ("a.b c.1", "2.5"), ("a.b c.3", ""), ("a.b c.4", "true"), ("a.b c.5", '{"d":[]}'), ("a.b c.5.d.#", "0"), ("a.b c.6", None), ("q", 'it\'s "quoted"'), ("it's", "7"), ("n", ""), ("n.x", None), ("0", "zero"), ("x\\*y", "star"), ("x*", "star"),
        ("list.#.b.#.c", "[[1,2],[3],[]]"), ("list.#.b.#.c|@flatten", "[1,2,3]"), ("list.#.b|0.0.c", "1"), ("list.#(a==1).b.#", "2"), ('list.#(a=="1").b.#', "1"), ("list.#(b.#(c==3)).a", "1"), ("list.#(a!=1)#|#", "1"), ("list.#(a)#|#", "2"),
        ('list.#(a==1)#.b.#(c>1)#.c', "[[2]]"), ("a.b c.#(==true)", "true"), ("a.b c.#(==null)#|#", "1"), ("a.b c.#(>=2)", "2.5"), ("@this.it's", "7"), ("list.1.@keys", '["a","b"]'), ("a.b c.@reverse.0.d", "[]"), ("missing", None), ("q.@tostr", r'"it'+"'"+r's \"quoted\""'),
    ],
)
def test_paths(spark, path, wanted):
    got = spark.createDataFrame([(BODY,), ("no json",), (None,), ("",)], "body string").select(paths.json_value(F.col("body"), path)).collect()
    assert [r[0] for r in got] == [wanted, None, None, None]


def test_placed_rewrites_against_bytes(spark):
    """Every rewrite from its definition, on values with all byte values, short ones, integers, null and nothing."""
    from quillstone.operators import placed, variants

    values = [(1, bytes(range(0, 256, 17))), (2, b"a"), (3, b"-12"), (4, b""), (5, None), (6, "é€".encode()), (7, b"007")]
    frame = spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in values], "id long, v binary")
    got = {(r.id, r.mutator, r["size"], r.delta, r.place): bytes(r.variant) for r in placed.placed_variants(frame, "id", "v", delta=3).collect()}
    wanted = {}
    for k, v in values:
        for at in range(len(v or b"")):
            for w in placed.WIDTHS:
                if at + w <= len(v):
                    wanted[k, "byte_flip", w, 0, at] = variants.flip_bytes(v, at, w)
                    wanted |= {(k, "add", w, d, at): variants.add_at(v, at, d, 8 * w) for d in (-3, -2, -1, 1, 2, 3)}
            wanted |= {(k, "swap", w, 0, at): variants.swap_bytes(v, at, w) for w in placed.SWAPS if at + w <= len(v)}
            wanted |= {(k, "delete", w, 0, at): variants.delete_at(v, at, w) for w in placed.DELETED if at + w <= len(v)}
        if k in (3, 7):
            wanted |= {(k, "text_add", 0, d, None): variants.add_to_text(v, d) for d in (-3, -2, -1, 1, 2, 3)}
    assert {key: x for key, x in got.items() if key[1] not in ("random_byte", "insert", "clone")} == wanted
    whole = dict(values)
    for (k, mutator, size, _, at), x in got.items():
        v = whole[k]
        if mutator == "random_byte":
            assert x[:at] == v[:at] and x[at + 1 :] == v[at + 1 :] and len(x) == len(v)
        elif mutator == "insert":
            assert x[:at] == v[:at] and x[at + size :] == v[at:]
        elif mutator == "clone":
            assert any(x == variants.clone_at(v, at, size, t) for t in range(len(v) + 1))
    assert sum(key[1] == "random_byte" for key in got) == sum(len(v or b"") for _, v in values)


def test_json_documents_are_dealt_by_size_not_by_splits(spark, monkeypatch):
    """A table larger than what is spread over the cores still has tasks of bounded size, though it is one split."""
    from quillstone import shared
    from quillstone.operators import paths

    assert shared.dealt(spark.range(1000), 800).rdd.getNumPartitions() == 10
    monkeypatch.setattr(paths, "EVENTS_BYTES", 100_000)
    made = paths.nested_documents(spark, "/root/testdata/sf0.1")
    assert made.rdd.getNumPartitions() >= 20 and made.count() == 100_000


def test_pool_stream_takes_bounded_batches_in_order(spark, monkeypatch):
    """A log of many batches gives what the whole log gives, and no micro-batch has all of it."""
    import glob

    from quillstone.shared import shared_folder

    sf, base = "/root/testdata/sf0.01", shared_folder(spark).removeprefix("file:")
    before = set(glob.glob(f"{base}/pools-*"))
    monkeypatch.setattr(timers, "BATCH_ROWS", 2_000)
    got = sorted(map(tuple, timers.capped_pool_stream(spark, sf).select("pool", "seq", "action", "gone", "total").collect()))
    assert got == sorted(map(tuple, timers.capped_pool_actions(spark, sf).select("pool", "seq", "action", "gone", "total").collect()))
    (made,) = set(glob.glob(f"{base}/pools-*")) - before
    assert len(glob.glob(f"{made}/state/commits/[0-9]*")) >= 5
    assert max(spark.read.parquet(f).count() for f in glob.glob(f"{made}/in/*.parquet")) < 4_000


def test_placed_digests_make_rewrites_where_the_values_are(spark):
    """No rewrite is shuffled, and the digests are those of the listed rewrites, also where an id has several values or is null."""
    import hashlib
    from collections import defaultdict

    from quillstone.operators import placed

    values = [(1, b"Supplier"), (1, b"Supp"), (1, b"12"), (2, b""), (3, None), (4, b"-7"), (4, None), (None, b"ab"), (None, b"c"), (5, "é,".encode())]
    frame = spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in values], "id long, v binary")
    wanted = defaultdict(list)
    for r in placed.placed_variants(frame, "id", "v", delta=3).collect():
        wanted[r.id, r.mutator].append((r.place or 0, r["size"], r.delta, bytes(r.variant).hex().upper()))
    made = placed.placed_digests(frame, "id", "v", delta=3)
    assert made.columns == ["id", "mutator", "n", "digest"]
    got = [((r.id, r.mutator), (r.n, r.digest)) for r in made.collect()]
    assert len(got) == len(wanted) and dict(got) == {k: (len(x), hashlib.md5(",".join(v for *_, v in sorted(x)).encode()).hexdigest()) for k, x in wanted.items()}
    plan = placed.placed_rewrites(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" in plan.split("Exchange")[0] and "Generate" not in plan.split("Exchange")[1]
    assert placed.placed_variants(frame, "id", "v", delta=0).where("mutator in ('add', 'text_add')").count() == 0


def test_pool_stream_has_few_stores_and_hands_over_arrays(spark):
    """However many partitions a session shuffles to, four pools have four stores, and a micro-batch is a few rows of arrays."""
    import glob

    from quillstone.shared import shared_folder

    sf, base, before = "/root/testdata/sf0.01", shared_folder(spark).removeprefix("file:"), spark.conf.get("spark.sql.shuffle.partitions")
    old = set(glob.glob(f"{base}/pools-*"))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "24")
        got = sorted(map(tuple, timers.capped_pool_stream(spark, sf).select("pool", "seq", "action", "gone", "total").collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == sorted(map(tuple, timers.capped_pool_actions(spark, sf).select("pool", "seq", "action", "gone", "total").collect()))
    (made,) = set(glob.glob(f"{base}/pools-*")) - old
    assert len(glob.glob(f"{made}/state/state/0/[0-9]*")) == 4
    assert spark.read.parquet(f"{made}/in").count() <= 16


def test_packed_pools_take_odd_rows(spark, tmp_path):
    """Null pools, keys, values and operations, rows without a time, equal times, and one pool with most rows."""
    rng = random.Random(3)
    rows = [(rng.choice([7, 7, 7, 8, None]), rng.choice(["x", "y", None]), rng.choice(["a", "b", "", None]), rng.choice(["put"] * 9 + ["sweep", None]), None if k % 50 == 49 else float(k // 2), k) for k in range(600)]
    schema = "pool long, key string, value string, op string, t double, seq long"
    frame = spark.createDataFrame(rows, schema)
    timers.written_in_order(frame, ["t", "seq"], f"{tmp_path}/in", 100)
    own = timers.state_session(spark, 3)
    stream = own.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    timers.run_to_end(timers.pool_stream(stream, 3, 9, 40.0), str(tmp_path))
    batch = {tuple(r) for r in timers.pool_batch(frame, 3, 9, 40.0).collect()}
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == batch and len(batch) == 600
    packs = timers.packed(frame)
    assert sorted(map(repr, packs.select("pool", F.inline(F.arrays_zip(*timers.PACKED))).select(*frame.columns).collect())) == sorted(map(repr, frame.collect()))


def test_full_pools_sweep_as_if_at_each_put():
    """Looking only where an entry can have expired gives what a look at each put gives; a full pool of live entries is left alone."""

    class Eager(timers.Pool):
        def sweep(self, now):
            self.soonest = float("-inf")
            return super().sweep(now)

    rng = random.Random(4)
    for trial in range(200):
        lazy, eager, t = timers.Pool(3, 6, 10.0), Eager(3, 6, 10.0), 0.0
        for k in range(150):
            t += rng.choice([0.0, 0.5, 3.0])
            row = {"op": rng.choice(["put"] * 8 + ["sweep"]), "key": rng.choice("ab"), "value": rng.choice("uvwxyz"), "t": float("nan") if rng.random() < 0.02 else t, "seq": k}
            assert lazy.step(row) == eager.step(row) and repr(lazy.entries) == repr(eager.entries)
            if k == 75:
                lazy = timers.Pool(3, 6, 10.0, lazy.entries, lazy.total)
    full = timers.Pool(2, 2, 100.0)
    assert [full.put("k", v, 0.0) for v in "ab"] == ["added", "added"]
    full.entries = None  # nothing may be looked at
    assert full.put("k", "c", 50.0) == "refused"
