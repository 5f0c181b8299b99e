"""Hot keys and single tasks: results with one key that holds half of the rows, and plans without windows over everything."""

import random

import pytest
from pyspark.sql import functions as F

from quillstone.functions import similarity
from quillstone.operators import coverage, ordered, stats
from quillstone.shared import folded
from quillstone.streaming import stateful


def test_a_fold_of_a_hot_key_over_many_batches(spark):
    """One key has half of 60,000 rows; a state lives across batches, and null keys are a key of their own."""
    rows = spark.range(60_000).select(F.when(F.col("id") % 2 == 0, 0).when(F.col("id") % 10 == 1, None).otherwise(F.col("id") % 7 + 1).alias("k"), F.col("id").alias("seq")).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        last = folded(rows, "k", ["seq"], lambda s, r: s.update(n=s.get("n", 0) + 1, sum=s.get("sum", 0) + r["seq"], order=s.get("order", True) and r["seq"] > s.get("last", -1), last=r["seq"]) or [], "n long, sum long, order boolean", lambda s: [{"n": s["n"], "sum": s["sum"], "order": s["order"]}])
        got = {r.k: (r.n, r["sum"]) for r in last.collect() if r.order}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {r.k: (r.n, r.s) for r in rows.groupBy("k").agg(F.count("*").alias("n"), F.sum("seq").alias("s")).collect()}


def test_truncating_mean_replays_in_order(spark):
    rng = random.Random(1)
    data = [(rng.choice("aaab"), k, rng.randint(-50, 50)) for k in range(500)]
    got = {r.k: r["mean"] for r in stats.truncating_mean(spark.createDataFrame(data, "k string, t long, x long"), "k", "x", ["t"]).collect()}
    for key in "ab":
        mean = 0
        for n, (_, _, x) in enumerate([d for d in data if d[0] == key], 1):
            mean += int((x - mean) / n)
        assert got[key] == mean


def test_hit_steps_with_a_hot_edge(spark):
    """An edge with half of all recordings, some of them repeated: counts saturate, and every recording comes back."""
    rng = random.Random(2)
    data = [(rng.randint(0, 300), rng.randint(0, 3), 4, 9) if rng.random() < 0.5 else (rng.randint(0, 300), rng.randint(0, 3), rng.randint(0, 50), rng.randint(0, 50)) for _ in range(3000)]
    edges = spark.createDataFrame(data, "exec_id long, seq long, from_block long, to_block long").repartition(4)
    got = sorted((r.edge, r.exec_id, r.seq, r.n) for r in coverage.hit_steps(edges).collect())
    seen, wanted = {}, []
    for e, s, a, b in sorted(data):
        edge = ((a >> 1) ^ b) % 65536
        wanted.append((edge, e, s, a, b))
    wanted.sort(key=lambda w: (w[0], *w[1:]))
    for edge, e, s, *_ in wanted:
        seen.setdefault(edge, []).append((e, s))
    assert got == sorted((edge, e, s, min(n, 255)) for edge, rows in seen.items() for n, (e, s) in enumerate(sorted(rows), 1))


def test_map_hash_is_that_of_the_whole_bitmap(spark):
    import hashlib

    for hits in ({}, {0: 1}, {65535: 255}, {0: 3, 1: 16, 5: 7, 40000: 1, 65535: 9}):
        rows = spark.createDataFrame(list(hits.items()), "edge long, hits long")
        assert coverage.map_hash(rows).first()[0] == hashlib.sha256(bytes(hits.get(k, 0) for k in range(65536))).hexdigest()


def test_residents_of_one_cache_need_no_single_task(spark):
    data = [(f"k{k % 40}", k, k, 1 + k % 9) for k in range(400)]
    log = spark.createDataFrame(data, "key string, t long, seq long, size long").withColumn("ts", F.timestamp_seconds("t"))
    got = {r.key: r.used for r in ordered.resident_after(log, 60).collect()}
    used, wanted = 0, {}
    for key, _, _, size in reversed(data[-40:]):
        used += size
        if used <= 60:
            wanted[key] = used
    assert got == wanted
    plan = ordered.resident_after(log, 60)._jdf.queryExecution().executedPlan().toString()
    assert "since" in plan and not any("Window [sum(size" in line and "[__since" not in line and "__part" not in line for line in plan.splitlines())


def test_lru_keeps_its_sum(spark):
    """Against a cache that sums its entries each time."""
    rng, state, held = random.Random(3), {}, {}
    fold = stateful.lru_cache(50)
    for seq in range(2000):
        row = {"key": rng.randint(0, 12), "t": seq * 1.0, "op": rng.choice(["get", "set"]), "size": rng.randint(1, 20), "ttl": 30.0, "seq": seq}
        got = fold(state, row)[0]
        key = str(row["key"])
        entry = held.pop(key, None)
        entry = None if entry and entry[1] < row["t"] else entry
        if row["op"] == "get":
            if entry:
                held[key] = entry
            assert got["result"] == ("hit" if entry else "miss")
        else:
            held[key], evicted = [row["size"], row["t"] + 30.0], 0
            while sum(e[0] for e in held.values()) > 50 and len(held) > 1:
                del held[next(iter(held))]
                evicted += 1
            assert got["evicted"] == evicted and state["used"] == sum(e[0] for e in held.values())


@pytest.mark.parametrize("most", [0, 1, 3, 7])
def test_hamming_pairs_against_all_pairs(spark, most):
    """Random hashes, near ones, and a block of hashes that share most masks; each pair once."""
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(60)]
    values = set(base) | {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 5))) & (1 << 64) - 1 for b in base for _ in range(4)} | set(range(40))
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    rows = spark.createDataFrame([(v,) for v in signed * 2] + [(None,)], "h long")
    got = sorted((r.a, r.b, r.distance) for r in similarity.hamming_pairs(rows, most).collect())
    apart = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    assert got == [(a, b, apart(a, b)) for k, a in enumerate(signed) for b in signed[k + 1 :] if apart(a, b) <= most]


def test_strings_hashed_together_equal_those_hashed_alone():
    rng = random.Random(5)
    items = [bytes(rng.getrandbits(8) for _ in range(rng.choice([0, 1, 3, 40, 300]))) for _ in range(200)] + [b"x" * 30_000]
    for bits in (32, 64):
        assert similarity.fnv1a_many(items, bits).tolist() == [similarity.fnv1a(x, bits) for x in items]
    lists = [[b"a", b"b"], [], [b"c"] * 50, items]
    assert similarity.feature_simhashes(iter(lists), most=7) == [similarity.feature_simhash(x) for x in lists]
