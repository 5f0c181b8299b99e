"""Orders, sums and links over many rows: carried columns, hot keys and buckets, against plain windows and all pairs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstone import shared
from quillstone.functions import similarity
from quillstone.operators import coverage, ordered
from quillstone.sources import stores


@pytest.fixture(params=["true", "false"])
def adaptive(spark, request):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", request.param)
    yield request.param
    spark.conf.set("spark.sql.adaptive.enabled", before)


def shuffled(spark, n):
    """n rows with a shuffled order and two carried columns, in ten parts."""
    return spark.range(n).select(F.pmod(F.col("id") * 7919, F.lit(n)).alias("place"), (F.col("id") % 11).alias("v"), F.concat(F.lit("text "), F.col("id")).alias("carried"), F.lit(3.5).alias("more")).repartition(10)


def test_running_totals_of_many_rows_with_carried_columns(spark, adaptive):
    rows = shuffled(spark, 200_000)
    wanted = rows.withColumn("wanted", F.sum("v").over(Window.orderBy("place"))).select("place", "wanted")
    for together in (shared.TOGETHER, 10_000):
        got = shared.running_total(rows, "place", "v", together)
        assert set(got.columns) == {"place", "v", "carried", "more", "total"}
        assert got.count() == 200_000 and got.join(wanted, "place").where("total <> wanted").count() == 0
        assert got.where(F.col("carried").isNull()).count() == 0


def test_numbers_of_many_rows(spark, adaptive):
    got = shared.numbered(shuffled(spark, 200_000), ["place"])
    assert got.where("number <> place + 1").count() == 0 and got.count() == 200_000
    assert shared.numbered(shuffled(spark, 200_000).limit(0), ["place"]).collect() == []


@pytest.mark.parametrize("capacity", [0, 57, 10_000, 400_000, 10**9])
def test_residents_of_many_keys(spark, monkeypatch, capacity):
    """One cache of 200,000 keys whose times are mostly equal; a count and a read of one frame agree."""
    log = spark.range(200_000).select(F.concat(F.lit("k"), F.col("id")).alias("key"), F.timestamp_seconds(F.col("id") % 1_000 * F.when(F.col("id") % 3 == 0, 0).otherwise(1)).alias("ts"), F.col("id").alias("seq"), (F.col("id") % 9).alias("size"), F.lit("x").alias("carried"))
    w = Window.orderBy(F.desc("ts"), F.desc("seq"))
    wanted = {(r.key, r.used) for r in log.withColumn("used", F.sum("size").over(w)).where(F.col("used") <= capacity).select("key", "used").collect()}
    for together in (shared.TOGETHER, 1 << 30):
        monkeypatch.setattr(ordered, "TOGETHER", together)
        got = ordered.resident_after(log, capacity)
        rows = got.select("key", "used").collect()
        assert {(r.key, r.used) for r in rows} == wanted and got.count() == len(rows) == len(wanted)


def test_evicted_caches_agree_with_themselves(spark):
    rows = spark.range(200_000).select(F.col("id").cast("string").alias("key"), F.col("id").alias("created"), F.lit(1).cast("long").alias("size"), F.lit("x").alias("more"))
    kept = stores.cache_evicted(rows, 10_000)
    assert kept.count() == len(kept.collect()) == 10_000 and kept.agg(F.min("created")).first()[0] == 190_000


def test_up_to_border_sorts_nothing_and_loses_nothing(spark):
    rng = random.Random(1)
    data = [(rng.choice([-5, 0, 3, 1 << 40]), rng.randint(-9, 9), rng.choice([0, 1, 7])) for _ in range(400)]
    rows = spark.createDataFrame(data, "a long, b long, v long")
    for limit in (0, 3, 100, 500, 10_000):
        total, wanted = 0, []
        for a, b in sorted({(a, b) for a, b, _ in data}):
            wanted.append((a, b))
            total += sum(v for x, y, v in data if (x, y) == (a, b))
            if total > limit:
                break
        got = {(r.a, r.b) for r in shared.up_to_border(rows, ["a", "b"], "v", limit, 3).collect()}
        assert got == set(wanted), limit


def test_chunks_are_found_by_halving(spark):
    bounds = [3, 3, 10, 20]
    got = spark.range(25).select("id", shared.chunk_of(F.col("id"), bounds).alias("c")).collect()
    assert all(r.c == sum(b <= r.id for b in bounds) for r in got)
    assert spark.range(1).select(shared.chunk_of(F.col("id"), [])).first()[0] == 0


def test_lists_of_callers_are_checked(spark):
    rows = spark.range(50).select(F.col("id").cast("string").alias("w"))
    assert spark.range(1).select(shared.gathered(rows, "w", 50)).first()[0] == sorted(str(k) for k in range(50))
    assert spark.range(1).select(shared.gathered(rows.limit(0), "w")).first()[0] == []
    with pytest.raises(Exception, match="more than 49 values"):
        spark.range(1).select(shared.gathered(rows, "w", 49)).collect()


def test_history_is_the_end_of_the_running_total(spark):
    hits = spark.range(5_000).select((F.col("id") % 1_700).alias("exec_id"), F.pmod(F.xxhash64("id"), F.lit(900)).alias("edge"))
    w = Window.orderBy("exec_id")
    wanted = coverage.novelty(hits).withColumn("covered", F.sum("new_edges").over(w)).orderBy(F.desc("exec_id")).limit(300)
    assert sorted(map(tuple, coverage.history(hits, 300).collect())) == sorted(map(tuple, wanted.collect()))


@pytest.mark.parametrize("chunks", [1, 2, 64])
def test_hit_steps_in_chunks(spark, chunks):
    """One edge with two thirds of all recordings, and one execution with a half of them."""
    rows = spark.range(6_000).select(F.when(F.col("id") % 2 == 0, 40).otherwise(F.col("id") % 200).alias("exec_id"), (F.col("id") % 5).alias("seq"), F.when(F.col("id") % 3 > 0, 4).otherwise(F.col("id") % 40).alias("from_block"), F.when(F.col("id") % 3 > 0, 9).otherwise(F.col("id") % 6).alias("to_block"))
    edge = coverage.edge_index(F.col("from_block"), F.col("to_block"))
    w = Window.partitionBy("edge").orderBy("exec_id", "seq", "from_block", "to_block")
    wanted = rows.withColumn("edge", edge).withColumn("n", F.least(F.row_number().over(w), F.lit(255)))
    key = ["edge", "exec_id", "seq", "n"]
    assert sorted(map(tuple, coverage.hit_steps(rows, chunks).select(*key).collect())) == sorted(map(tuple, coverage.hit_steps(rows, chunks, 100).select(*key).collect()))
    assert sorted(map(tuple, coverage.hit_steps(rows, chunks, 100).select(*key).collect())) == sorted(map(tuple, wanted.select(*key).collect()))


# --- Links --------------------------------------------------------------------------------------------------------


def test_hamming_links_with_a_hot_bucket(spark):
    """Half of the hashes differ in their last bits only, so that they share buckets: cells of eight members a side."""
    rng = random.Random(2)
    base = rng.getrandbits(63) & ~0xFFF
    values = [base ^ k for k in range(200)] + [rng.getrandbits(63) for _ in range(200)]
    values += rng.choices(values, k=150) + [None, None]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "id long, h long")
    for most in (1, 3):
        for block in (8, 4_096):
            got = {r.id: (r.same, r.links) for r in similarity.hamming_links(rows, most, block).collect()}
            for k, v in enumerate(values):
                near = [o for o in values if o is not None and v is not None and (o ^ v).bit_count() <= most]
                assert got[k] == ((values.count(v), len(near) - 1) if v is not None else (0, 0))


def test_cells_bound_what_one_task_meets(spark):
    left = spark.range(3_000).select(F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("a"))
    right = spark.range(2_000).select(F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("b"))
    cells = similarity.in_cells(left, right, ["k"], "a", "b", 100)
    plain = left.join(right, "k")
    assert cells.columns == plain.columns and cells.count() == plain.count() == cells.distinct().count()
    assert cells.exceptAll(plain).count() == 0
    empty = similarity.in_cells(left.limit(0), right, ["k"], "a", "b", 100)
    assert empty.count() == 0


def test_lsh_links_count_classes_not_copies(spark):
    rng = random.Random(3)
    base = [[rng.getrandbits(40) for _ in range(100)] for _ in range(6)]
    near = [[x if rng.random() < 0.97 else 0 for x in base[0]] for _ in range(20)]
    index = [(k, sig) for k, sig in enumerate(base + near + [base[1]] * 400)] + [(9_999, None)]
    probes = [(k, sig) for k, sig in enumerate([base[0], base[1], base[1], near[3], [1] * 100])]
    schema = "id long, sig array<bigint>"
    p, c = spark.createDataFrame(probes, schema), spark.createDataFrame(index, schema)
    band = lambda s, k: tuple(s[5 * k : 5 * k + 5])
    linked = lambda x, y: any(band(x, k) == band(y, k) for k in range(20))
    wanted = {(a, b) for a, x in probes for b, y in index if y is not None and linked(x, y)}
    assert {(r.probe, r.candidate) for r in similarity.lsh_candidates(p, c, "id", "id").collect()} == wanted
    for block in (3, 4_096):
        pairs = similarity.lsh_links(similarity.lsh_classes(p, "id"), similarity.lsh_classes(c, "id"), block).collect()
        assert sum(r.probes * r.candidates for r in pairs) == len(wanted) and len(pairs) < 60


def test_one_scan_gives_what_the_passes_give(spark):
    """Random texts of pieces that the dropped patterns are made of, and their neighbours."""
    rng = random.Random(4)
    pieces = ["2024-01-31", "12:30:59", "a" * 19, "b" * 20, "0f" * 16, "0f" * 20, "0f" * 32, "0f" * 33, "csrf_token: 'x y'", "csrf-token = abc", "<b>", "<", ">", " ", "\t", "\n", "word", "Ünï", "٣٤", "7", "-", "_", ":", "X" * 12 + "2024-01-31" + "y" * 15, "İ", "ΣΑΣ"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(600)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for strip in (True, False):
        passes = [r[0] for r in rows.select(similarity.preprocessed(F.col("t"), strip)).collect()]
        assert [similarity.scanned(t, strip).split() for t in texts] == [p.split() for p in passes]


def test_text_features_are_ngrams():
    assert similarity.text_features("a b c d") == [b"a b c", b"b c d"] and similarity.text_features("a é") == [b"a", "é".encode()] and similarity.text_features(" ") == []
    assert re.search(r"\d", similarity.scanned("a1 b2")) is None


@pytest.mark.parametrize("most", range(1, 7))
def test_every_mask_is_selective_and_all_near_pairs_are_covered(most):
    """A mask of one bit would make half of all hashes one bucket."""
    masks = np.array(similarity.covering_masks(most), np.int64).view(np.uint64)
    assert all(int(m).bit_count() == 32 for m in masks) and len(set(masks.tolist())) == len(masks)
    rng = np.random.default_rng(most)
    apart = [sum(1 << int(p) for p in rng.choice(64, rng.integers(1, most + 1), replace=False)) for _ in range(20_000)]
    assert ((np.array(apart, np.uint64)[:, None] & masks) == 0).any(axis=1).all()


@pytest.mark.parametrize("block", [4_096, 4])
def test_lsh_near_counts_each_pair_once_and_shuffles_no_pairs(spark, block):
    """Classes that share no band, one, or all of them, against all pairs; pairs are neither exchanged nor made distinct."""
    rng = random.Random(3)
    sigs = [[rng.randint(0, 2) if k < 10 else c for k in range(similarity.BANDS * similarity.ROWS)] for c in range(40)]
    sigs += [[-1 if 20 <= k < 25 else 1000 + 50 * c + k for k in range(100)] for c in range(30)] + [[7_000 + k + (k == 99) * c for k in range(100)] for c in range(5)]
    n = [rng.randint(1, 3) for _ in sigs]
    bands = [[tuple(s[b * 5 : b * 5 + 5]) for b in range(20)] for s in sigs]
    wanted = {i: sum(n[j] for j in range(len(sigs)) if j != i and any(a == b for a, b in zip(bands[i], bands[j]))) for i in range(len(sigs))}
    classes = spark.createDataFrame([(i, n[i], s) for i, s in enumerate(sigs)], "cls long, n long, sig array<long>")
    near = similarity.lsh_near(classes, block)
    assert {r.cls: r.near for r in near.collect()} == {i: w for i, w in wanted.items() if w}
    links = similarity.lsh_links(classes, classes, block)
    assert "Aggregate" not in links._jdf.queryExecution().optimizedPlan().toString() and links.count() == len(links.distinct().collect())


def test_python_holds_pieces_of_a_batch(spark, monkeypatch):
    """However many texts a batch has, they become objects a bounded number of bytes at a time; results stay in their places."""
    import pyarrow as pa

    texts = ["", None, "x" * 50, *["some words of text"] * 20, None, "é" * 30]
    for kind in (pa.string(), pa.large_string()):
        pieces = list(similarity._pieces(pa.array(texts, kind), 40))
        assert [x for p in pieces for x in p.to_pylist()] == texts
        assert all(len(p) == 1 or sum(len((x or "").encode()) for x in p.to_pylist()) <= 40 for p in pieces) and len(pieces) >= 11
    many = [t for k in range(300) for t in (f"document {k} " * 700, None)]
    rows = spark.createDataFrame(list(enumerate(many)), "i long, t string").coalesce(1)
    got = {r.i: r for r in rows.select("i", similarity.minhash_signature(F.col("t"), 8).alias("m"), similarity.simhash_text(F.col("t")).alias("h"), similarity.simhash_bytes(F.col("t")).alias("b")).collect()}
    for i in (0, 1, 298, 599):
        t = many[i]
        wanted = (None, None, None) if t is None else (similarity.minhash(t.encode(), 8).astype(np.int64).tolist(), similarity.feature_simhash(similarity.text_features(similarity.scanned(t))), similarity.byte_simhash(t.encode()))
        assert (got[i].m, got[i].h, got[i].b) == wanted
