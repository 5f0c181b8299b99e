"""Coverage of executions: sparse edges instead of dense bitmaps, novelty, history, corpus upkeep.

A bitmap of 65,536 slots per execution becomes rows (exec_id, edge, hits); merging is a maximum per edge and
novelty the first execution of each edge, both aggregations that combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scoring import hit_bucket
from ..registry import Registry
from ..shared import TOGETHER, chunk_of, running_total  # noqa: F401  running_total is found here too
from ..views import EXECUTIONS_SQL, docs, executions, table

R = Registry()
MAP_SIZE, HISTORY, MOST_HITS = 65_536, 1_000, 255


def edge_index(source: Column, target: Column, size: int = MAP_SIZE) -> Column:
    """(from >> 1) ^ to, modulo the map's size."""
    return F.pmod(F.shiftright(source, 1).bitwiseXOR(target), F.lit(size))


def block_id(file: Column, line: Column) -> Column:
    """The first four bytes of SHA-256(file, line as four bytes, least first), read least first."""
    number = F.lpad(F.hex(line), 8, "0")
    little = F.concat(*[F.substring(number, k, 2) for k in (7, 5, 3, 1)])
    digest = F.sha2(F.concat(F.encode(file, "UTF-8"), F.unhex(little)), 256)
    return F.conv(F.concat(*[F.substring(digest, k, 2) for k in (7, 5, 3, 1)]), 16, 10).cast("bigint")


def edge_hits(edges: DataFrame) -> DataFrame:
    """(exec_id, edge, hits) with hits capped as in a byte."""
    counted = edges.groupBy("exec_id", edge_index(F.col("from_block"), F.col("to_block")).alias("edge")).agg(F.count("*").alias("n"))
    return counted.select("exec_id", "edge", F.least("n", F.lit(MOST_HITS)).cast("int").alias("hits"))


def merged(hits: DataFrame) -> DataFrame:
    """(edge, hits): the element-wise maximum over all executions."""
    return hits.groupBy("edge").agg(F.max("hits").alias("hits"))


def novelty(hits: DataFrame) -> DataFrame:
    """(exec_id, new_edges) for each execution, in order of exec_id: the edges that no earlier one covers."""
    first = hits.groupBy("edge").agg(F.min("exec_id").alias("exec_id"))
    news = first.groupBy("exec_id").agg(F.count("*").alias("new_edges"))
    return hits.select("exec_id").distinct().join(news, "exec_id", "left").select("exec_id", F.coalesce("new_edges", F.lit(0)).alias("new_edges"))


def history(hits: DataFrame, most: int = HISTORY) -> DataFrame:
    """The latest snapshots: (exec_id, new_edges, covered) of the last `most` executions.

    What the last one covers is the sum over all; those before it cover as much less as later ones add. So a top-k and one sum do,
    and only `most` rows are put in order.
    """
    news = novelty(hits)
    last = news.orderBy(F.desc("exec_id")).limit(most)
    since = F.sum("new_edges").over(Window.orderBy(F.desc("exec_id")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = news.agg(F.sum("new_edges")).scalar()
    return last.withColumn("covered", total - since + F.col("new_edges"))


def hit_steps(edges: DataFrame, chunks: int = 64, together: int = TOGETHER) -> DataFrame:
    """Each recording with its saturating count, and whether the edge is new or enters another bucket, in order (exec_id, seq).

    Recordings are counted per edge first, combined before the shuffle; edges with more than `together`, which one task should
    not rank, come to the driver, MAP_SIZE numbers at most. Their executions are cut into chunks of about equal size, at
    bounds that are found once; each recording is ranked inside its chunk, behind the counts of those before. All
    others are one chunk. Rows that are equal in every column count each.
    """
    columns = [x for x in edges.columns if x not in ("exec_id", "seq")]
    marked = edges.withColumn("edge", edge_index(F.col("from_block"), F.col("to_block")))
    hot = [r.edge for r in marked.groupBy("edge").agg(F.count("*").alias("n")).where(F.col("n") > together).collect()]
    if not hot:
        n = F.row_number().over(Window.partitionBy("edge").orderBy("exec_id", "seq", *columns))
        return _stepped(marked.withColumn("n", F.least(n, F.lit(MOST_HITS)).cast("int")))
    is_hot = F.col("edge").isin(hot)
    bounds = sorted({int(b) for b in marked.where(is_hot).approxQuantile("exec_id", [k / chunks for k in range(1, chunks)], 0.5 / chunks)}) if chunks > 1 else []
    marked = marked.withColumn("__chunk", F.when(is_hot, chunk_of(F.col("exec_id"), bounds)).otherwise(-1))
    earlier = Window.partitionBy("edge").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    per_chunk = marked.where(is_hot).groupBy("edge", "__chunk").agg(F.count("*").alias("__n"))
    before = per_chunk.select("edge", "__chunk", F.sum("__n").over(earlier).alias("__before"))
    inside = Window.partitionBy("edge", "__chunk").orderBy("exec_id", "seq", *columns)
    ranked = marked.withColumn("__rank", F.row_number().over(inside)).join(before, ["edge", "__chunk"], "left")
    n = F.least(F.col("__rank") + F.coalesce("__before", F.lit(0)), F.lit(MOST_HITS)).cast("int")
    return _stepped(ranked.select(*edges.columns, "edge", n.alias("n")))


def _stepped(counted: DataFrame) -> DataFrame:
    bucket = hit_bucket(F.col("n"))
    before = hit_bucket(F.least(F.col("n") - 1, F.lit(MOST_HITS)))
    return counted.withColumns({"bucket": bucket, "is_new": F.col("n") == 1, "crossed": (bucket != before) & (F.col("n") < MOST_HITS)})


def chained_edges(blocks: DataFrame) -> DataFrame:
    """(prev >> 1) ^ cur along each execution, prev being 0 at first."""
    order = Window.partitionBy("exec_id").orderBy("seq")
    before = F.lag("to_block", 1, 0).over(order)
    return blocks.withColumn("edge", F.shiftright(before, 1).bitwiseXOR(F.col("to_block")))


def map_stats(covered: DataFrame) -> DataFrame:
    return covered.agg(F.count("*").alias("edges"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"), (F.count("*") / MAP_SIZE * 100).alias("percent"))


def map_hash(covered: DataFrame, size: int = MAP_SIZE) -> DataFrame:
    """SHA-256 of the whole bitmap, rebuilt as bytes from its sparse rows: at most `size` of them, a proven bound."""
    rows = covered.agg(F.array_sort(F.collect_list(F.struct(F.col("edge").cast("int").alias("k"), "hits"))).alias("m"))
    before = lambda i: F.when(i == 0, -1).otherwise(F.element_at("m", F.greatest(i, F.lit(1)))["k"])
    pieces = F.transform("m", lambda e, i: F.concat(F.repeat(F.lit("00"), e["k"] - before(i) - 1), F.lpad(F.hex(e["hits"]), 2, "0")))
    rest = F.repeat(F.lit("00"), F.lit(size - 1) - F.coalesce(F.element_at("m", -1)["k"], F.lit(-1)))
    return rows.select(F.sha2(F.unhex(F.concat(F.array_join(pieces, ""), F.when(F.size("m") > 0, rest).otherwise("00" * size))), 256).alias("hash"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus entries over documents: hash of the text, its size, edges covered (its words modulo 40), seeds by source."""
    d = docs(spark, sf_dir)
    size = F.octet_length("text").cast("bigint")
    return d.select("doc_id", F.sha2("text", 256).alias("hash"), size.alias("size"), F.pmod(size, F.lit(40)).alias("edges"), (F.col("source") == "src1").alias("is_seed"), F.lit(False).alias("favored"))


CORPUS_SQL = """corpus AS (SELECT doc_id, sha256(text) AS hash, CAST(octet_length(encode(text)) AS BIGINT) AS size, CAST(octet_length(encode(text)) AS BIGINT) % 40 AS edges, source = 'src1' AS is_seed, false AS favored FROM documents)"""


def keep_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the first in order, without sorting: a minimum over structs combines before the shuffle."""
    rest = [c for c in rows.columns if c not in (key, order)]
    first = rows.groupBy(key).agg(F.min(F.struct(order, *rest)).alias("__row"))
    return first.select(key, "__row.*").select(*rows.columns)


def corpus_minimise(entries: DataFrame) -> DataFrame:
    """Entries that stay: those with edges, seeds, favoured ones, and the best (most edges, then hash), which becomes favoured."""
    per_count = entries.groupBy("edges").agg(F.min("hash").alias("hash"))
    best = per_count.agg(F.max_by("hash", "edges")).scalar()
    favored = F.col("favored") | (F.col("hash") == best)
    return entries.withColumn("favored", favored).where((F.col("edges") > 0) | F.col("is_seed") | F.col("favored"))


def corpus_stats(entries: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0))
    return entries.agg(
        F.count("*").alias("entries"),
        zero(F.sum("size")).alias("total"),
        zero(F.expr("sum(size) div count(*)")).alias("mean"),
        zero(F.max("size")).alias("largest"),
        zero(F.min("size")).alias("smallest"),
        F.count_if("favored").alias("favored"),
        F.count_if("is_seed").alias("seeds"),
    )


def schedule(entries: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k entries drawn with weight log2(edges + 1), without replacement: the largest keys u ** (1 / weight), u from a seeded hash."""
    u = (F.conv(F.substring(F.md5(F.concat("hash", F.lit(f"/{seed}"))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    weight = F.log2(F.col("edges") + 1.0)
    key = F.when(weight > 0, F.log(u) / weight).otherwise(F.lit(float("-inf")))
    return entries.withColumns({"weight": weight, "key": key}).orderBy(F.desc("key"), "hash").limit(k)


_HITS_SQL = f"""{EXECUTIONS_SQL}, hits AS (SELECT exec_id, edge, CAST(least(count(*), 255) AS INTEGER) AS hits FROM (SELECT exec_id, xor(from_block >> 1, to_block) % 65536 AS edge FROM executions) GROUP BY 1, 2)"""


@R.query("edge_hits", f"WITH {_HITS_SQL} SELECT exec_id, edge, hits FROM hits")
def edge_hits_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edge_hits(executions(spark, sf_dir))


@R.query("coverage_merge", f"WITH {_HITS_SQL} SELECT edge, max(hits) AS hits FROM hits GROUP BY 1")
def coverage_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(edge_hits(executions(spark, sf_dir)))


@R.query("coverage_stats", f"WITH {_HITS_SQL}, m AS (SELECT edge, max(hits) AS hits FROM hits GROUP BY 1) SELECT count(*) AS edges, CAST(sum(hits) AS BIGINT) AS hits, round(count(*) / 65536 * 100, 6) AS percent FROM m")
def coverage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_stats(merged(edge_hits(executions(spark, sf_dir)))).withColumn("percent", F.round("percent", 6))


_NEW_SQL = f"""{_HITS_SQL}, f AS (SELECT edge, min(exec_id) AS exec_id FROM hits GROUP BY 1), n AS (SELECT e.exec_id, count(f.edge) AS new_edges FROM (SELECT DISTINCT exec_id FROM hits) e LEFT JOIN f USING (exec_id) GROUP BY 1)"""


@R.query("first_seen_edges", f"WITH {_NEW_SQL} SELECT exec_id, new_edges, new_edges > 0 AS interesting FROM n")
def first_seen_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return novelty(edge_hits(executions(spark, sf_dir))).withColumn("interesting", F.col("new_edges") > 0)


@R.query("coverage_curve", f"WITH {_NEW_SQL} SELECT exec_id, new_edges, CAST(sum(new_edges) OVER (ORDER BY exec_id) AS BIGINT) AS covered FROM n ORDER BY exec_id DESC LIMIT 1000")
def coverage_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history(edge_hits(executions(spark, sf_dir)))


@R.query("hit_buckets", f"""WITH {EXECUTIONS_SQL}, c AS (SELECT least(row_number() OVER (PARTITION BY xor(from_block >> 1, to_block) % 65536 ORDER BY exec_id, seq), 255) AS n FROM executions)
SELECT CAST(CASE WHEN n <= 3 THEN n WHEN n <= 7 THEN 4 WHEN n <= 15 THEN 5 WHEN n <= 31 THEN 6 WHEN n <= 127 THEN 7 ELSE 8 END AS INTEGER) AS bucket, count(*) AS steps, count(*) FILTER (n = 1) AS new_edges, count(*) FILTER (n IN (1, 2, 3, 4, 8, 16, 32, 128)) AS crossings FROM c GROUP BY 1""")
def hit_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = hit_steps(executions(spark, sf_dir))
    return steps.groupBy("bucket").agg(F.count("*").alias("steps"), F.count_if("is_new").alias("new_edges"), F.count_if("crossed").alias("crossings"))


@R.query("edge_chain", f"WITH {EXECUTIONS_SQL} SELECT exec_id, seq, to_block, xor(lag(to_block, 1, 0) OVER (PARTITION BY exec_id ORDER BY seq, to_block) >> 1, to_block) AS edge FROM (SELECT exec_id, to_block, row_number() OVER (PARTITION BY exec_id ORDER BY seq, to_block, from_block) AS seq FROM executions)")
def edge_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("exec_id").orderBy("seq", "to_block", "from_block")
    blocks = executions(spark, sf_dir).withColumn("n", F.row_number().over(order)).select("exec_id", F.col("n").cast("bigint").alias("seq"), "to_block")
    return chained_edges(blocks)


@R.query("coverage_map_hash", f"""WITH {_HITS_SQL}, m AS (SELECT edge, max(hits) AS hits FROM hits GROUP BY 1), s AS (SELECT i, coalesce(hits, 0) AS h FROM range(65536) r(i) LEFT JOIN m ON m.edge = i)
SELECT sha256(unhex(string_agg(printf('%02x', h), '' ORDER BY i))) AS hash FROM s""")
def coverage_map_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_hash(merged(edge_hits(executions(spark, sf_dir))))


@R.query("block_ids", """SELECT doc_id, CAST(('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2)) AS BIGINT) AS block FROM (SELECT doc_id, sha256(encode(source) || unhex(substr(p, 7, 2) || substr(p, 5, 2) || substr(p, 3, 2) || substr(p, 1, 2))) AS h FROM (SELECT doc_id, source, printf('%08X', n_chars) AS p FROM documents))""")
def block_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", block_id(F.col("source"), F.col("n_chars")).alias("block"))


@R.query("corpus_distinct", f"WITH {CORPUS_SQL} SELECT hash, min(doc_id) AS doc_id FROM corpus GROUP BY 1")
def corpus_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_first(corpus(spark, sf_dir), "hash", "doc_id").select("hash", "doc_id")


_DISTINCT_SQL = f"{CORPUS_SQL}, d AS (SELECT * FROM corpus QUALIFY row_number() OVER (PARTITION BY hash ORDER BY doc_id) = 1)"


@R.query("corpus_minimise", f"WITH {_DISTINCT_SQL}, b AS (SELECT hash AS best FROM d ORDER BY edges DESC, hash LIMIT 1) SELECT doc_id, edges, hash = best AS favored FROM d, b WHERE edges > 0 OR is_seed OR hash = best")
def corpus_minimise_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_minimise(keep_first(corpus(spark, sf_dir), "hash", "doc_id")).select("doc_id", "edges", "favored")


@R.query("corpus_stats", f"WITH {_DISTINCT_SQL} SELECT count(*) AS entries, CAST(sum(size) AS BIGINT) AS total, CAST(sum(size) // count(*) AS BIGINT) AS mean, max(size) AS largest, min(size) AS smallest, count(*) FILTER (favored) AS favored, count(*) FILTER (is_seed) AS seeds FROM d")
def corpus_stats_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_stats(keep_first(corpus(spark, sf_dir), "hash", "doc_id"))


@R.query("scheduler_weights", f"WITH {_DISTINCT_SQL} SELECT doc_id, round(log2(edges + 1.0), 6) AS weight FROM d")
def scheduler_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = keep_first(corpus(spark, sf_dir), "hash", "doc_id")
    return d.select("doc_id", F.round(F.log2(F.col("edges") + 1.0), 6).alias("weight"))


@R.query("scheduled_inputs", f"""WITH {CORPUS_SQL}, d AS (SELECT hash, min(doc_id) AS doc_id, any_value(edges) AS edges FROM corpus WHERE hash IS NOT NULL GROUP BY 1),
k AS (SELECT *, CASE WHEN edges > 0 THEN ln((CAST('0x' || left(md5(hash || '/0'), 12) AS BIGINT) + 0.5::DOUBLE) / {1 << 48}) / log2(edges + 1.0::DOUBLE) ELSE '-inf'::DOUBLE END AS key FROM d) SELECT doc_id, edges, round(key, 6) AS key FROM k ORDER BY k.key DESC, hash LIMIT 50""")
def scheduled_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(keep_first(corpus(spark, sf_dir), "hash", "doc_id"), 50).select("doc_id", "edges", F.round("key", 6).alias("key"))


@R.query("feedback_stats", f"WITH {_NEW_SQL}, c AS (SELECT count(DISTINCT edge) AS covered FROM hits) SELECT count(*) AS executions, count(*) FILTER (new_edges > 0) AS interesting, round(any_value(covered) / 65536 * 100, 6) AS coverage_percent, max(CASE WHEN new_edges > 0 THEN exec_id END) AS last_interesting FROM n, c")
def feedback_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = novelty(edge_hits(executions(spark, sf_dir)))
    return n.agg(
        F.count("*").alias("executions"),
        F.count_if(F.col("new_edges") > 0).alias("interesting"),
        F.round(F.sum("new_edges") / MAP_SIZE * 100, 6).alias("coverage_percent"),
        F.max(F.when(F.col("new_edges") > 0, F.col("exec_id"))).alias("last_interesting"),
    )


def seed_union(corpus_rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """Seeds join the corpus, marked as such, unless their hash is already there."""
    both = corpus_rows.withColumn("__from", F.lit(0)).unionByName(seeds.withColumn("is_seed", F.lit(True)).withColumn("__from", F.lit(1)))
    rest = [c for c in corpus_rows.columns if c != "hash"]
    return both.groupBy("hash").agg(F.min(F.struct("__from", *rest)).alias("r")).select("hash", *[F.col(f"r.{c}").alias(c) for c in rest])


@R.query("seed_union", """WITH u AS (SELECT sha256(text) AS hash, false AS is_seed, 0 AS f FROM documents UNION ALL SELECT sha256(text), true, 1 FROM benchmark) SELECT is_seed, count(*) AS n FROM (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY hash ORDER BY f) = 1) GROUP BY 1""")
def seed_union_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = docs(spark, sf_dir).select(F.sha2("text", 256).alias("hash"), F.lit(False).alias("is_seed"))
    seeds = table(spark, sf_dir, "benchmark").select(F.sha2("text", 256).alias("hash"), F.lit(True).alias("is_seed"))
    return seed_union(own, seeds).groupBy("is_seed").agg(F.count("*").alias("n"))
