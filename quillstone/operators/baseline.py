"""Learning a baseline from the first responses of each target, and scoring the rest against it.

The reference learns one baseline behind one lock. Here a baseline is a row per key (or one row), from the
first rows in arrival order: a group limit on (key, ts, seq) that Spark pushes below the shuffle, then one
aggregation; every later row is scored by expressions after a join with those few rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..registry import Registry
from ..views import RESPONSES_SQL, responses

R = Registry()
#: Samples and multiples of the analyser and of the stand-alone baseline.
MIN_SAMPLES, MAX_SAMPLES, TIME_MULTIPLE, LENGTH_MULTIPLE = 20, 100, 3.0, 3.0


def learning_prefix(rows: DataFrame, keys: list[str], most: int = MAX_SAMPLES) -> DataFrame:
    """The first `most` rows of each key in arrival order, with their place `rn`."""
    order = Window.partitionBy(*keys).orderBy("ts", "seq")
    return rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most)


def first_arrivals(rows: DataFrame, most: int = MAX_SAMPLES) -> DataFrame:
    """The first rows over all keys: a distributed top-k, not a global sort."""
    return rows.orderBy("ts", "seq").limit(most)


def baseline_stats(samples: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Statistics of the samples, one row or one per key.

    The mean time is cut to whole ns, its deviation is about that mean and cut as well; divisors are n.
    """
    keys = keys or []
    words = F.regexp_count("body", F.lit(r"[\p{L}\p{Nd}]+"))
    rows = samples.withColumn("words", words)
    t, n = F.col("response_time_ns"), F.count("*")
    one = rows.groupBy(*keys).agg(
        n.alias("n"),
        F.expr("sum(response_time_ns) div count(*)").alias("avg_time_ns"),
        F.sum(t.cast("decimal(38,0)") * t).alias("__t2"),
        F.sum(t).alias("__t1"),
        F.min(t).alias("min_time_ns"),
        F.max(t).alias("max_time_ns"),
        F.avg("content_length").alias("avg_length"),
        F.stddev_pop("content_length").alias("std_length"),
        F.min("content_length").alias("min_length"),
        F.max("content_length").alias("max_length"),
        F.avg("words").alias("avg_words"),
        F.stddev_pop("words").alias("std_words"),
        F.sort_array(F.collect_set("status_code")).alias("statuses"),
    )
    a = F.col("avg_time_ns").cast("decimal(38,0)")
    squares = F.col("__t2") - 2 * a * F.col("__t1") + a * a * F.col("n")
    return one.withColumn("std_time_ns", F.floor(F.sqrt(squares.cast("double") / F.col("n"))).cast("bigint")).drop("__t1", "__t2")


def scored(rows: DataFrame, baseline: DataFrame, keys: list[str] | None = None, time_multiple: float = TIME_MULTIPLE, length_multiple: float = LENGTH_MULTIPLE) -> DataFrame:
    """rows with skews, z-scores, anomaly types, reason, score and classification.

    Without keys the baseline is one row, which becomes a scalar subquery: no join is planned.
    """
    base = baseline.select(*(keys or []), "avg_time_ns", "std_time_ns", "avg_length", "std_length", "statuses")
    joined = rows.join(base, keys, "inner") if keys else rows.withColumn("__b", base.select(F.struct(*base.columns)).scalar()).select(*rows.columns, "__b.*")
    time, length = F.col("response_time_ns"), F.col("content_length")
    known = F.array_contains("statuses", F.col("status_code"))
    out = joined.withColumns(
        {
            "time_skew": S.skew(time, F.col("avg_time_ns")),
            "length_skew": S.skew(length, F.col("avg_length")),
            "time_z": S.z_score(time, F.col("avg_time_ns"), F.col("std_time_ns")),
            "length_z": S.z_score(length, F.col("avg_length"), F.col("std_length")),
            "status_known": known,
        }
    )
    out = out.withColumn("types", S.anomaly_types(F.col("time_skew"), F.col("length_skew"), F.col("status_known"), time_multiple, length_multiple))
    out = out.withColumn("score", S.composite_score(F.col("time_skew"), F.col("length_skew"), F.col("status_known")))
    return out.withColumn("classification", S.classification(F.col("status_code"), F.col("score"), F.size("types") > 0))


def analyser_stats(analysed: DataFrame, filtered: int | DataFrame = 0) -> DataFrame:
    """Counts of analysed, anomalous and interesting rows and the mean score; filtered rows are counted apart."""
    stats = analysed.agg(
        F.count("*").alias("analyzed"),
        F.count_if(F.col("classification") == "anomaly").alias("anomalies"),
        F.count_if(F.col("classification").isin("anomaly", "interesting")).alias("interesting"),
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_score"),
    )
    return stats.withColumn("filtered", F.lit(filtered)) if isinstance(filtered, int) else stats


_BASE_SQL = f"""WITH {RESPONSES_SQL},
r AS (SELECT *, row_number() OVER (ORDER BY ts, seq) AS rn FROM responses),
b AS (SELECT sum(response_time_ns) // count(*) AS avg_t, avg(content_length) AS avg_l, list(DISTINCT status_code) AS statuses FROM r WHERE rn <= 100),
s AS (SELECT r.*, CASE WHEN avg_t > 0 THEN response_time_ns / avg_t ELSE 0 END AS ts_, CASE WHEN avg_l > 0 THEN content_length / avg_l ELSE 0 END AS ls_,
             list_contains(statuses, status_code) AS known FROM r, b WHERE rn > 100),
a AS (SELECT *, CASE WHEN ts_ > 3.0 THEN 'slow_response' WHEN ts_ > 0 AND ts_ < 1.0/3.0 THEN 'fast_response' END AS a1,
             CASE WHEN ls_ > 3.0 THEN 'long_response' WHEN ls_ > 0 AND ls_ < 1.0/3.0 THEN 'short_response' END AS a2,
             CASE WHEN NOT known THEN 'unexpected_status' END AS a3,
             (CASE WHEN ts_ > 0 THEN least(100.0, greatest(0.0, (ts_ - 1.0) * 50.0)) * 0.2 ELSE 0 END + CASE WHEN ls_ > 0 THEN least(100.0, greatest(0.0, (ls_ - 1.0) * 50.0)) * 0.2 ELSE 0 END + CASE WHEN NOT known THEN 10.0 ELSE 0 END)
             / nullif(CASE WHEN ts_ > 0 THEN 0.2 ELSE 0 END + CASE WHEN ls_ > 0 THEN 0.2 ELSE 0 END + CASE WHEN NOT known THEN 0.1 ELSE 0 END, 0) AS score0 FROM s),
c AS (SELECT *, coalesce(score0, 0) AS score, (a1 IS NOT NULL)::INT + (a2 IS NOT NULL)::INT + (a3 IS NOT NULL)::INT AS n_types,
             CASE WHEN status_code >= 500 THEN 'error' WHEN coalesce(score0, 0) >= 70 THEN 'anomaly' WHEN coalesce(score0, 0) >= 40 THEN 'interesting'
                  WHEN a1 IS NOT NULL OR a2 IS NOT NULL OR a3 IS NOT NULL THEN 'anomaly' ELSE 'normal' END AS classification FROM a)
"""


def _later(rows: DataFrame, samples: DataFrame) -> DataFrame:
    """The rows that arrive after the learning prefix: compared with its last row, which is one value."""
    return rows.where(F.struct("ts", "seq") > samples.agg(F.max(F.struct("ts", "seq"))).scalar())


def analysed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = responses(spark, sf_dir)
    samples = first_arrivals(rows)
    return scored(_later(rows, samples), baseline_stats(samples))


@R.query("baseline_anomaly_classify", _BASE_SQL + "SELECT classification, count(*) AS n, round(avg(score), 6) AS mean_score FROM c GROUP BY 1")
def baseline_anomaly_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysed_events(spark, sf_dir).groupBy("classification").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


@R.query("anomaly_type_counts", _BASE_SQL + """SELECT CASE WHEN n_types > 1 THEN 'multiple_anomalies' WHEN n_types = 1 THEN coalesce(a1, a2, a3) ELSE 'none' END AS anomaly, count(*) AS n FROM c GROUP BY 1""")
def anomaly_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysed_events(spark, sf_dir).groupBy(S.anomaly_label(F.col("types")).alias("anomaly")).agg(F.count("*").alias("n"))


@R.query("analyzer_stats", _BASE_SQL + """SELECT count(*) AS analyzed, count(*) FILTER (classification = 'anomaly') AS anomalies, count(*) FILTER (classification IN ('anomaly', 'interesting')) AS interesting, round(avg(score), 6) AS mean_score FROM c""")
def analyzer_stats_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyser_stats(analysed_events(spark, sf_dir)).select("analyzed", "anomalies", "interesting", F.round("mean_score", 6).alias("mean_score"))


@R.query("anomaly_reasons", _BASE_SQL + """SELECT seq, concat_ws('; ',
  CASE WHEN a1 = 'slow_response' THEN 'response time ' || CASE WHEN ts_ >= 10 THEN '10+' ELSE CAST(CAST(floor(floor(ts_ * 10) / 10) AS BIGINT) AS VARCHAR) || '.' || CAST(CAST(floor(ts_ * 10) AS BIGINT) % 10 AS VARCHAR) END || 'x slower than baseline'
       WHEN a1 = 'fast_response' THEN 'response time ' || CASE WHEN 1 / ts_ >= 10 THEN '10+' ELSE CAST(CAST(floor(floor(1 / ts_ * 10) / 10) AS BIGINT) AS VARCHAR) || '.' || CAST(CAST(floor(1 / ts_ * 10) AS BIGINT) % 10 AS VARCHAR) END || 'x faster than baseline' END,
  CASE WHEN a3 IS NOT NULL THEN 'unexpected status code' END) AS reason FROM c WHERE n_types > 0""")
def anomaly_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analysed_events(spark, sf_dir).where(F.size("types") > 0)
    return rows.select("seq", S.anomaly_reason(F.col("types"), F.col("time_skew"), F.col("length_skew")).alias("reason"))


@R.query("baseline_stats", f"""WITH {RESPONSES_SQL}, s AS (SELECT *, len(regexp_extract_all(body, '[\\p{{L}}\\p{{Nd}}]+')) AS words FROM responses ORDER BY ts, seq LIMIT 100),
m AS (SELECT sum(response_time_ns) // count(*) AS a FROM s)
SELECT count(*) AS n, CAST(max(a) AS BIGINT) AS avg_time_ns, min(response_time_ns) AS min_time_ns, max(response_time_ns) AS max_time_ns, round(avg(content_length), 6) AS avg_length, round(stddev_pop(content_length), 6) AS std_length,
 min(content_length) AS min_length, max(content_length) AS max_length, round(avg(words), 6) AS avg_words, CAST(floor(sqrt(avg(power(response_time_ns - a, 2))) / 1000) AS BIGINT) AS std_time_us FROM s, m""")
def baseline_stats_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = baseline_stats(first_arrivals(responses(spark, sf_dir)))
    return b.select("n", "avg_time_ns", "min_time_ns", "max_time_ns", F.round("avg_length", 6).alias("avg_length"), F.round("std_length", 6).alias("std_length"), "min_length", "max_length", F.round("avg_words", 6).alias("avg_words"), F.expr("std_time_ns div 1000").alias("std_time_us"))


@R.query("baseline_status_histogram", f"""WITH {RESPONSES_SQL}, s AS (SELECT * FROM responses ORDER BY ts, seq LIMIT 100) SELECT status_code, count(*) AS n FROM s GROUP BY 1""")
def baseline_status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_arrivals(responses(spark, sf_dir)).groupBy("status_code").agg(F.count("*").alias("n"))


@R.query("learning_progress", f"""WITH {RESPONSES_SQL}, n AS (SELECT target, least(count(*), 100) AS n FROM responses GROUP BY 1)
SELECT target, n >= 20 AS learned, CASE WHEN n >= 20 THEN 100.0 ELSE CAST(n AS DOUBLE) / 20 * 100 END AS progress FROM n""")
def learning_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = responses(spark, sf_dir).groupBy("target").agg(F.least(F.count("*"), F.lit(MAX_SAMPLES)).alias("n"))
    learned = F.col("n") >= MIN_SAMPLES
    return n.select("target", learned.alias("learned"), F.when(learned, 100.0).otherwise(F.col("n") / MIN_SAMPLES * 100).alias("progress"))


@R.query("per_target_baseline", f"""WITH {RESPONSES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY ts, seq) AS rn FROM responses)
SELECT target, count(*) AS n, CAST(sum(response_time_ns) // count(*) AS BIGINT) AS avg_time_ns, min(response_time_ns) AS min_time_ns, max(response_time_ns) AS max_time_ns, round(avg(content_length), 6) AS avg_length FROM r WHERE rn <= 20 GROUP BY 1""")
def per_target_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = baseline_stats(learning_prefix(responses(spark, sf_dir), ["target"], 20), ["target"])
    return b.select("target", "n", "avg_time_ns", "min_time_ns", "max_time_ns", F.round("avg_length", 6).alias("avg_length"))


@R.query("per_target_scores", f"""WITH {RESPONSES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY ts, seq) AS rn FROM responses),
b AS (SELECT target, sum(response_time_ns) // count(*) AS a FROM r WHERE rn <= 20 GROUP BY 1)
SELECT r.target, count(*) AS n, count(*) FILTER (response_time_ns / a > 3.0) AS slow FROM r JOIN b ON r.target = b.target WHERE rn > 20 GROUP BY 1""")
def per_target_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("target").orderBy("ts", "seq")
    numbered = responses(spark, sf_dir).withColumn("rn", F.row_number().over(order))
    baseline = baseline_stats(numbered.where("rn <= 20"), ["target"])
    analysed = scored(numbered.where("rn > 20"), baseline, ["target"])
    return analysed.groupBy("target").agg(F.count("*").alias("n"), F.count_if(F.array_contains("types", "slow_response")).alias("slow"))


@R.query("baseline_body_pick", f"""WITH {RESPONSES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY ts, seq) AS rn FROM responses)
SELECT target, min_by(seq, rn) AS seq, min_by(body, rn) AS body FROM r WHERE rn >= 20 AND octet_length(encode(body)) > 0 GROUP BY 1""")
def baseline_body_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("target").orderBy("ts", "seq")
    numbered = responses(spark, sf_dir).withColumn("rn", F.row_number().over(order))
    ready = numbered.where((F.col("rn") >= MIN_SAMPLES) & (F.octet_length("body") > 0))
    return ready.groupBy("target").agg(F.min_by("seq", "rn").alias("seq"), F.min_by("body", "rn").alias("body"))


@R.query("z_scores", f"""WITH {RESPONSES_SQL}, s AS (SELECT * FROM responses ORDER BY ts, seq LIMIT 100), b AS (SELECT avg(content_length) AS a, stddev_pop(content_length) AS d FROM s)
SELECT seq, round(CASE WHEN d > 0 THEN (content_length - a) / d ELSE 0 END, 6) AS length_z FROM responses, b""")
def z_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = responses(spark, sf_dir)
    return scored(rows, baseline_stats(first_arrivals(rows))).select("seq", F.round("length_z", 6).alias("length_z"))
