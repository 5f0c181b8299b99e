"""The engine's tables over the provided ones, in Spark and, for oracles, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded responses from events: body from props, time from value, errors as status 500."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"),
        "ts",
        F.col("user_id").alias("target"),
        "event_type",
        F.round(F.col("value") * 1e6).cast("bigint").alias("response_time_ns"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"),
        F.col("props").alias("body"),
        F.octet_length("props").cast("bigint").alias("content_length"),
    )


RESPONSES_SQL = """responses AS (
  SELECT event_id AS seq, ts, user_id AS target, event_type, CAST(round(value * 1e6) AS BIGINT) AS response_time_ns,
         CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code, props AS body,
         CAST(octet_length(encode(props)) AS BIGINT) AS content_length
  FROM events)"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity states in order of time: entity id, status, name."""
    e = table(spark, sf_dir, "events")
    return e.select("ts", F.col("event_id").alias("seq"), F.col("user_id").alias("id"), F.col("event_type").alias("status"), F.concat(F.lit("c"), F.col("user_id")).alias("name"))


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage edges of executions: order as execution, part as source block, supplier as target block."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("exec_id"),
        F.col("l_linenumber").cast("bigint").alias("seq"),
        F.col("l_partkey").alias("from_block"),
        F.col("l_suppkey").alias("to_block"),
    )


EXECUTIONS_SQL = """executions AS (
  SELECT l_orderkey AS exec_id, CAST(l_linenumber AS BIGINT) AS seq, l_partkey AS from_block, l_suppkey AS to_block FROM lineitem)"""
