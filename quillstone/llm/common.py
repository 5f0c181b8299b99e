"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of the contracts: runs without ASCII white space, which is also what bytes.split() yields.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share; one is made only in local mode, where they are one process.

    On a cluster spark.checkpoint.dir must be set: a folder of the driver's would be another one on each host.
    """
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quillstone-checkpoint-"))
    return jsc.getCheckpointDir().get()


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that df does not have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor costs no recomputation of what came before."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def digest(text: Column) -> Column:
    """Equal texts, and only those, share these 64 hex digits; null has a value of its own."""
    return F.coalesce(F.sha2(text, 256), F.lit("-"))
