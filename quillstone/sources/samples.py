"""Recorded memory samples as a Spark data source: 14 counters and a time a row, in batches and as a stream.

spark.read.format("memory_samples").load(folder) reads Parquet files of samples, a partition a file; spark.readStream reads the files
in order of their names, `files_per_batch` at a time, so that a batch stays bounded however many files wait. The offset
is the number of files read, so a restarted stream goes on behind them; writers name files in order. A sample may lack counters: they
are null. Folders are given as URIs or paths that every executor reaches.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..registry import Registry
from ..shared import shared_folder
from ..views import table

R = Registry()

#: The counters of a sample, in its order; all are unsigned numbers of 64 bits but for the narrow ones.
COUNTERS = ("alloc", "total_alloc", "sys", "num_gc", "pause_total_ns", "heap_alloc", "heap_sys", "heap_idle", "heap_inuse", "heap_released", "heap_objects", "stack_inuse", "stack_sys", "num_goroutine")
NARROW = ("num_gc", "num_goroutine")
KINDS = {c: "long" if c in NARROW else "decimal(20,0)" for c in COUNTERS}
SAMPLE = ", ".join([*[f"{c} {kind}" for c, kind in KINDS.items()], "timestamp timestamp"])
QUICK = ("alloc", "sys", "num_gc", "num_goroutine", "heap_objects")


def _files(folder: str) -> list[str]:
    """The folder's sample files in order of name."""
    fs, path = pyarrow.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pyarrow.fs.LocalFileSystem(), folder)
    found = fs.get_file_info(pyarrow.fs.FileSelector(path, recursive=True))
    return sorted(f.path for f in found if f.is_file and f.path.endswith(".parquet") and not f.base_name.startswith(("_", ".")))


@dataclass
class SampleFile(InputPartition):
    folder: str
    path: str

    def read(self) -> Iterator[pa.RecordBatch]:
        fs = pyarrow.fs.FileSystem.from_uri(self.folder)[0] if "://" in self.folder or self.folder.startswith("file:") else pyarrow.fs.LocalFileSystem()
        kinds = pa.schema([*[(c, pa.int64() if c in NARROW else pa.decimal128(20, 0)) for c in COUNTERS], ("timestamp", pa.timestamp("us", "UTC"))])
        with fs.open_input_file(self.path) as opened:
            for batch in pq.ParquetFile(opened).iter_batches(8_192):
                held = {f.name: batch.column(f.name).cast(f.type) if f.name in batch.schema.names else pa.nulls(batch.num_rows, f.type) for f in kinds}
                yield pa.RecordBatch.from_pydict(held, kinds)


class SampleReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        return [SampleFile(self.folder, f) for f in _files(self.folder)]

    def read(self, partition: SampleFile) -> Iterator[pa.RecordBatch]:
        return partition.read() if isinstance(partition, SampleFile) else iter(())


class SampleStream(DataSourceStreamReader):
    def __init__(self, folder: str, per_batch: int):
        self.folder, self.per_batch, self.seen = folder, per_batch, 0

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        self.seen = min(self.seen + self.per_batch, len(_files(self.folder)))
        return {"files": self.seen}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.seen = max(self.seen, end["files"])
        return [SampleFile(self.folder, f) for f in _files(self.folder)[start["files"] : end["files"]]]

    def read(self, partition: SampleFile) -> Iterator[pa.RecordBatch]:
        return partition.read()


class SampleSource(DataSource):
    """Options: path, and for streams files_per_batch (100)."""

    @classmethod
    def name(cls) -> str:
        return "memory_samples"

    def schema(self) -> str:
        return SAMPLE

    def reader(self, schema) -> DataSourceReader:
        return SampleReader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return SampleStream(self.options["path"], int(self.options.get("files_per_batch", 100)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SampleSource)


def quick_stats(samples: DataFrame) -> DataFrame:
    """The latest sample's few headline counters: one row, null counters without a sample."""
    last = samples.agg(F.max_by(F.struct(*QUICK), "timestamp").alias("s"))
    return last.select("s.*")


# --- Queries ----------------------------------------------------------------------------------------------------

#: What each counter is made of in the recorded samples, in Spark and in DuckDB alike.
_MADE = {c: f"event_id * {k + 1} + user_id" for k, c in enumerate(COUNTERS)} | {"num_gc": "event_id % 50", "num_goroutine": "user_id % 7 + 1"}  # in the order of the counters
_SAMPLES_SQL = "SELECT " + ", ".join(f"CAST({made} AS BIGINT) AS {c}" for c, made in _MADE.items()) + ", ts AS sampled FROM events"


def _recorded(spark: SparkSession, sf_dir: str) -> str:
    """Samples of every event, as files in order of time; their folder."""
    folder = f"{shared_folder(spark)}/samples-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "events").select(*[F.expr(f"cast({made} as {KINDS[c]})").alias(c) for c, made in _MADE.items()], F.col("ts").cast("timestamp").alias("timestamp"))
    rows.repartitionByRange(5, "timestamp").write.parquet(f"{folder}/in")
    return folder


def _plain(samples: DataFrame) -> DataFrame:
    return samples.select(*[F.col(c).cast("long").alias(c) for c in _MADE], F.col("timestamp").cast("timestamp_ntz").alias("sampled"))


@R.query("memory_samples", _SAMPLES_SQL)
def memory_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    return _plain(spark.read.format("memory_samples").load(f"{_recorded(spark, sf_dir)}/in"))


@R.query("memory_sample_stream", _SAMPLES_SQL)
def memory_sample_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files as a stream, two a batch."""
    register(spark)
    folder = _recorded(spark, sf_dir)
    stream = spark.readStream.format("memory_samples").option("files_per_batch", 2).load(f"{folder}/in")
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").start(f"{folder}/out")
    query.processAllAvailable()
    query.stop()
    return _plain(spark.read.parquet(f"{folder}/out"))


@R.query("memory_quick_stats", f"SELECT {', '.join(QUICK)} FROM ({_SAMPLES_SQL}) ORDER BY sampled DESC LIMIT 1")
def memory_quick_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    samples = spark.read.format("memory_samples").load(f"{_recorded(spark, sf_dir)}/in")
    return quick_stats(samples).select(*[F.col(c).cast("long").alias(c) for c in QUICK])
