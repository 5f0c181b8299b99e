"""The folder that driver and executors share, for results that iterations keep."""

from __future__ import annotations

import re
import tempfile

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; one is made only in local mode, where driver and executors are one process."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quillstone-"))
    return sc._jsc.sc().getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """df, computed once into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Values of a caller's list that are gathered at most.
MOST_LISTED = 100_000


def gathered(rows: DataFrame, column: str, most: int = MOST_LISTED) -> Column:
    """All values of a caller's list as one sorted array, a scalar subquery; the query fails where there are more than `most`.

    No more than one value beyond the bound is ever brought together.
    """
    listed = rows.select(F.col(column).alias("x")).limit(most + 1)
    whole = F.sort_array(F.collect_list("x"))
    return listed.agg(F.when(F.count(F.lit(1)) > most, F.raise_error(F.lit(f"the list {column!r} has more than {most} values")).cast("array<string>")).otherwise(whole.cast("array<string>"))).scalar()


#: Bytes of a table that is dealt to all cores before costly work on its rows.
SMALL = 16 << 20


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores if they come from so small a table (SMALL) that it is one split, whose rows one task would work through.

    Files of any size beyond are read by as many tasks as they have splits, and stay where they are.
    """
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism) if size <= SMALL else rows


def dealt(rows: DataFrame, part: int, key: Column | None = None) -> DataFrame:
    """rows of a table in tasks of about `part` bytes of it, over all cores at least: for costly work on short rows, of which one split
    of a file, or one row group, holds many."""
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-size // part))
    return rows.repartition(parts) if key is None else rows.repartition(parts, key)


#: Rows that one task may sort, and ranges at most.
TOGETHER, MOST_RANGES = 1 << 17, 4_096


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """df, settled, and its number of rows, which is observed on the way."""
    seen = Observation()
    kept = settled(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return kept, seen.get["n"]


def running_total(rows: DataFrame, order: str | list[str], value: str, together: int = TOGETHER) -> DataFrame:
    """rows with `total`, the running sum of value (null counts 0) in order, rows with equal order in any order.

    Each task adds up its sorted rows batch by batch. More than `together` rows are dealt by ranges, which are kept with each row's
    place before anything is counted, so that sums and rows belong to the same ranges and no single task sorts all
    rows. The ranges' sums, at most MOST_RANGES numbers, are added up on the driver.
    """
    order = [order] if isinstance(order, str) else order
    rows, n = counted(rows)
    if n <= together:
        return _summed(rows.coalesce(1).sortWithinPartitions(*order), value)
    parts = min(MOST_RANGES, max(2, rows.sparkSession.sparkContext.defaultParallelism, -(-n // together)))
    placed = settled(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id()))
    part = F.shiftright("__place", 33).cast("int")
    offset = _before({r.part: r.s or 0 for r in placed.groupBy(part.alias("part")).agg(F.sum(value).alias("s")).collect()})
    return _summed(placed, value).withColumn("total", F.col("total") + F.get(F.array(*map(F.lit, offset)), part)).drop("__place")


def _before(sizes: dict[int, float]) -> list[float]:
    """For each range the sum of those before it."""
    before, total = [], 0
    for k in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(k, 0)
    return before


def _summed(sorted_rows: DataFrame, value: str) -> DataFrame:
    """The running sum inside each partition, as it stands."""
    kind = "double" if sorted_rows.schema[value].dataType.typeName() in ("double", "float") else "long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = 0
        for batch in batches:
            own = pc.fill_null(batch.column(value).cast(pa.float64() if kind == "double" else pa.int64()), 0).to_numpy(zero_copy_only=False)
            total = own.cumsum() + carried
            carried = total[-1] if len(total) else carried
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(total)], names=[*batch.schema.names, "total"])

    return sorted_rows.mapInArrow(run, T.StructType([*sorted_rows.schema.fields, T.StructField("total", T.DoubleType() if kind == "double" else T.LongType())]))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows, settled, with `number` from 1 in order, whatever how many: dealt by ranges, each row placed in its range behind those before."""
    parts = min(MOST_RANGES, max(2, rows.sparkSession.sparkContext.defaultParallelism))
    placed = settled(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id()))
    part = F.shiftright("__place", 33).cast("int")
    sizes = {r.part: r.n for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    offset = F.get(F.array(*[F.lit(x).cast("long") for x in _before(sizes)]), part)
    return placed.withColumn("number", offset + F.col("__place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__place")


def up_to_border(rows: DataFrame, columns: list[str], value: str, limit: int, digit: int = 12) -> DataFrame:
    """The rows, in order of columns (longs without nulls), up to where the running sum of value (not negative) exceeds limit.

    Nothing is sorted. Each round sums value by the next digit of the rows at the border so far, at most 2**digit sums, and
    goes on inside the digit where the limit is met. All rows whose key is the border's are kept.
    """
    prefix, kept, left = F.lit(True), F.lit(False), limit
    for name in columns:
        lo, hi = rows.where(prefix).agg(F.min(name), F.max(name)).first()
        if lo is None:
            return rows.where(kept)
        first = lo
        while lo < hi:
            shift = max(0, (hi - lo).bit_length() - digit)
            sums = rows.where(prefix & F.col(name).between(lo, hi)).groupBy(F.shiftright(name, shift).alias("d")).agg(F.sum(value).alias("s")).collect()
            for r in sorted(sums, key=lambda r: r.d):
                lo_d, hi_d = max(lo, r.d << shift), min(hi, ((r.d + 1) << shift) - 1)
                if (r.s or 0) > left:
                    break
                left -= r.s or 0
            else:
                return rows.where(kept | (prefix & (F.col(name) <= hi)))
            lo, hi = lo_d, hi_d
        kept = kept | (prefix & F.col(name).between(first, lo) & (F.col(name) < lo))
        prefix = prefix & (F.col(name) == lo)
    return rows.where(kept | prefix)


def chunk_of(x: Column, bounds: list) -> Column:
    """How many of the sorted bounds are at most x, by halving them: a column expression of depth log2."""
    if not bounds:
        return F.lit(0)

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(x < F.lit(bounds[middle]), among(low, middle)).otherwise(among(middle + 1, high))

    return among(0, len(bounds))


def folded(rows: DataFrame, key: str, order: list[str], fold: Callable[[dict, dict], list[dict]], schema: str, finish: Callable[[dict], list[dict]] | None = None) -> DataFrame:
    """A fold of (state, row) over each key's rows in order, and of its last state; the key comes first in the result.

    Partitions sorted by key and order are read batch by batch, with the state of one key at a time: a key of any size
    takes no more memory than a batch and its state. Its rows stay in one task, since each depends on the one before.
    """
    names = [key, *[c.split()[0] for c in schema.split(", ")]]
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                if state is None or not (row[key] == current or (pd.isna(row[key]) and pd.isna(current))):
                    if state is not None and finish:
                        out += [{key: current} | made for made in finish(state)]
                    current, state = row[key], {}
                out += [{key: current} | made for made in fold(state, row)]
            yield pd.DataFrame(out, columns=names)
        if state is not None and finish:
            yield pd.DataFrame([{key: current} | made for made in finish(state)], columns=names)

    dealt = rows.repartition(key).sortWithinPartitions(key, *order)
    return dealt.mapInPandas(run, f"`{key}` {kind}, {schema}")
