"""Importance resampling of documents towards a target distribution.

Features are runs of words, hashed into a fixed number of buckets. The raw rows and the target texts are counted into
one array each, and a bucket's gain is the floored log ratio of its smoothed shares. A document's weight is the floored
mean gain of its features, looked up in that array; a Gumbel draw from a hash of its id, added to the weight, makes the
highest scores a sample without replacement.

The exact k-th key of (score descending, id ascending) is found by radix selection: each round counts one digit of the
keys that share the prefix so far, on the executors, and the driver, which sees at most 2**DIGIT counts a round, picks the
digit in which the k-th key lies. No sort of all rows is needed: only the rows at or before that key are sorted by
ranges and ranked.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled

#: Bits of a key that one round of the selection counts, words of a text that are held at once, and ranges of the sample at most.
DIGIT, HELD, MOST_PARTS = 12, 1 << 17, 4_096

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # of bytes in lower case: all code points behind ASCII have bytes from 0x80 only


@dataclass(frozen=True)
class Features:
    """How texts become features: runs of 1 to `most_words` words in so many buckets."""

    buckets: int = 10_000
    most_words: int = 1

    def pieces(self, text: str | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, buckets, times) of each HELD words of a text: the buckets of its different features, and how often they occur."""
        words = (m[0] for m in _WORD.finditer((text or "").encode().lower()))  # bytes.lower() changes A to Z only
        before: list[bytes] = []
        while own := list(islice(words, HELD)):
            grams = Counter(own)
            for size in range(2, self.most_words + 1):
                run = before[max(0, len(before) - size + 1) :] + own  # each run of words that ends in this piece
                grams.update(b" ".join(run[k : k + size]) for k in range(len(run) - size + 1))
            before = (before + own)[1 - self.most_words :] if self.most_words > 1 else []
            places = np.fromiter((zlib.crc32(g) % self.buckets for g in grams), np.int64, len(grams))
            yield len(own), places, np.fromiter(grams.values(), np.int64, len(grams))


def bucket_counts(texts: DataFrame, text_col: str, features: Features) -> np.ndarray:
    """How many features of all texts fall into each bucket: one array a task, summed by bucket on the executors."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(features.buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for _, places, times in features.pieces(text.as_py()):
                    np.add.at(total, places, times)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    sums = texts.select(text_col).mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # one row a bucket
    out = np.zeros(features.buckets, np.int64)
    out[sums["bucket"].to_numpy(np.int64)] = sums["n"].to_numpy(np.int64)
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed shares) for each bucket."""
    n, s, t = len(raw), float(raw.sum()), float(target.sum())
    ratio = [(b + 1.0) * (s + n) / ((a + 1.0) * (t + n)) for a, b in zip(raw.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def gumbel(id_col: str, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first 32 bits of the SHA-256 of seed and id; a null id counts as empty."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weighted(docs: DataFrame, gain: np.ndarray, features: Features, id_col: str, text_col: str, seed: int) -> DataFrame:
    """(id, n_words, n_features, weight, score) of every row; the gains, one number a bucket, go along with the task."""
    kind = docs.schema[id_col].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, sizes, weights = [], [], []
            for text in batch.column(1):
                n = size = total = 0
                for own, places, times in features.pieces(text.as_py()):
                    n, size, total = n + own, size + int(times.sum()), total + int(gain[places] @ times)
                words.append(n)
                sizes.append(size)
                weights.append(total // size if size else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in (words, sizes, weights)]], names=[id_col, "n_words", "n_features", "weight"])

    rows = docs.select(id_col, text_col).mapInArrow(scored, f"`{id_col}` {kind}, n_words long, n_features long, weight long")
    return rows.withColumn("score", F.col("weight") + gumbel(id_col, seed))


def kth_key(keys: DataFrame, columns: list[str], k: int) -> tuple | None:
    """The k-th smallest (from 1) of the rows' keys, compared column by column as longs; None where there are fewer.

    Each round counts one digit, the next DIGIT bits, of the values between the bounds known so far, among the rows that
    have the key's earlier columns; a column takes only as many rounds as the range of its values needs.
    """
    if k < 1:
        return None
    out, prefix, left = [], F.lit(True), k
    for name in columns:
        lo, hi, n = keys.where(prefix).agg(F.min(name), F.max(name), F.count("*")).first()
        if n < left:
            return None
        while lo < hi:
            shift = max(0, (hi - lo).bit_length() - DIGIT)
            digit = F.shiftright(name, shift).alias("digit")
            counts = keys.where(prefix & F.col(name).between(lo, hi)).groupBy(digit).agg(F.count("*").alias("n")).collect()  # at most 2**DIGIT + 1
            for r in sorted(counts, key=lambda r: r.digit):
                if left <= r.n:
                    lo, hi = max(lo, r.digit << shift), min(hi, ((r.digit + 1) << shift) - 1)
                    break
                left -= r.n
        out.append(lo)
        prefix = prefix & (F.col(name) == lo)
    return tuple(out)


def up_to(columns: list[str], key: tuple) -> Column:
    """Whether a row's key is at or before `key`."""
    same, before = F.lit(True), F.lit(False)
    for name, value in zip(columns, key):
        before = before | (same & (F.col(name) < value))
        same = same & (F.col(name) == value)
    return before | same


def ranked(rows: DataFrame, columns: list[str], n: int) -> DataFrame:
    """rows with `rank` from 1 in order of columns: dealt by ranges once, numbered inside each, and the ranges' sizes summed.

    What was dealt is kept in the shared folder before it is counted, so that counts and numbers belong to the same ranges.
    """
    parts = max(1, min(MOST_PARTS, max(rows.sparkSession.sparkContext.defaultParallelism, n >> 20)))
    place = F.monotonically_increasing_id()
    dealt = settled(rows.repartitionByRange(parts, *columns).sortWithinPartitions(*columns).withColumn("__place", place))
    part = F.shiftright("__place", 33)
    sizes = {r.part: r.n for r in dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    before = [0]
    for k in range(max(sizes, default=-1) + 1):
        before.append(before[-1] + sizes.get(k, 0))
    offset = F.element_at(F.array(*[F.lit(x).cast("long") for x in before]), part.cast("int") + 1)
    return dealt.withColumn("rank", offset + F.col("__place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__place")


def resampled(
    docs: DataFrame, target: DataFrame, share: tuple[int, int] = (10, 100), features: Features = Features(), least_words: int = 20,
    seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """One row for each row of docs: id, n_features, weight, score, rank; rank is null for what is not drawn.

    floor(N * share) of the N rows with at least least_words words are drawn, by highest score, ties to the smaller id; ids are
    integers, null ids come last among equal scores. Repeated rows are rows of their own: where several have the last drawn
    key, as many of them are drawn as fit. Null texts have no features and weight 0. An empty target leaves the smoothed
    shares of none; an empty docs table gives no rows. Other columns are left out.
    """
    gain = gains(bucket_counts(docs, text_col, features), bucket_counts(target, target_col, features))
    rows = weighted(docs, gain, features, id_col, text_col, seed)
    own = F.col(id_col).cast("long")
    keys = {"__score": -F.col("score"), "__none": F.col(id_col).isNull().cast("long"), "__id": F.coalesce(own, F.lit(0)), "__features": F.col("n_features")}
    rows = settled(rows.withColumns(keys).withColumn("__row", F.monotonically_increasing_id()))
    columns = ["__score", "__none", "__id"]
    eligible = F.col("n_words") >= least_words
    n = rows.where(eligible).count()
    k = n * share[0] // share[1]
    key = kth_key(rows.where(eligible), columns, k)
    out = [id_col, "n_features", "weight", "score", "rank"]
    none = F.lit(None).cast("long")
    if key is None:
        return rows.withColumn("rank", none).select(*out)
    drawn = eligible & up_to(columns, key)
    sample = ranked(rows.where(drawn), [*columns, "__features", "__row"], k)  # the row's number deals out rows that are alike
    sample = sample.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    return rows.where(~drawn).withColumn("rank", none).select(*out).unionByName(sample.select(*out))


def resample(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The drawn rows of docs with all their columns; ids must be unique."""
    id_col = settings.get("id_col", "doc_id")
    drawn = resampled(docs, target, **settings).where("rank is not null").select(id_col)
    return docs.join(drawn, id_col, "left_semi")

