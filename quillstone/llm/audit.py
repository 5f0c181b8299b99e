"""Filter interaction audit: what each filter removes, in every order of the filters.

A document's result is a mask with one bit for each filter that it fails. All figures of all orders follow from how many
documents of a part have each mask, so one pass over the texts is enough: the counts of the 2**filters masks are what
combineByKey merges, and a part's report is arithmetic on them.

One filter is no function of the text alone: whether a smaller id has the same text. Texts are routed by their xxhash64
fingerprint. A task first folds the copies among its own rows, holding texts up to HELD_BYTES, and sends one row for each
different text: a group of copies with a third of all rows leaves each task once. The rows arrive sorted by fingerprint
and id, so that only one fingerprint's chain is held: the full texts that share it, each with the smallest id seen, which
is the first. A row whose id is not the minimum fails the filter. Sorting spills; nothing depends on the size of a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby, permutations
from math import factorial

import numpy as np
import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Bytes of text that one task holds while it folds copies, before it sends what it has, and those that one task sorts.
HELD_BYTES, SORTED_BYTES = 64 << 20, 128 << 20

_UPPER, _MARKS = bytes(range(65, 91)), b"#$%&*|"


def too_short(words: list[bytes], data: bytes, chars: int) -> bool:
    return len(words) < 200


def too_uniform(words: list[bytes], data: bytes, chars: int) -> bool:
    return 100 * len(set(words)) < 50 * len(words)


def too_loud(words: list[bytes], data: bytes, chars: int) -> bool:
    return 100 * (len(data) - len(data.translate(None, _UPPER))) > 3 * chars


def has_marks(words: list[bytes], data: bytes, chars: int) -> bool:
    return len(data.translate(None, _MARKS)) < len(data)


#: A filter sees the words of a text, its UTF-8 bytes and its number of code points, and says whether the text fails.
Filter = Callable[[list[bytes], bytes, int], bool]
FILTERS: dict[str, Filter] = {"A": too_short, "B": too_uniform, "C": too_loud, "D": has_marks}
COPY = "E"


@dataclass
class Held:
    """One text of a chain: its mask without the copy filter, the smallest id, and how often each part has it with that id."""

    data: bytes
    mask: int
    least: int
    parts: dict[str, int]


def masked(text: str, filters: list[Filter]) -> int:
    data = text.encode()
    words = data.split()  # at ASCII white space
    return sum(1 << k for k, fails in enumerate(filters) if fails(words, data, len(text)))


def folded(rows: Iterator[tuple], filters: list[Filter], copy: int) -> Iterator[tuple]:
    """The copies among one task's rows: ("done", id, part, mask, n) for what is decided, ("text", fingerprint, ...) for minima.

    Of two ids with the same text the larger fails here and now; the smaller one, with the rows that share it, goes on.
    """
    chains: dict[int, list[Held]] = {}
    size = 0

    def sent() -> Iterator[tuple]:
        for key, chain in chains.items():
            for h in chain:
                yield "text", (key, h.least), (h.data, h.mask, h.parts)

    for doc, text, part in rows:
        text, part = text or "", part or ""
        data = text.encode()
        key = xxhash.xxh64_intdigest(data)
        held = next((h for h in chains.get(key, ()) if h.data == data), None) if doc is not None else None
        if held is None:
            mask = masked(text, filters)
            if doc is None:  # no id is smaller than none, and none is smaller than an id
                yield "done", None, part, mask, 1
                continue
            chains.setdefault(key, []).append(Held(data, mask, doc, {part: 1}))
            size += len(data) + 256
            if size > HELD_BYTES:
                yield from sent()
                chains, size = {}, 0
        elif doc == held.least:
            held.parts[part] = held.parts.get(part, 0) + 1
        elif doc > held.least:
            yield "done", doc, part, held.mask | copy, 1
        else:
            for p, n in held.parts.items():
                yield "done", held.least, p, held.mask | copy, n
            held.least, held.parts = doc, {part: 1}
    yield from sent()


def chained(rows: Iterator[tuple], copy: int) -> Iterator[tuple]:
    """(id, part, mask, n) of rows sorted by (fingerprint, id): the first id of each full text in a chain is its minimum."""
    for _, same in groupby(rows, key=lambda row: row[0][0]):
        chain: dict[bytes, int] = {}
        for (_, doc), (data, mask, parts) in same:
            fails = doc > chain.setdefault(data, doc)
            for part, n in parts.items():
                yield doc, part, mask | copy if fails else mask, n


def masks(docs: DataFrame, filters: dict[str, Filter] | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> RDD:
    """(id, part, mask, n): the mask of every row, bit k for the k-th filter, and the last bit for copies of a smaller id's text."""
    own = list((FILTERS if filters is None else filters).values())
    copy = 1 << len(own)
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col), F.col(part_col).cast("string")).rdd
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(rows.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SORTED_BYTES))
    # one shuffle carries both: what is decided goes along under a key of its own, spread by id
    routed = rows.mapPartitions(lambda own_rows: (((-1, row[1] or 0), row[1:]) if row[0] == "done" else row[1:] for row in folded(own_rows, own, copy)))
    dealt = routed.repartitionAndSortWithinPartitions(parts, lambda key: key[1] if key[0] < 0 else key[0])

    def read(arrived: Iterator[tuple]) -> Iterator[tuple]:
        for decided, same in groupby(arrived, key=lambda row: row[0][0] < 0):
            yield from (value for _, value in same) if decided else chained(same, copy)

    return dealt.mapPartitions(read)


def mask_counts(docs: DataFrame, labels: DataFrame, filters: dict[str, Filter] | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> RDD:
    """(part, counts): for each part an array of 3 x 2**filters counts by mask: all rows, those labelled good, those labelled toxic."""
    n = 1 << (len(FILTERS if filters is None else filters) + 1)
    spark = docs.sparkSession
    found = spark.createDataFrame(masks(docs, filters, id_col, text_col, part_col), "id long, part string, mask int, n long", verifySchema=False)
    # rows of one id and mask are summed first, so that a null or repeated id is no hot key of the join
    found = found.groupBy("id", "part", "mask").agg(F.sum("n").alias("n"))
    marks = labels.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = found.join(marks, "id", "left").select("part", "mask", "n", F.coalesce("good", F.lit(False)), F.coalesce("toxic", F.lit(False))).rdd

    def add(vector: np.ndarray, row: tuple) -> np.ndarray:
        mask, times, good, toxic = row
        vector[0, mask] += times
        vector[1, mask] += times * good
        vector[2, mask] += times * toxic
        return vector

    pairs = rows.map(lambda r: (r[0], tuple(r[1:])))
    return pairs.combineByKey(lambda row: add(np.zeros((3, n), np.int64), row), add, lambda a, b: a + b)


def report(part: str, counts: np.ndarray, letters: str) -> Iterator[tuple]:
    """The rows of one part: every order of the filters, step by step."""
    total, good, toxic = counts
    every = np.arange(counts.shape[1])
    orders = factorial(len(letters))
    size = np.array([bin(m).count("1") for m in every])
    # among the orders, a filter comes first of a mask's k filters in one of k
    shapley = {x: int(sum(total[m] * (orders // size[m]) for m in every if m >> k & 1)) for k, x in enumerate(letters)}
    unique = {x: int(total[1 << k]) for k, x in enumerate(letters)}
    for order in permutations(letters):
        gone = 0
        for step, x in enumerate(order, 1):
            bit = 1 << letters.index(x)
            fails, earlier = (every & bit) > 0, (every & gone) > 0
            removed = fails & ~earlier
            gone |= bit
            yield (
                part, "".join(order), step, int(total[(every & gone) == 0].sum()), int(total[removed].sum()), int(total[fails & earlier].sum()),
                unique[x], int(good[removed].sum()), int(toxic[removed].sum()), shapley[x],
            )


REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def filter_audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Filter] | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row for each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    `filters` maps letters to functions (by default FILTERS); COPY, failed by what repeats the text of a smaller id, comes
    last. Parts are the values of part_col; null is the empty string. A null text is an empty one. A null id is nobody's
    copy and nobody's original; rows of one id and text are not copies of each other. Repeated rows count each, repeated labels
    once, a mark set if any of them sets it. Texts are whole. Other columns are left out; an empty table gives no rows.
    """
    letters = "".join(FILTERS if filters is None else filters) + COPY
    rows = mask_counts(docs, labels, filters, id_col, text_col, part_col).flatMap(lambda kv: report(*kv, letters))
    return docs.sparkSession.createDataFrame(rows, REPORT, verifySchema=False)


