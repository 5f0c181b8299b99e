"""Minimax contiguous partition into shards.

Groups of rows that must stay together (equal texts) are put in the order of their digest, and the order
is cut into contiguous shards so that the largest shard is as small as it can be. Binary search finds the
smallest capacity for which filling shards greedily needs no more than the wanted number.

The search never sees all groups. Digest prefixes divide the order into 65,536 blocks (2**20 from MANY_ROWS rows on),
whose sums are what the driver holds, beside the groups of single blocks up to MOST_LOADED. Cutting blocks wherever bytes suffice bounds the capacity from
below, cutting at block borders from above; only the few blocks in which a cut for a capacity between the
two bounds can lie are then read group by group. Where the cuts go, each row compares its own digest
with at most shards - 1 literals: no join, no shuffle.

Among the cuts that keep the smallest capacity, those nearest to equal shares of what is left are taken.
Slots number a shard's rows without gaps: rows are counted by (shard, block, salt), the counts are summed
up, and each row adds its place inside its own small group. Large blocks are salted by row id, so that a
group of copies with a third of all rows is numbered in many tasks.

Everything is DataFrame operations.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import digest, settled

#: Rows from which on blocks have five hex digits of the digest instead of four, and groups held at once.
MANY_ROWS, MOST_LOADED = 1 << 32, 1 << 20


class Order:
    """Block sums on the driver; the groups of single blocks, as (digest, size), fetched where they are needed."""

    def __init__(self, blocks: list[tuple[int, int, int, int]], fetch: Callable[[list[int]], Iterator[tuple[int, str, int]]]):
        """blocks: (block, size, largest group, groups), ordered by block; fetch yields (block, digest, size) in order."""
        self.blocks, self._fetch, self._groups = blocks, fetch, {}
        self.starts = [0]
        for _, size, _, _ in blocks:
            self.starts.append(self.starts[-1] + size)
        self.total = self.starts[-1]
        self.largest = max((x for _, _, x, _ in blocks), default=0)

    def load(self, places: list[int]) -> None:
        missing = [self.blocks[p][0] for p in places if p not in self._groups]
        if missing:
            if sum(self.blocks[p][3] for p in self._groups) > MOST_LOADED:
                self._groups.clear()
            where = {self.blocks[p][0]: p for p in places}
            for place in (where[b] for b in missing):
                self._groups[place] = ([], [self.starts[place]])
            for block, name, size in self._fetch(missing):
                names, ends = self._groups[where[block]]
                names.append(name)
                ends.append(ends[-1] + size)

    def cut(self, most: int) -> tuple[int, str | None]:
        """The last border at or before `most` units: units before it, and the digest of the group after it (None at the end)."""
        if most >= self.total:
            return self.total, None
        place = bisect_right(self.starts, most) - 1
        self.load([place])
        names, ends = self._groups[place]
        k = bisect_right(ends, most) - 1
        return ends[k], names[k]

    def cut_after(self, least: int) -> tuple[int, str | None]:
        """The first border at or after `least` units."""
        units, name = self.cut(least)
        if units >= least:
            return units, name
        place = bisect_right(self.starts, units) - 1
        self.load([place])
        names, ends = self._groups[place]
        k = bisect_right(ends, units)
        return self.cut(ends[k])

    def fill(self, capacity: int, shards: int) -> list[int] | None:
        """Ends of greedily filled shards, or None if more would be needed."""
        ends, at = [], 0
        for _ in range(shards):
            at = self.cut(at + capacity)[0]
            ends.append(at)
            if at >= self.total:
                return ends + [self.total] * (shards - len(ends))
        return None

    def _fill_blocks(self, capacity: int, shards: int) -> bool:
        at = 0
        for _ in range(shards):
            at = self.starts[bisect_right(self.starts, at + capacity) - 1]
            if at >= self.total:
                return True
        return False

    def capacity(self, shards: int) -> int:
        """The smallest feasible capacity."""
        low = max(self.largest, -(-self.total // shards))
        high = low
        while not self._fill_blocks(high, shards):
            high *= 2
        step = low
        while step < high:  # the least capacity for cuts at block borders
            middle = (step + high) // 2
            step, high = (step, middle) if self._fill_blocks(middle, shards) else (middle + 1, high)
        near: set[int] = set()
        for k in range(1, shards):
            # greedy loses less than a group at each cut, and no cut lies beyond k * high
            first, last = max(0, k * (low - self.largest)), min(self.total - 1, k * high)
            a, b = bisect_right(self.starts, first) - 1, bisect_right(self.starts, last) - 1
            near.update(range(a, b + 1))
        if self.total and sum(self.blocks[p][3] for p in near) <= MOST_LOADED:
            self.load(sorted(near))  # in one go; else block by block, as the search comes to them
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if self.fill(middle, shards) else (middle + 1, high)
        return low

    def cuts(self, shards: int) -> list[str | None]:
        """The digests at which shards 1, 2, ... start; None: at the end. The largest shard has the smallest feasible capacity."""
        if not self.total:
            return [None] * (shards - 1)
        most = self.capacity(shards)
        least, at = [], self.total  # from the end: where each cut must lie at the earliest
        for _ in range(shards - 1):
            at = self.cut_after(max(0, at - most))[0]
            least.append(at)
        found, at = [], 0
        for k, earliest in enumerate(reversed(least)):
            wanted = at + (self.total - at) / (shards - k)
            below, above = self.cut(int(wanted)), self.cut_after(int(wanted))
            nearest = min(below, above, key=lambda c: abs(c[0] - wanted))
            units = min(max(nearest[0], earliest, at), self.cut(at + most)[0])
            at, name = self.cut(units)
            found.append(name)
        return found


def _shard(key: Column, cuts: list[str | None]) -> Column:
    return sum((F.when(key >= F.lit(c), 1).otherwise(0) for c in cuts if c is not None), F.lit(0)).cast("int")


def _block(key: Column, digits: int) -> Column:
    """The digest's first hex digits; the null text has the block before all others."""
    return F.when(key == "-", F.lit(-1)).otherwise(F.conv(F.substring(key, 1, digits), 16, 10).cast("int"))


def minimax_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, size, text_crc32, law, shard, slot, grown_shard, and digest.

    size is the text's UTF-8 bytes plus 1 (null: 1), the checksum that of the text (null: of no bytes). Equal
    texts share a shard; null texts are one group. Repeated rows and ids keep a slot each; other columns are
    ignored; an empty table gives no rows; shards that no group reaches stay empty. law is `bytes`, so
    grown_shard is null.
    """
    data = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(data) + 1).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        digest(F.col(text_col)).alias("digest"),
    )
    rows = settled(rows)
    digits = 4 if rows.count() < MANY_ROWS else 5
    groups = rows.groupBy("digest").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).withColumn("block", _block(F.col("digest"), digits))
    groups = settled(groups)
    blocks = settled(groups.groupBy("block").agg(F.sum("size").alias("size"), F.max("size").alias("largest"), F.sum("rows").alias("rows"), F.count("*").alias("groups")))

    def fetch(wanted: list[int]) -> Iterator[tuple[int, str, int]]:
        return ((r.block, r.digest, r.size) for r in groups.where(F.col("block").isin(wanted)).select("block", "digest", "size").orderBy("digest").toLocalIterator())

    summed = sorted((r.block, r["size"], r.largest, r.groups, r["rows"]) for r in blocks.collect())
    cuts = Order([x[:4] for x in summed], fetch).cuts(shards)

    # A group for slots has about this many rows; there are at most twice as many groups as blocks.
    target = max(1, sum(r for *_, r in summed) >> 4 * digits, 256)
    salts = blocks.select("block", F.ceil(F.col("rows") / F.lit(target)).cast("int").alias("salts")).where("salts > 1")
    placed = rows.withColumn("shard", _shard(F.col("digest"), cuts)).withColumn("block", _block(F.col("digest"), digits))
    placed = placed.join(F.broadcast(salts), "block", "left")
    placed = placed.withColumn("salt", F.pmod(F.xxhash64("id", F.lit("slot")), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    keys = ["shard", "block", "salt"]
    counts = placed.groupBy(*keys).agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block", "salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(*keys).orderBy("digest", "id")
    numbered = placed.withColumn("place", F.row_number().over(inside)).join(F.broadcast(offsets), keys)
    return numbered.select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("offset") + F.col("place") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "digest",
    )
