"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints have 64 bits. For radius r, each bit position gets a nonzero vector of r + 1 bits, and each
nonzero vector v of r + 1 bits gives a mask: the positions whose vector has an odd inner product with v.
For any r differing positions some v is orthogonal to all their vectors, so that its mask leaves them
out: every pair within the radius agrees on some masked value, and no pair is missed. Positions take the
vectors in turn, so that each of the 2**(r + 1) - 1 masks keeps about half of the bits. (Pagh, "CoveringLSH", 2016.)

Equal fingerprints are one node. Bucket members are compared inside blocks of bounded size, each pair of
blocks in a group of its own, and only a spanning forest of the links leaves a group; so neither a large
bucket nor a group of copies meets in one task or makes a row for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, settled
from .components import connected_components

BITS = 64
#: Members of one block of a bucket.
BLOCK = 1024


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint of a text as a signed 64-bit number; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], ends[:-1]])
        spans = zip(starts[: len(words) - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist())
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in spans]
    values = np.array(hashes, np.uint64)
    votes = np.zeros(BITS, np.int64)
    for k in range(0, len(values), 1 << 16):
        part = values[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * votes > len(values), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp long) for each row of docs, in one pass without a shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=[id_col, "fp"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(hashed, f"`{id_col}` {kind}, fp long")


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """The masks, as signed numbers. Any radius positions are left out together by at least one of them."""
    vectors = [1 + position % ((1 << radius + 1) - 1) for position in range(bits)]
    masks = [sum(1 << p for p, vector in enumerate(vectors) if (vector & v).bit_count() % 2) for v in range(1, 1 << radius + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _forest(fps: np.ndarray, nodes: np.ndarray, blocks: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among members that come in the order of their nodes.

    Members of two blocks are compared across; one block is compared with itself.
    """
    root = list(range(len(nodes)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    across = blocks.min() != blocks.max()
    edges = []
    for k in range(len(nodes) - 1):
        near = np.bitwise_count(fps[k + 1 :] ^ fps[k]) <= radius
        if across:
            near &= blocks[k + 1 :] != blocks[k]
        for j in (np.flatnonzero(near) + k + 1).tolist():
            if (a := find(k)) != (b := find(j)):
                root[max(a, b)] = min(a, b)
                edges.append((int(nodes[j]), int(nodes[k])))
    return edges


def _linked(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Edges of each run of equal (bucket, low, high); only the last, unfinished run is held between batches."""

    def edges(rows: pd.DataFrame, last: bool) -> tuple[pd.DataFrame, pd.DataFrame]:
        keys = rows[["bucket", "low", "high"]].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
        ends = np.append(starts[1:], len(rows))
        if not last:
            starts, ends = starts[:-1], ends[:-1]
        fps, nodes, blocks = rows["fp"].to_numpy().astype(np.uint64), rows["node"].to_numpy(), rows["block"].to_numpy()
        two = starts[ends - starts == 2]
        two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= radius]
        found = list(zip(nodes[two + 1].tolist(), nodes[two].tolist()))
        for a, b in zip(starts.tolist(), ends.tolist()):
            if b - a > 2:
                found += _forest(fps[a:b], nodes[a:b], blocks[a:b], radius)
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64"), rows.iloc[ends[-1] if len(ends) else 0 :]

    held = None
    for rows in batches:
        rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
        if len(rows):
            made, held = edges(rows, False)
            yield made
    if held is not None and len(held):
        yield edges(held, True)[0]


def near_pairs(nodes: DataFrame, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) that connect whatever links of distance <= radius connect; nodes: (node long, fp long), fp distinct."""
    masks = F.array(*[F.struct(F.lit(k).cast("byte").alias("k"), F.lit(m).alias("m")) for k, m in enumerate(covering_masks(radius))])
    placed = nodes.select("node", "fp", F.explode(masks).alias("t")).select("node", "fp", F.xxhash64(F.col("t.k"), F.col("fp").bitwiseAND(F.col("t.m"))).alias("bucket"))
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = placed.join(sizes, "bucket").withColumn("blocks", F.ceil(F.col("size") / F.lit(block)).cast("int"))
    shared = shared.withColumn("block", F.pmod(F.xxhash64("node", "fp"), F.col("blocks")).cast("int"))
    paired = shared.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.select("bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "fp")

    keys = ["bucket", "low", "high"]
    dealt = paired.repartition(*keys).sortWithinPartitions(*keys, "node")
    return dealt.mapInPandas(lambda batches: _linked(batches, radius), "u long, v long").distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, shingle: int = 3, block: int = BLOCK) -> DataFrame:
    """(id, fingerprint, component_id) for each row of docs: its fingerprint in hex and the least id it is linked to.

    Fingerprints within the radius are linked, equal ones included, and links chain. A null text counts as
    one without words: fingerprint zero. Repeated rows stay. Rows with a null id get a fingerprint and the
    component of that fingerprint; other columns are ignored; an empty table gives no rows.
    """
    hashed = settled(fingerprints(docs, id_col, text_col, shingle).select(F.col(id_col).alias("id"), "fp"))
    nodes = hashed.where("id is not null").groupBy("fp").agg(F.min("id").cast("long").alias("node"))
    nodes = settled(nodes)
    parts = connected_components(near_pairs(nodes, radius, block))
    found = nodes.join(parts, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return hashed.join(found, "fp", "left").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: So many ids are broadcast at most (8 bytes each); more are joined by a shuffle.
MOST_BROADCAST = 1 << 20


def _ids(ids: DataFrame) -> tuple[DataFrame, int]:
    """A settled table of ids with their number; broadcast where that is proven small."""
    n = ids.count()
    return (F.broadcast(ids) if n <= MOST_BROADCAST else ids), n


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, shingle: int = 3) -> DataFrame:
    """docs without near-duplicates: of each component the document with the least id stays, with all its columns.

    Repeated rows (id and text) stay once; an id stays with all its texts if one of them is the least of its component.
    Rows with a null id cannot be told apart by it and stay. Only ids and fingerprints are shuffled, as long as no more
    than MOST_BROADCAST ids go; beyond that, and for repeated ids, texts are, and copies combine before they move.
    """
    of_id, keep, n_at, print_at = (free_name(docs, name) for name in ("of_id", "keep", "n", "print"))
    parts = simhash_components(docs, id_col, text_col, radius, shingle).where(F.col(id_col).isNotNull())
    least = F.bool_or(F.col(id_col) == F.col("component_id")).alias(keep)
    decided = settled(parts.groupBy(F.col(id_col).alias(of_id)).agg(least, F.count("*").alias(n_at)))
    gone, _ = _ids(decided.where(~F.col(keep)).select(of_id))
    repeated, n = _ids(decided.where(F.col(keep) & (F.col(n_at) > 1)).select(of_id))
    same = F.col(id_col) == F.col(of_id)
    kept = docs.join(gone, same, "left_anti")
    if not n:
        return kept
    once = kept.join(repeated, same, "left_semi").withColumn(print_at, F.xxhash64(text_col)).dropDuplicates([id_col, print_at]).drop(print_at)
    return kept.join(repeated, same, "left_anti").unionByName(once)
