"""Approximate nearest neighbours by inner product: probed lists and an adaptive scan of dimensions.

Inner products become distances by one more component, sqrt(M**2 - |x|**2) for candidates (M: the largest norm) and
0 for queries. Vectors are spread over lists by k-means centroids, fitted on a bounded sample; every row is indexed.
Each query probes its nearest lists: so many that, of the true neighbours of a bounded number of trial queries,
found by comparing these with every row, the wanted share lies in the probed lists.

Inside a list, vectors are rotated by a random orthogonal matrix and kept in column blocks; after each block a
hypothesis test on the partial distance, which the rotation makes an estimate of the whole, abandons candidates that
cannot be among the k nearest with high confidence. Many queries meet many candidates at once, block by block as matrix
products; pairs that survive in small numbers go on one by one. What survives is scored exactly, in double
precision on the original vectors. (Gao and Long, "High-dimensional approximate nearest neighbor search", 2023;
Kuffo et al., "PDX", 2025.)

Neighbouring lists share scan blocks of bounded size, long lists are split into several, and a query travels once to each
block with lists that it probes. Where many queries go to one block, as all do where norms differ much or vectors have a
mean far from 0, they are counted first and dealt to several tasks, each with a copy of the block, so that copies grow with
the queries and no task with either. A query first meets the block of its own list alone; the threshold found there decides
which candidates of other blocks matter, and lists that cannot hold a nearer vector by the triangle inequality are left out.
Of equal vectors only the k + 1 smallest ids can be in a result, so only they are scanned, and equal queries are
answered once; both are exact. The driver holds the sample and two numbers per list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled


@dataclass(frozen=True)
class Parameters:
    k: int = 20
    sample: int = 16_384  # rows that fit the centroids, at most (in expectation)
    anchors: int = 2_048  # rows of the sample that give each query its first threshold
    rows_per_list: int = 512
    most_lists: int = 1_024
    probes: int = 24  # at least; raised until the trial queries' recall is reached
    trials: int = 128  # queries that are compared with every row to choose the probes
    recall: float = 0.95  # of the trial queries; the margin above 0.9 is for the others and for the adaptive test
    column_block: int = 16
    epsilon: float = 2.1  # the test's confidence, as in the paper
    block: int = 8_192
    asking: int = 2_048  # queries that meet a block in one task
    seed: int = 7
    exact: bool = False  # every list that can hold a neighbour is probed, and only certain losers are abandoned


@dataclass
class Index:
    """What the driver fits: all of it bounded by Parameters and the dimension."""

    width: int
    top: float
    centroids: np.ndarray
    rotation: np.ndarray
    anchors: np.ndarray
    counts: np.ndarray
    parameters: Parameters
    radii: np.ndarray | None = None  # the largest distance from a list's centroid to its rows

    def lifted(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        last = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.top**2 - (x * x).sum(axis=1), 0.0))
        return np.concatenate([x, last[:, None]], axis=1)

    def blocks(self) -> tuple[np.ndarray, np.ndarray]:
        """For each list its first scan block and the number of its blocks; short lists share one with their neighbours."""
        p = self.parameters
        middle = self.centroids - self.centroids.mean(axis=0)
        along = middle @ np.linalg.svd(middle, full_matrices=False)[2][0]
        first, number = np.zeros(len(self.counts), np.int64), np.maximum(1, -(-self.counts // p.block)).astype(np.int64)
        block, filled = -1, p.block + 1
        for k in np.argsort(along, kind="stable"):
            if filled + self.counts[k] > p.block:
                block, filled = block + 1, 0
            first[k] = block
            filled += self.counts[k]
            block += number[k] - 1
        return first, number

    def away(self, lifted: np.ndarray) -> np.ndarray:
        """Squared distances to the centroids."""
        square = (lifted * lifted).sum(axis=1)[:, None] - 2 * lifted @ self.centroids.T + (self.centroids * self.centroids).sum(axis=1)
        return np.maximum(square, 0.0)


def usable(vector: Column, width: int | None = None) -> Column:
    """True for vectors that are neither null nor zero and hold no null or non-finite component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0)
    sound = F.coalesce(sound, F.lit(False))
    return sound if width is None else sound & (F.size(vector) == width)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    weight = (centroids * centroids).sum(axis=1)
    for k in range(0, len(x), 4096):
        out[k : k + 4096] = np.argmin(weight - 2 * x[k : k + 4096] @ centroids.T, axis=1)
    return out


def _kmeans(x: np.ndarray, lists: int, seed: int, rounds: int = 10) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), lists, replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        sizes = np.bincount(own, minlength=lists)
        centroids[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
        centroids[sizes == 0] = x[rng.choice(len(x), (sizes == 0).sum())]
    return centroids


def fit(rows: DataFrame, parameters: Parameters) -> Index | None:
    """An index for rows (id, vector) of usable vectors of one width; None if there are none."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    total = rows.agg(F.count("*").alias("n"), F.max(norm).alias("top"), F.max(F.size("vector")).alias("width")).first()
    if not total.n:
        return None
    p = parameters
    draw = F.pmod(F.xxhash64("id", F.lit("index sample")), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.where(draw <= min(1.0, p.sample / total.n)).select("vector").toArrow().column(0).to_pylist()
    sample = np.array(picked or rows.select("vector").limit(1).toArrow().column(0).to_pylist(), np.float64)
    rng = np.random.default_rng(p.seed)
    rotation = np.linalg.qr(rng.normal(size=(total.width + 1, total.width + 1)))[0]
    index = Index(total.width, float(total.top), np.zeros((1, total.width + 1)), rotation, sample[:0], np.array([total.n]), p)
    sample = index.lifted(rng.permutation(sample))
    index.anchors = sample[: p.anchors]
    lists = int(max(1, min(p.most_lists, total.n // p.rows_per_list, len(sample) // 8)))
    index.centroids = _kmeans(sample, lists, p.seed)
    return index


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), width)


def _placed(rows: DataFrame, index: Index) -> DataFrame:
    """(id, list, data, away) for each candidate; data: the vector's bytes as doubles, away: its distance from the centroid."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), index.width)
            lifted = index.lifted(x)
            lists = _nearest(lifted, index.centroids) if len(x) else np.zeros(0, np.int64)
            away = np.sqrt(((lifted - index.centroids[lists]) ** 2).sum(axis=1))
            data = pa.array([v.tobytes() for v in x], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.int32()), data, pa.array(away, pa.float64())], names=["id", "list", "data", "away"])

    return rows.select("id", "vector").mapInArrow(place, "id long, list int, data binary, away double")


def probes_for_recall(placed: DataFrame, asking: DataFrame, index: Index) -> int:
    """The least number of probes, but no fewer than the parameter, that reaches the recall on the trial queries.

    Trial queries are rows of asking (id, vector), chosen by a hash; they meet every row of placed once.
    """
    p = index.parameters
    if len(index.centroids) <= p.probes:
        return p.probes
    trials = asking.orderBy(F.xxhash64("id", F.lit("trial")), "id").limit(p.trials).select("id", "vector").toArrow()
    if not len(trials):
        return p.probes
    names = trials.column(0).to_numpy()
    q = np.array(trials.column(1).to_pylist(), np.float64)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best rows of the partition for each trial query."""
        best = [np.empty((len(q), 0)), np.empty((len(q), 0), np.int64), np.empty((len(q), 0), np.int32)]
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float64).reshape(-1, index.width)
            for k in range(0, len(x), 4096):
                ids, lists = (batch.column(c).to_numpy()[k : k + 4096] for c in (0, 1))
                scores = np.where(names[:, None] == ids, -np.inf, q @ x[k : k + 4096].T)
                best = [np.concatenate([b, np.broadcast_to(y, scores.shape)], axis=1) for b, y in zip(best, (scores, ids, lists))]
                if best[0].shape[1] > p.k:
                    top = np.argpartition(-best[0], p.k - 1, axis=1)[:, : p.k]
                    best = [np.take_along_axis(b, top, axis=1) for b in best]
        query = np.repeat(np.arange(len(q), dtype=np.int32), best[0].shape[1])
        there = np.isfinite(best[0].ravel())
        yield pa.RecordBatch.from_arrays([pa.array(c[there]) for c in (query, *(b.ravel() for b in best))], names=["query", "score", "id", "list"])

    found = placed.select("id", "list", "data").mapInArrow(scored, "query int, score double, id long, list int")
    nearest = found.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("n") <= p.k)
    true = nearest.select("query", "list").toArrow()  # trials * k rows at most
    if not len(true):
        return p.probes
    away = index.away(index.lifted(q, True))
    places = np.argsort(np.argsort(away, axis=1, kind="stable"), axis=1)
    needed = np.sort(places[true.column(0).to_numpy(), true.column(1).to_numpy()]) + 1
    return max(p.probes, int(needed[int(np.ceil(p.recall * len(needed))) - 1]))


_QUERY = "block int, query long, data binary, limit double, reach double"


def _batches(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _part(ids: np.ndarray, parts: int | np.ndarray) -> np.ndarray:
    return (ids.astype(np.uint64) * np.uint64(0x9E3779B1) >> np.uint64(16)).astype(np.int64) % parts


def _first_routes(queries: DataFrame, index: Index) -> DataFrame:
    """Each query with the block of its own list: the first threshold comes from the anchors, the reach covers its probes."""
    p = index.parameters
    first, number = index.blocks()
    wanted = p.k + 1

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids, q = part.column(0).to_numpy(), _matrix(part.column(1), index.width)
                lifted = index.lifted(q, True)
                away = index.away(lifted)
                order = np.argsort(away, axis=1, kind="stable")
                met = np.cumsum(index.counts[order], axis=1)
                enough = np.minimum((met < 2 * wanted).sum(axis=1), len(index.counts) - 1)
                last = np.maximum(enough, min(p.probes, len(index.counts)) - 1)
                reach = np.take_along_axis(away, np.take_along_axis(order, last[:, None], axis=1), axis=1)[:, 0]
                near = (index.anchors**2).sum(axis=1) - 2 * lifted @ index.anchors.T + (lifted**2).sum(axis=1)[:, None]
                limits = np.partition(near, wanted - 1, axis=1)[:, wanted - 1] if near.shape[1] >= wanted else np.full(len(q), np.inf)
                own = order[:, 0]
                block = first[own] + _part(ids, number[own])
                yield _batches({
                    "block": pa.array(block, pa.int32()), "query": pa.array(ids), "data": pa.array([v.tobytes() for v in q], pa.binary()),
                    "limit": pa.array(_slack(limits, index), pa.float64()), "reach": pa.array(np.full(len(q), np.inf) if p.exact else reach * (1 + 1e-9), pa.float64()),
                })

    return queries.select("id", "vector").mapInArrow(route, _QUERY)


def _slack(limits: np.ndarray, index: Index) -> np.ndarray:
    """Thresholds that rounding in partial distances cannot miss."""
    return limits * (1 + 1e-9) + 1e-9 * index.top**2


def _later_routes(met: DataFrame, index: Index, counted: bool = False) -> DataFrame:
    """Each query with every other block that holds a list within its reach and not farther than its threshold allows.

    counted: only (block, n), how many queries of a batch go there.
    """
    first, number = index.blocks()
    blocks = int((first + number).max())
    holds = np.zeros((len(first), blocks), bool)
    for k, (a, n) in enumerate(zip(first, number)):
        holds[k, a : a + n] = True

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids, limit, reach = (part.column(c).to_numpy() for c in ("query", "limit", "reach"))
                q = np.frombuffer(b"".join(part.column("data").to_pylist()), np.float64).reshape(-1, index.width)
                away = index.away(index.lifted(q, True))
                going = (away <= reach[:, None]) & (np.sqrt(away) - index.radii - 1e-6 * index.top <= np.sqrt(limit)[:, None])
                to = going.astype(np.float32) @ holds.astype(np.float32) > 0
                to[np.arange(len(ids)), part.column("block").to_numpy()] = False
                if counted:
                    going = to.sum(axis=0)
                    block = np.flatnonzero(going)
                    yield _batches({"block": pa.array(block, pa.int32()), "n": pa.array(going[block], pa.int64())})
                    continue
                j, block = np.nonzero(to)
                yield _batches({
                    "block": pa.array(block, pa.int32()), "query": pa.array(ids[j]), "data": part.column("data").take(pa.array(j)), "limit": pa.array(limit[j]), "reach": pa.array(reach[j]),
                })

    return met.mapInArrow(route, "block int, n long" if counted else _QUERY)


def _dealt(queries: DataFrame, counts: DataFrame, candidates: DataFrame, index: Index) -> tuple[DataFrame, DataFrame]:
    """Both with a `part`: a block's queries are dealt to as many parts as keep each to Parameters.asking, and its candidates go to all of them.

    counts: (block, n) of the queries, summed by block: one number a block on the driver.
    """
    first, number = index.blocks()
    parts = np.ones(int((first + number).max()), np.int64)
    for r in counts.groupBy("block").agg(F.sum("n").alias("n")).collect():
        parts[r.block] = -(-r.n // index.parameters.asking)
    several = F.element_at(F.lit(parts.tolist()), F.col("block") + 1)
    own = F.pmod(F.xxhash64("query", F.lit("part")), several).cast("int")
    return queries.withColumn("part", own), candidates.withColumn("part", F.explode(F.sequence(F.lit(0), several.cast("int") - 1)))


def adaptive_scan(q: np.ndarray, columns: list[np.ndarray], limits: np.ndarray, k: int, epsilon: float, allowed: np.ndarray | None = None, chunk: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) places of the pairs that were not abandoned: with high confidence all of each query's k nearest within its limit.

    allowed: for each query, which candidates it meets at all. An infinite epsilon abandons only what is certain to be farther.
    """
    edges = np.cumsum([0, *(c.shape[1] for c in columns)])
    width, limits = edges[-1], limits.copy()
    slack = 1e-9 * max(1e-300, max((float((c * c).sum(axis=1).max(initial=0)) for c in columns), default=0.0))
    none = np.empty(0, np.int64)
    met, places, sums = none, none, np.empty(0)
    for start in range(0, len(columns[0]), chunk):
        own = np.arange(start, min(start + chunk, len(columns[0])))
        alive = np.ones((len(q), len(own)), bool) if allowed is None else allowed[:, start : start + chunk].copy()
        partial, j, c = np.zeros(alive.shape), None, None
        for column, done, upto in zip(columns, edges[:-1], edges[1:]):
            mine = q[:, done:upto]
            if j is None:  # matrix products over what is left of the chunk
                x = column[own]
                partial += (mine * mine).sum(axis=1)[:, None] - 2 * mine @ x.T + (x * x).sum(axis=1)
            else:
                apart = column[own[c]] - mine[j]
                partial = partial + np.einsum("ij,ij->i", apart, apart)
            bound = limits
            if upto < width and np.isfinite(epsilon):
                bound = np.minimum(limits, limits * upto / width * (1 + epsilon / np.sqrt(upto)) ** 2)
            if j is None:
                alive &= partial <= bound[:, None] + slack
                share = alive.mean() if alive.size else 0.0
                if share < 0.05 or upto == width:
                    j, c = np.nonzero(alive)
                    partial = partial[j, c]
                elif (cols := alive.any(axis=0)).mean() < 0.5:
                    own, alive, partial = own[cols], alive[:, cols], partial[:, cols]
            else:
                stay = partial <= bound[j] + slack
                j, c, partial = j[stay], c[stay], partial[stay]
            if j is not None and not len(j):
                break
        if j is None or not len(j):
            continue
        met, places, sums = np.concatenate([met, j]), np.concatenate([places, own[c]]), np.concatenate([sums, partial])
        order = np.lexsort((sums, met))
        met, places, sums = met[order], places[order], sums[order]
        begins = np.searchsorted(met, np.arange(len(q)))
        full = np.append(begins[1:], len(met)) - begins >= k
        limits[full] = np.minimum(limits[full], sums[begins[full] + k - 1] * (1 + 1e-9) + slack)
        stay = sums <= limits[met] + slack
        met, places, sums = met[stay], places[stay], sums[stay]
    return met, places


def _scan_block(queries: pd.DataFrame, candidates: pd.DataFrame, index: Index, group: int = 256) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each group of queries: its rows, and (row, id, score, squared distance's threshold) of the k + 1 best of each among the candidates."""
    p = index.parameters
    x = np.frombuffer(b"".join(candidates["data"]), np.float64).reshape(-1, index.width)
    ids, lists = candidates["id"].to_numpy(), candidates["list"].to_numpy()
    rotated = index.lifted(x) @ index.rotation
    columns = [np.ascontiguousarray(rotated[:, k : k + p.column_block]) for k in range(0, rotated.shape[1], p.column_block)]
    here, place = np.unique(lists, return_inverse=True)
    for at in range(0, len(queries), group):
        part = queries.iloc[at : at + group]
        q = np.frombuffer(b"".join(part["data"]), np.float64).reshape(-1, index.width)
        lifted = index.lifted(q, True)
        limits, allowed = part["limit"].to_numpy(), None
        if "reach" in part and not (near := index.away(lifted)[:, here] <= part["reach"].to_numpy()[:, None]).all():
            allowed = near[:, place]
        j, found = adaptive_scan(lifted @ index.rotation, columns, limits, p.k + 1, np.inf if p.exact else p.epsilon, allowed)
        scores = np.einsum("ij,ij->i", x[found], q[j])
        order = np.lexsort((ids[found], -scores, j))
        j, found, scores = j[order], found[order], scores[order]
        rank = np.arange(len(j)) - np.searchsorted(j, j)
        j, found, scores, rank = (v[rank <= p.k] for v in (j, found, scores, rank))
        # the distance that belongs to the last score: |q|**2 + M**2 - 2 q.x
        last = rank == p.k
        limits = limits.copy()
        limits[j[last]] = np.minimum(limits[j[last]], _slack((q[j[last]] ** 2).sum(axis=1) + index.top**2 - 2 * scores[last], index))
        yield part, j, ids[found], scores, limits


def _first_scan(queries: pd.DataFrame, candidates: pd.DataFrame, index: Index) -> pd.DataFrame:
    """Each query's row with the best of its own block, which it meets whole, and the threshold that they give."""
    if not len(queries) or not len(candidates):
        none = pd.Series([[]] * len(queries), index=queries.index, dtype=object)
        return queries[["block", "query", "data", "limit", "reach"]].assign(ids=none, scores=none)
    out = []
    for part, j, ids, scores, limits in _scan_block(queries.drop(columns="reach"), candidates, index):
        cuts = np.searchsorted(j, np.arange(1, len(part)))
        rows = part[["block", "query", "data"]].assign(limit=limits, reach=queries["reach"].loc[part.index])
        rows["ids"], rows["scores"] = [list(v) for v in np.split(ids, cuts)], [list(v) for v in np.split(scores, cuts)]
        out.append(rows)
    return pd.concat(out, ignore_index=True)


def _later_scan(queries: pd.DataFrame, candidates: pd.DataFrame, index: Index) -> pd.DataFrame:
    out = [pd.DataFrame({"query": pd.Series([], dtype="int64"), "id": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})]
    if len(queries) and len(candidates):
        for part, j, ids, scores, _ in _scan_block(queries, candidates, index):
            out.append(pd.DataFrame({"query": part["query"].to_numpy()[j], "id": ids, "score": scores}))
    return pd.concat(out, ignore_index=True)


def nearest_neighbours(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", parameters: Parameters | None = None) -> DataFrame:
    """(query_id long, rank int, <id_col> long, score double): the nearest rows found for each row for which `queries` holds.

    A query is no candidate of its own; ties go to the smaller id; fewer candidates than k are all returned.
    Null, zero and non-finite vectors take no part, nor do rows with a null id or, beside the most frequent
    width (the smallest of equally frequent ones), vectors of another width. Of repeated ids each row is a candidate, but
    none for a query with that id. Other columns are ignored; an empty table gives no rows.
    """
    p = parameters or Parameters()
    named = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks"))
    sound = named.where(F.col("id").isNotNull() & usable(F.col("vector")))
    widths = sound.groupBy(F.size("vector").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(1).collect()
    rows = sound.where(F.size("vector") == (widths[0].w if widths else 0))
    index = fit(rows, p) if widths else None
    schema = f"query_id long, rank int, `{id_col}` long, score double"
    if index is None:
        return vectors.sparkSession.createDataFrame([], schema)

    first = Window.partitionBy("vector").orderBy("id")
    candidates = rows.select("id", "vector").withColumn("n", F.row_number().over(first)).where(F.col("n") <= p.k + 1)
    placed = settled(_placed(candidates, index))
    sizes = {r["list"]: r for r in placed.groupBy("list").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()}
    index.counts = np.array([sizes[k].n if k in sizes else 0 for k in range(len(index.centroids))])
    index.radii = np.array([sizes[k].radius if k in sizes else 0.0 for k in range(len(index.centroids))])
    asking = rows.where("asks")
    index.parameters = replace(p, probes=len(index.centroids) if p.exact else probes_for_recall(placed, asking, index))
    starts, number = index.blocks()
    in_list = lambda values: F.element_at(F.lit(values.tolist()), F.col("list") + 1)
    dealt = placed.select("id", "list", "data", (in_list(starts) + F.pmod(F.xxhash64("id"), in_list(number))).cast("int").alias("block"))
    distinct = asking.groupBy("vector").agg(F.min("id").alias("id"))
    keys = ["block", "part"]
    routed = settled(_first_routes(distinct, index))
    routed, own = _dealt(routed, routed.select("block", F.lit(1).alias("n")), dealt, index)
    met = routed.groupBy(*keys).cogroup(own.groupBy(*keys))
    met = settled(met.applyInPandas(lambda q, c: _first_scan(q, c, index), "block int, query long, data binary, limit double, reach double, ids array<long>, scores array<double>"))
    going = met.select("block", "query", "data", "limit", "reach")
    routed, own = _dealt(_later_routes(going, index), _later_routes(going, index, True), dealt, index)
    later = routed.groupBy(*keys).cogroup(own.groupBy(*keys))
    found = later.applyInPandas(lambda q, c: _later_scan(q, c, index), "query long, id long, score double")
    found = found.unionByName(met.select("query", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("query", F.col("x.ids").alias("id"), F.col("x.scores").alias("score")))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    top = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= p.k + 1)
    lists = top.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("n", "id", "score"))).alias("near"))
    answers = asking.select("id", "vector").join(distinct.select("vector", F.col("id").alias("query")), "vector").join(lists, "query")
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, p.k)
    flat = answers.select(F.col("id").alias("query_id"), F.posexplode(others).alias("place", "x"))
    return flat.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("x.id").alias(id_col), F.col("x.score").alias("score"))
