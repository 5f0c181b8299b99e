"""URL filter by the ratio of two character language models.

Rules decide the urls they fit. The others are judged by how much likelier each character is under a model of
the accepted than under one of the rejected urls, averaged over the url's length. Both are variable-order Markov
models: counts of the longest order are shrunk towards shorter contexts by Witten-Bell smoothing, where a context
with few observations says little. Counts come from all urls that rules decide, but for one fold in five, whose
scores calibrate the threshold.

The alphabet has 40 symbols, so a table of all contexts of three and a next symbol has 2,560,000 cells, 10 MB,
whatever the input; that bound is why it may be broadcast. Counting combines before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The symbols that are told apart; the last stands for every other character.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789.-/~"
ORDER = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BINS, SPAN = 2000, 10.0


@dataclass(frozen=True)
class Rule:
    """allow or block what lies below a host and a path, written like `example.com/en/`."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for null and for what has no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does."""
    text, verdict = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text, verdict = text.when(fits, rule.text), verdict.when(fits, rule.verdict)
    return text, verdict


def _spelled(url: Column) -> Column:
    """What the models read: the url behind its scheme, lower case, with a run-up of ORDER - 1 slashes."""
    rest = F.coalesce(F.regexp_replace(url, r"^[^:/?#]*://", ""), F.lit(""))
    small = F.translate(rest, UPPER, LOWER)
    return F.concat(F.lit("/" * (ORDER - 1)), F.regexp_replace(small, r"[^a-z0-9./-]", "~"))


def gram_counts(spelled: DataFrame) -> DataFrame:
    """(gram, accepted, rejected) over rows (spelled, verdict)."""
    places = F.sequence(F.lit(1), F.greatest(F.lit(0), F.length("spelled") - (ORDER - 1)))
    long_enough = spelled.where(F.length("spelled") >= ORDER)
    grams = long_enough.select("verdict", F.explode(F.transform(places, lambda i: F.substring(F.col("spelled"), i, F.lit(ORDER)))).alias("gram"))
    return grams.groupBy("gram").agg(F.count_if(F.col("verdict") == "allow").alias("accepted"), F.count_if(F.col("verdict") == "block").alias("rejected"))


def _codes(text: bytes) -> np.ndarray:
    return _LOOKUP[np.frombuffer(text, np.uint8)]


_LOOKUP = np.full(256, len(ALPHABET) - 1, np.int64)
_LOOKUP[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))


def _smoothed(counts: np.ndarray) -> np.ndarray:
    """Probabilities of the last symbol given the others, of the counts' shape."""
    size = counts.shape[0]
    p = np.full(size, 1.0 / size)
    for order in range(1, counts.ndim + 1):
        c = counts.sum(axis=tuple(range(counts.ndim - order))) if order < counts.ndim else counts
        seen, kinds = c.sum(axis=-1, keepdims=True), np.maximum((c > 0).sum(axis=-1, keepdims=True), 1)
        p = (c + kinds * p[np.newaxis] if order > 1 else c + kinds * p) / (seen + kinds)
    return p


def log_ratios(grams: list[tuple[str, int, int]]) -> np.ndarray:
    """log_ratio_table of counted grams (gram, accepted, rejected)."""
    names = "".join(g for g, _, _ in grams).encode("ascii")
    return log_ratio_table(np.frombuffer(names, np.uint8), np.array([g[1] for g in grams]), np.array([g[2] for g in grams]))


def log_ratio_table(names: np.ndarray, accepted: np.ndarray, rejected: np.ndarray) -> np.ndarray:
    """log P(accepted) - log P(rejected) of each symbol after each context, as a flat table; names: the grams' bytes, one behind the other."""
    shape = (len(ALPHABET),) * ORDER
    both = [np.zeros(shape), np.zeros(shape)]
    if len(names):
        where = tuple(_LOOKUP[names].reshape(-1, ORDER).T)
        for counts, k in zip(both, (accepted, rejected)):
            np.add.at(counts, where, k)
    if not all(c.any() for c in both):
        return np.zeros(len(ALPHABET) ** ORDER, np.float32)
    return (np.log(_smoothed(both[0])) - np.log(_smoothed(both[1]))).astype(np.float32).ravel()


def counted_table(grams: DataFrame) -> np.ndarray:
    """log_ratio_table of rows (gram, accepted, rejected), brought to the driver as Arrow columns: 20 bytes a gram, len(ALPHABET) ** ORDER grams at most."""
    found = grams.toArrow().combine_chunks()
    parts = [found.column(0).chunk(k) for k in range(found.column(0).num_chunks)]
    names = np.frombuffer("".join("".join(p.to_pylist()) for p in parts).encode("ascii"), np.uint8)
    return log_ratio_table(names, found.column(1).to_numpy(), found.column(2).to_numpy())


def mean_ratios(texts: list[str], table: np.ndarray) -> np.ndarray:
    """The mean log ratio over the characters of each spelled text; 0 for a text without any."""
    if not texts:
        return np.zeros(0)
    codes = _codes("".join(texts).encode("ascii", "replace"))
    n = len(codes) - ORDER + 1
    if n <= 0:
        return np.zeros(len(texts))
    index = np.zeros(n, np.int64)
    for k in range(ORDER):
        index = index * len(ALPHABET) + codes[k : k + n]
    sums = np.concatenate([[0.0], np.cumsum(table[index], dtype=np.float64)])
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    counts = np.maximum(lengths - ORDER + 1, 0)
    last = np.minimum(ends - ORDER + 1, n)
    return np.where(counts > 0, (sums[np.maximum(last, 0)] - sums[np.minimum(ends - lengths, n)]) / np.maximum(counts, 1), 0.0)


def scored(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """rows with `score`, from their column `spelled`; one pass without a shuffle."""
    shared = rows.sparkSession.sparkContext.broadcast(table)
    at = rows.columns.index("spelled")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array(mean_ratios(batch.column(at).to_pylist(), shared.value), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(judged, f"{fields}, score double")


def calibrated(held_out: DataFrame) -> float:
    """The threshold with the best balanced accuracy on rows (score, verdict); of equally good ones the nearest to 0."""
    bins = F.least(F.greatest(F.floor((F.col("score") + SPAN) / (2 * SPAN) * BINS), F.lit(0)), F.lit(BINS - 1)).cast("int")
    counts = held_out.groupBy(bins.alias("bin")).agg(F.count_if(F.col("verdict") == "allow").alias("a"), F.count_if(F.col("verdict") == "block").alias("b")).collect()
    good, bad = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for r in counts:
        good[r.bin], bad[r.bin] = r.a, r.b
    if not good.sum() or not bad.sum():
        return 0.0
    kept = good[::-1].cumsum()[::-1] / good.sum()  # share of accepted urls at or above each bin
    stopped = (bad.cumsum() - bad) / bad.sum()
    value = kept + stopped
    borders = np.arange(BINS + 1) / BINS * 2 * SPAN - SPAN
    best = np.flatnonzero(value >= value.max() - 1e-12)
    return float(borders[best[np.argmin(np.abs(borders[best]))]])


def filter_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each row of pages: id, host, path, rule, verdict (allow or block), score, threshold.

    A null url is judged as an empty one: no rule, score 0; urls of any length are scored whole, by the mean over
    their characters, and a score at the threshold allows. Repeated rows are treated alike and count each in
    training; other columns are ignored; an empty table gives no rows. Where rules decide no url, or decide all
    alike, every score is 0 and the rest is allowed.
    """
    url = F.col(url_col)
    host, path = parts(url)
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), _spelled(url).alias("spelled"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "verdict": verdict})
    decided = rows.where("rule is not null").withColumn("fold", F.pmod(F.xxhash64("spelled"), F.lit(5)))
    table = counted_table(gram_counts(decided.where("fold <> 0")))
    threshold = calibrated(scored(decided.where("fold = 0").select("verdict", "spelled"), table))
    judged = scored(rows, table)
    own = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "score", F.lit(threshold).alias("threshold"))
