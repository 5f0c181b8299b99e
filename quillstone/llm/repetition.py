"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths, computed in numpy over the words of one document at a time,
mark the characters that lie inside n-grams seen before in the same text; repeated lines are measured
beside them. A document fails when a share exceeds its limit.

Defined results: a null text counts as empty; an empty text has no words and fails the word minimum;
repeated rows are judged one by one; columns other than the id and the text are ignored; a table
without rows gives no rows. Memory follows the longest single text, never a group of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The characters that count as symbols, and the limits of the rules. The limits for
#: repeated n-grams are the published ones of the MassiveText filters (Rae et al., 2021, table A1).
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
TOP_LIMITS = {2: 0.20, 3: 0.18, 4: 0.16}
DUPLICATE_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}


@dataclass(frozen=True)
class Limits:
    """Limits of the rules; a share above its limit fails the document.

    An n-gram counts as the top one from top_count occurrences on, and shares of repeated lines from
    few_lines lines on: below, one recurring heading would fail a short clean text.
    """

    min_words: int = 10
    repeat_words_percent: int = 20
    window: int = 5
    top: dict[int, float] = field(default_factory=lambda: dict(TOP_LIMITS))
    duplicate: dict[int, float] = field(default_factory=lambda: dict(DUPLICATE_LIMITS))
    top_count: int = 3
    runs: float = 0.20
    duplicate_lines: float = 0.30
    few_lines: int = 5
    duplicate_line_chars: float = 0.20
    symbols_per_word: float = 0.10


SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "dup_line_share double, dup_line_char_share double, top_ngram_share double, dup_ngram_share double, "
    "base_failed boolean, kept boolean, reason string"
)

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _mixed(ids: np.ndarray) -> np.ndarray:
    """A 64-bit value for each word number; different numbers have different values."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Rolling:
    """Polynomial hashes, modulo 2**64, of all windows of a text's words: any length from one prefix sum."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        with np.errstate(over="ignore"):
            powers = np.full(n, _BASE, np.uint64)
            down = np.full(n, _INVERSE, np.uint64)
            if n:
                powers[0] = down[0] = 1
            powers, self.down = np.multiply.accumulate(powers), np.multiply.accumulate(down)
            self.prefix = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(_mixed(ids) * powers)])

    def windows(self, n: int) -> np.ndarray:
        if len(self.prefix) <= n:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            return (self.prefix[n:] - self.prefix[:-n]) * self.down[: len(self.prefix) - n]


def _groups(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by value (first places first), where groups of equal values start in it, and their sizes."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return order, starts, np.diff(np.concatenate([starts, [len(hashes)]]))


def _inside(places: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which words lie inside a window of n words that starts at one of the places."""
    edge = np.zeros(words + 1, np.int64)
    np.add.at(edge, places, 1)
    np.add.at(edge, places + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(text: str | None, limits: Limits) -> tuple:
    """The row of SCHEMA for one whole text."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n_words = len(words)
    word_chars = len(text) - sum(map(text.count, SPACES))
    n_symbols = sum(map(text.count, SYMBOLS))

    seen: set[str] = set()
    lines = dup_lines = line_chars = dup_line_chars = 0
    for line in text.split("\n"):
        if line and line.strip(SPACES):
            lines += 1
            line_chars += len(line)
            if line in seen:
                dup_lines += 1
                dup_line_chars += len(line)
            else:
                seen.add(line)

    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n_words)
    repeat_words, top_share, dup_share, reasons = 0, 0.0, 0.0, []
    if len(numbers) < n_words:  # else no word occurs twice, and so no n-gram does
        rolling = Rolling(ids)
        chars = np.fromiter((len(w) if w.isascii() else len(w.decode("utf-8", "surrogatepass")) for w in words), np.int64, n_words)
        run_share = float(chars[1:][ids[1:] == ids[:-1]].sum() / word_chars)
        if run_share > limits.runs:
            reasons.append("words_repeated_at_once")
        found = {}
        for n in sorted({*limits.top, *limits.duplicate, limits.window}):
            hashes = rolling.windows(n)
            if not len(hashes):
                break
            order, starts, sizes = _groups(hashes)
            many = sizes > 1
            if not many.any():
                break  # longer n-grams cannot repeat either
            found[n] = order, starts, sizes, many
        for n, (order, starts, sizes, many) in found.items():
            repeated = np.repeat(many, sizes)
            if n == limits.window:
                repeat_words = int(_inside(order[repeated], n, n_words).sum())
            if n in limits.top:
                best = int(sizes.max())
                starting = starts[sizes == best]
                start = starting[np.argmin(order[starting])]  # of equally frequent ones, the n-gram that comes first
                share = float(chars[_inside(order[start : start + best], n, n_words)].sum() / word_chars)
                top_share = max(top_share, share)
                if share > limits.top[n] and best >= limits.top_count:
                    reasons.append(f"top_{n}_gram")
            if n in limits.duplicate:
                later = repeated.copy()
                later[starts] = False
                share = float(chars[_inside(order[later], n, n_words)].sum() / word_chars)
                dup_share = max(dup_share, share)
                if share > limits.duplicate[n]:
                    reasons.append(f"repeated_{n}_grams")

    line_share = dup_lines / lines if lines else 0.0
    char_share = dup_line_chars / line_chars if line_chars else 0.0
    if line_share > limits.duplicate_lines and lines >= limits.few_lines:
        reasons.append("repeated_lines")
    if char_share > limits.duplicate_line_chars and lines >= limits.few_lines:
        reasons.append("repeated_line_characters")
    if n_symbols > limits.symbols_per_word * n_words:
        reasons.append("symbols")
    failed = n_words < limits.min_words or 100 * repeat_words > limits.repeat_words_percent * n_words
    if failed:
        reasons.insert(0, "base")
    return (
        n_words, word_chars, n_symbols, dup_lines, repeat_words,
        line_share, char_share, top_share, dup_share, failed, not reasons, ",".join(reasons) or None,
    )


def repetition_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits | None = None) -> DataFrame:
    """One row for each row of docs: its id, the columns of SCHEMA; no shuffle."""
    limits = limits or Limits()
    kind = docs.schema[id_col].dataType.simpleString()
    names = [part.split()[0] for part in SCHEMA.split(", ")]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(text.as_py(), limits) for text in batch.column(1)]
            columns = list(zip(*rows)) if rows else [()] * len(names)
            kinds = [pa.int64()] * 5 + [pa.float64()] * 4 + [pa.bool_()] * 2 + [pa.string()]
            arrays = [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))]
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, *names])

    picked = docs.select(F.col(id_col), F.col(text_col))
    return picked.mapInArrow(judged, f"`{id_col}` {kind}, {SCHEMA}")


def keep_quality(docs: DataFrame, text_col: str = "text", limits: Limits | None = None) -> DataFrame:
    """The rows of docs that pass, with all their columns; the same rules in one pass without a shuffle."""
    limits = limits or Limits()
    at, kept = docs.columns.index(text_col), SCHEMA.split(", ").index("kept boolean")

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([measure(text.as_py(), limits)[kept] for text in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(passed, docs.schema)
