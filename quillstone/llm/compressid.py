"""Language identification by compression.

One zstandard raw-content dictionary per language, cut from labelled texts; a text is encoded with each
of them, and the language whose dictionary makes it smallest is its language. The code length includes the
language's prior, which settles ties on very short texts; narrow margins are rejected. Texts are encoded
whole, in chunks, each chunk against the dictionary alone, so that long texts are judged by the
dictionaries and not by their own repetitions, and memory stays constant.

The dictionaries come from a bounded sample: about `snippets` labelled texts per language, chosen by a hash of
the id, and of each a window of `snippet_chars` characters at a place that the hash chooses. Many short windows
keep a passage that texts share from filling a dictionary.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNDETERMINED = "und"
_OTHER = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class Dictionaries:
    """What training yields: per language its dictionary and the bits of its prior."""

    languages: tuple[str, ...]
    contents: tuple[bytes, ...]
    prior_bits: tuple[float, ...]
    level: int = 7
    chunk: int = 2048


def letters(text: str) -> bytes:
    """The text's letters in lower case, everything between them as one space."""
    return _OTHER.sub(" ", text.lower()).strip().encode("utf-8", "replace")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", where: Column | None = None,
          snippets: int = 1200, snippet_chars: int = 110, dictionary_bytes: int = 112 << 10, level: int = 7, most_languages: int = 4096) -> Dictionaries:
    """Dictionaries from the rows with a language and a text; ties in the sample's order go by the text.

    What reaches the driver is bounded by most_languages * snippets windows of snippet_chars characters (in expectation).
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows if where is None else rows.where(where)
    counts = rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()
    if not counts:
        return Dictionaries((), (), ())
    total = sum(r.n for r in counts)
    chances = F.create_map(*[F.lit(x) for r in counts for x in (r.lang, snippets / r.n)])
    chance = F.coalesce(F.element_at(chances, F.col(lang_col)), F.lit(0.0))
    draw = F.xxhash64(F.col(id_col), F.lit("language sample"))
    text = F.col(text_col)
    start = 1 + F.pmod(F.xxhash64(F.col(id_col), F.lit("place")), F.greatest(F.lit(1), F.length(text) - snippet_chars)).cast("int")
    picked = rows.where(F.pmod(draw, F.lit(1 << 30)) / float(1 << 30) < chance).select(
        F.col(lang_col).alias("lang"), draw.alias("draw"), F.substring(text, start, F.lit(snippet_chars)).alias("window")
    )
    windows: dict[str, list] = {}
    for batch in picked.toArrow().to_batches():  # at most snippets of snippet_chars a language
        for lang, draw_, window in zip(*(c.to_pylist() for c in batch.columns)):
            windows.setdefault(lang, []).append((draw_, letters(window)))
    languages = tuple(sorted(windows))
    contents = tuple(b" ".join(w for _, w in sorted(windows[x]))[:dictionary_bytes] for x in languages)
    priors = {r.lang: -math.log2(r.n / total) for r in counts}
    return Dictionaries(languages, contents, tuple(priors[x] for x in languages), level)


@lru_cache(maxsize=4)
def _compressors(model: Dictionaries) -> list[zstandard.ZstdCompressor]:
    made = []
    for content in model.contents:
        if len(content) < 8:  # too short for a dictionary: plain compression
            made.append(zstandard.ZstdCompressor(level=model.level, write_content_size=False, write_checksum=False))
            continue
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=model.level)
        made.append(zstandard.ZstdCompressor(level=model.level, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False))
    return made


def code_bits(model: Dictionaries, text: str) -> list[float]:
    """The bits of the whole text with each language's dictionary, prior included."""
    data = letters(text)
    parts = [data[k : k + model.chunk] for k in range(0, len(data), model.chunk)]
    return [8 * sum([len(c.compress(p)) for p in parts]) + bits for c, bits in zip(_compressors(model), model.prior_bits)]


def classify(model: Dictionaries, text: str | None, min_margin: float) -> tuple[str, str, float, float]:
    """(nearest, language, score, margin) of a text; language is `und` where the margin is narrower than min_margin."""
    if not model.languages or text is None or not any(map(str.isalpha, text)):
        return UNDETERMINED, UNDETERMINED, 0.0, 0.0
    bits = code_bits(model, text)
    order = sorted(range(len(bits)), key=lambda k: (bits[k], model.languages[k]))
    best = order[0]
    # code lengths are tempered to an eighth: a byte's difference counts as one bit of evidence
    score = 1.0 / sum(2.0 ** (max(-1000.0, (bits[best] - b) / 8)) for b in bits)
    margin = (bits[order[1]] - bits[best]) / bits[order[1]] if len(order) > 1 else 1.0
    nearest = model.languages[best]
    return nearest, nearest if margin >= min_margin else UNDETERMINED, score, margin


def identify_language(docs: DataFrame, model: Dictionaries, id_col: str = "doc_id", text_col: str = "text", min_margin: float = 0.02) -> DataFrame:
    """One row for each row of docs: id, nearest, language, score, margin.

    nearest is the language with the smallest code (ties: the alphabetically first); language is the same, or
    `und` where the margin, relative to the second smallest code, is below min_margin. Null texts and texts
    without a letter are `und` in both, with score 0; texts of any length are coded whole, chunk by chunk. Repeated rows are treated alike, other columns ignored; an
    empty table gives no rows. The model, a few hundred KB a language at most, goes along with the task.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [classify(model, t.as_py(), min_margin) for t in batch.column(1)]
            columns = list(zip(*rows)) if rows else [()] * 4
            arrays = [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[id_col, "nearest", "language", "score", "margin"])

    schema = f"`{id_col}` {kind}, nearest string, language string, score double, margin double"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(judged, schema)
