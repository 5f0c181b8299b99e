"""Variants of inputs: enumerated or seeded rewrites, one row each. Dictionaries are the caller's tables.

The reference draws at random; here a variant is fixed by its parameters (position, width, seed), so that a task
that runs twice gives the same rows and results can be checked.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import inferred_type
from ..registry import Registry
from ..shared import gathered
from ..views import table

R = Registry()

#: Boundary values by type and interesting integers by width.
BOUNDARIES = {
    "integer": ("0", "-1", "1", "127", "-128", "255", "256", "32767", "-32768", "65535", "65536", "2147483647", "-2147483648", "4294967295", "9223372036854775807", "-9223372036854775808"),
    "float": ("0.0", "-0.0", "1.0", "-1.0", "0.1", "0.01", "1e10", "1e-10", "1.7976931348623157e+308", "-1.7976931348623157e+308", "2.2250738585072014e-308", "NaN", "Infinity", "-Infinity"),
    "uuid": ("00000000-0000-0000-0000-000000000000", "ffffffff-ffff-ffff-ffff-ffffffffffff", "FFFFFFFF-FFFF-FFFF-FFFF-FFFFFFFFFFFF", "00000000-0000-0000-0000-000000000001", "gg000000-0000-0000-0000-000000000000", "0000000-0000-0000-0000-000000000000"),
    "email": ("", "@", "a@", "@b.com", "a@b", "a" * 64 + "@b.com", "a@" + "b" * 255 + ".com", "<script>@test.com", "a@b.com\x00c@d.com"),
    "string": ("", "\x00", "A" * 256, "A" * 1024, "A" * 65536, "\ufeff", "\r\n", "\\x00", "%00", "&#x0;"),
}
INTERESTING = {
    8: (-128, -1, 0, 1, 16, 32, 64, 100, 127),
    16: (-32768, -129, 128, 255, 256, 512, 1000, 1024, 4096, 32767),
    32: (-2147483648, -100663046, -32769, 32768, 65535, 65536, 100663045, 2147483647),
}


def flip_bits(data: bytes, at: int, width: int = 1) -> bytes:
    """`width` bits from bit `at`, the most significant of a byte first, flipped; an error outside the data."""
    if at < 0 or at + width > 8 * len(data):
        raise ValueError("bit position out of range")
    out = bytearray(data)
    for k in range(at, at + width):
        out[k // 8] ^= 0x80 >> k % 8
    return bytes(out)


def flip_bytes(data: bytes, at: int, width: int = 1) -> bytes:
    if at < 0 or at + width > len(data):
        raise ValueError("byte position out of range")
    return data[:at] + bytes(b ^ 0xFF for b in data[at : at + width]) + data[at + width :]


def add_at(data: bytes, at: int, delta: int, bits: int = 8) -> bytes:
    """A big-endian number of 8, 16 or 32 bits, with delta added and wrapped around."""
    size = bits // 8
    value = (int.from_bytes(data[at : at + size], "big") + delta) % (1 << bits)
    return data[:at] + value.to_bytes(size, "big") + data[at + size :]


def put_at(data: bytes, at: int, value: int, bits: int, order: str = "big") -> bytes:
    size = bits // 8
    return data[:at] + (value % (1 << bits)).to_bytes(size, order) + data[at + size :]


def swap_bytes(data: bytes, at: int, size: int = 2) -> bytes:
    return data[:at] + data[at : at + size][::-1] + data[at + size :]


def delete_at(data: bytes, at: int, size: int) -> bytes:
    return data[:at] + data[at + size :]


def insert_at(data: bytes, at: int, new: bytes) -> bytes:
    return data[:at] + new + data[at:]


def clone_at(data: bytes, source: int, size: int, at: int) -> bytes:
    return insert_at(data, at, data[source : source + size])


def rewrite_at(data: bytes, at: int, value: int) -> bytes:
    """One byte replaced."""
    return data[:at] + bytes([value % 256]) + data[at + 1 :]


def add_to_text(data: bytes, delta: int) -> bytes:
    """A text that is an integer, with delta added; others as they are."""
    try:
        return str(int(data.decode("ascii")) + delta).encode()
    except (ValueError, UnicodeDecodeError):
        return data


def _draw(seed: int, below: int) -> int:
    return int.from_bytes(hashlib.sha256(str(seed).encode()).digest()[:6], "big") % max(1, below)


def json_variants(text: str) -> list[tuple[str, str]]:
    """(kind, document) rewrites of a JSON object, keys sorted; other texts have none.

    Each key has its value's type changed, its name in capitals, and its value nulled: the first under the kinds type, key
    and value, the others under the same with the key behind a stroke. Then the whole: nested, and in an array.
    """
    try:
        value = json.loads(text)
    except ValueError:
        return []
    if not isinstance(value, dict) or not value:
        return []
    dump = lambda v: json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    made = []
    for place, key in enumerate(sorted(value)):
        rest, behind = {k: v for k, v in value.items() if k != key}, f"/{key}" if place else ""
        swapped = str(value[key]) if not isinstance(value[key], str) else len(value[key])
        made += [("type" + behind, dump(rest | {key: swapped})), ("key" + behind, dump(rest | {key.upper(): value[key]})), ("value" + behind, dump(rest | {key: None}))]
    return [*made, ("structure", dump({"data": value})), ("array", dump([value]))]


def xml_variants(text: str, entity: tuple[str, str] | None = None) -> list[tuple[str, str]]:
    """(kind, document) rewrites of an XML text: its first tag's case, an attribute, a CDATA section, and with the caller's
    (name, value) an internal entity in place of its first text; other texts have none."""
    m = re.search(r"<([A-Za-z][\w.-]*)([^>]*)>", text)
    if not text.lstrip().startswith("<") or not m:
        return []
    first, inner = m[1], text[m.end() :]
    body = inner.split("<", 1)[0]
    made = [
        ("tag", text.replace(f"<{first}", f"<{first.swapcase()}", 1)),
        ("attribute", text[: m.end() - 1] + ' test="1"' + text[m.end() - 1 :]),
        ("cdata", text[: m.end()] + f"<![CDATA[{body}]]>" + inner[len(body) :]),
    ]
    if entity:
        made.append(("entity", f'<!DOCTYPE {first} [<!ENTITY {entity[0]} "{entity[1]}">]>' + text[: m.end()] + f"&{entity[0]};" + inner[len(body) :]))
    return made


def _flipped(width: int, whole: bool) -> Callable[[bytes, int], bytes]:
    flip, size = (flip_bytes, 1) if whole else (flip_bits, 8)
    return lambda d, s: flip(d, _draw(s, size * len(d) - width + 1), width) if size * len(d) >= width else d


def _added(bits: int) -> Callable[[bytes, int], bytes]:
    return lambda d, s: add_at(d, _draw(s, len(d) - bits // 8 + 1), _draw(s + 1, 71) - 35, bits) if 8 * len(d) >= bits else d


def _put(bits: int) -> Callable[[bytes, int], bytes]:
    values = INTERESTING[bits]
    return lambda d, s: put_at(d, _draw(s, len(d) - bits // 8 + 1), values[_draw(s + 1, len(values))], bits, ("big", "little")[_draw(s + 2, 2)]) if 8 * len(d) >= bits else d


#: Byte rewrites by name, each of (data, seed).
MUTATORS: dict[str, Callable[[bytes, int], bytes]] = {
    **{f"bit_flip_{n}": _flipped(n, False) for n in (1, 2, 4)},
    **{f"byte_flip_{n}": _flipped(n, True) for n in (1, 2, 4)},
    **{f"arith_{n}": _added(n) for n in (8, 16, 32)},
    "arith_text": lambda d, s: add_to_text(d, _draw(s, 71) - 35),
    **{f"interesting_{n}": _put(n) for n in (8, 16, 32)},
    **{f"swap_{n}": (lambda d, s, n=n: swap_bytes(d, _draw(s, len(d) - n + 1), n) if len(d) >= n else d) for n in (2, 4)},
    "random_byte": lambda d, s: rewrite_at(d, _draw(s, len(d)), _draw(s + 1, 256)) if d else d,
    "delete": lambda d, s: delete_at(d, _draw(s, len(d)), 1 + _draw(s + 1, 16)) if len(d) > 1 else d,
    "insert": lambda d, s: insert_at(d, _draw(s, len(d) + 1), bytes(_draw(s + 2 + k, 256) for k in range(1 + _draw(s + 1, 16)))),
    "clone": lambda d, s: clone_at(d, _draw(s, len(d)), 1 + _draw(s + 1, 32), _draw(s + 2, len(d) + 1)) if d else d,
}


def placed_rewrites(data: bytes) -> Iterator[tuple[str, int, int, bytes]]:
    """(kind, place, parameter, data): every rewrite that is fixed by its place, its width and a number."""
    for width in (1, 2, 4):
        yield from ((f"bit_flip_{width}", at, 0, flip_bits(data, at, width)) for at in range(8 * len(data) - width + 1))
        yield from ((f"byte_flip_{width}", at, 0, flip_bytes(data, at, width)) for at in range(len(data) - width + 1))
    for size in (2, 4):
        yield from ((f"swap_{size}", at, 0, swap_bytes(data, at, size)) for at in range(len(data) - size + 1))
    for bits in (8, 16, 32):
        for at in range(len(data) - bits // 8 + 1):
            yield from ((f"arith_{bits}", at, d, add_at(data, at, d, bits)) for d in range(-35, 36) if d)
            yield from ((f"interesting_{bits}_{order}", at, x, put_at(data, at, x, bits, order)) for order in ("big", "little") for x in INTERESTING[bits])


def rewrites(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, kind, place, number, data): placed_rewrites of each text, streamed row by row."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, text in zip(batch.iloc[:, 0], batch.iloc[:, 1]):
                out = [(key, *x) for x in placed_rewrites((text or "").encode())]
                yield pd.DataFrame(out, columns=[id_col, "kind", "place", "number", "data"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col), F.col(text_col)).mapInPandas(made, f"`{id_col}` {kind}, kind string, place int, number long, data binary")


def rewritten_texts(rows: DataFrame, id_col: str, text_col: str, rewrite: Callable[[str], list[tuple[str, str]]]) -> DataFrame:
    """(id, kind, text) of a rewrite of whole texts, such as json_variants or xml_variants; null texts have none."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(s, *x) for s, t in zip(b.iloc[:, 0], b.iloc[:, 1]) if t is not None for x in rewrite(t)], columns=[id_col, "kind", "text"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col), F.col(text_col)).mapInPandas(made, f"`{id_col}` {kind}, kind string, text string")


def json_fields(values: DataFrame, json_col: str, words: DataFrame) -> DataFrame:
    """(json, key, variant): flat JSON objects with each field in turn replaced by each word of the caller's list."""
    fields = values.select(json_col, F.from_json(json_col, "map<string,string>").alias("m")).where(F.col("m").isNotNull())
    one = fields.select(json_col, "m", F.explode(F.map_keys("m")).alias("key"))
    listed = gathered(words.where("word is not null").distinct(), "word")
    each = one.withColumn("w", listed).select(json_col, "m", "key", F.explode("w").alias("w"))
    return each.select(json_col, "key", F.to_json(F.transform_values("m", lambda k, x: F.when(k == F.col("key"), F.col("w")).otherwise(x))).alias("variant"))


def variants(rows: DataFrame, id_col: str, data_col: str, n: int, seed: int = 0, mutators: dict[str, Callable[[bytes, int], bytes]] | None = None, chain: int = 1, probability: float = 1.0, strategy: Callable[[int, list[str]], str] | None = None) -> DataFrame:
    """(id, k, mutator, data): n seeded variants of each input, each after a chain of rewrites; the last rewrite that changed it gives the name.

    probability: of each rewrite taking place. strategy: picks a name from a seed and the names, instead of a uniform draw.
    """
    table_ = dict(mutators or MUTATORS)
    names = sorted(table_)

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, data in zip(batch.iloc[:, 0], batch.iloc[:, 1]):
                raw = b"" if data is None else bytes(data) if not isinstance(data, str) else data.encode()
                for k in range(n):
                    value, last = raw, ""
                    for c in range(chain):
                        s = int.from_bytes(hashlib.sha256(f"{seed}/{key}/{k}/{c}".encode()).digest()[:6], "big")
                        if _draw(s + 7, 1 << 30) >= probability * (1 << 30):
                            continue
                        name = strategy(s, names) if strategy else names[_draw(s, len(names))]
                        new = table_[name](value, s + 1)
                        last = name if new != value else last
                        value = new
                    out.append((key, k, last, value))
            yield pd.DataFrame(out, columns=[id_col, "k", "mutator", "data"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, data_col).mapInPandas(made, f"`{id_col}` {kind}, k int, mutator string, data binary")


def bit_flips(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, bit, data) for every bit of every input, natively: the byte at the position, exclusive-or its mask."""
    bits = rows.select(id_col, F.encode(text_col, "UTF-8").alias("d")).where(F.octet_length("d") > 0)
    one = bits.select(id_col, "d", F.explode(F.sequence(F.lit(0), F.octet_length("d") * 8 - 1)).alias("bit"))
    byte = F.conv(F.hex(F.expr("substring(d, bit div 8 + 1, 1)")), 16, 10).cast("int")
    new = F.unhex(F.lpad(F.hex(byte.bitwiseXOR(F.expr("shiftright(128, bit % 8)"))), 2, "0"))
    head, tail = F.expr("substring(d, 1, bit div 8)"), F.expr("substring(d, bit div 8 + 2, length(d))")
    return one.select(id_col, "bit", F.concat(head, new, tail).alias("data"))


def boundary_values(values: DataFrame, value_col: str, detector: Callable[[Column], Column] = inferred_type) -> DataFrame:
    """(value, kind, boundary): the boundary values of each value's type, inferred or by the caller's detector; other types get those of strings."""
    kind = detector(F.col(value_col))
    kind = F.when(kind.isin(*BOUNDARIES), kind).otherwise("string")
    lists = F.create_map(*[x for k, v in BOUNDARIES.items() for x in (F.lit(k), F.array(*[F.lit(b) for b in v]))])
    return values.select(value_col, kind.alias("kind")).select(value_col, "kind", F.explode(F.element_at(lists, F.col("kind"))).alias("boundary"))


def integer_variants(values: DataFrame, value_col: str, reach: int = 35) -> DataFrame:
    """(value, variant) for integer texts: every delta up to reach, and the interesting integers."""
    n = F.col(value_col).cast("bigint")
    near = F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda d: (n + d).cast("string"))
    fixed = F.array(*[F.lit(str(x)) for xs in INTERESTING.values() for x in xs])
    return values.where(F.col(value_col).rlike("^-?[0-9]{1,18}$")).select(value_col, F.explode(F.concat(near, fixed)).alias("variant"))


def dictionary_variants(values: DataFrame, value_col: str, words: DataFrame) -> DataFrame:
    """(value, mode, variant): each entry of the caller's list in place of the value, behind and before it; the list is gathered once."""
    listed = gathered(words.where("word is not null"), "word")
    one = values.withColumn("__words", listed).select(value_col, F.explode("__words").alias("w"))
    v = F.col(value_col)
    forms = F.array(F.struct(F.lit("replace").alias("mode"), F.col("w").alias("x")), F.struct(F.lit("append").alias("mode"), F.concat(v, "w").alias("x")), F.struct(F.lit("prepend").alias("mode"), F.concat("w", v).alias("x")))
    return one.select(value_col, F.explode(forms).alias("f")).select(value_col, F.col("f.mode").alias("mode"), F.col("f.x").alias("variant"))


def mixed_scripts(text: Column) -> Column:
    """Whether a word mixes Latin letters with look-alikes of other scripts: the detectable inverse of a homoglyph rewrite."""
    return text.rlike(r"[A-Za-z][\p{IsCyrillic}\p{IsGreek}]|[\p{IsCyrillic}\p{IsGreek}][A-Za-z]")


def hidden_marks(text: Column) -> Column:
    """Whether a text holds zero-width or direction marks."""
    return text.rlike("[\\u200B-\\u200F\\u202A-\\u202E\\u2060\\uFEFF]")


def unicode_variants(text: Column) -> Column:
    """Rewrites with a look-alike letter, a direction mark before the text, and a zero-width mark inside it."""
    half = F.floor(F.length(text) / 2).cast("int")
    inside = F.concat(F.substring(text, F.lit(1), half), F.lit("\u200b"), F.substring(text, half + 1, F.length(text)))
    half_nul = F.concat(F.substring(text, F.lit(1), half), F.lit("\x00"), F.substring(text, half + 1, F.length(text)))
    forms = {"homoglyph": F.regexp_replace(text, "^([^a]*)a", "$1\u0430"), "direction": F.concat(F.lit("\u200f"), text), "zero_width": inside, "nul": half_nul}
    return F.array(*[F.struct(F.lit(kind).alias("kind"), new.alias("text")) for kind, new in forms.items()])


def tasks(targets: DataFrame, url_col: str, payloads: list[str]) -> DataFrame:
    """(url, kind, payload, priority): one test per payload (5), one crawl (10), one verification (8)."""
    kinds = [F.struct(F.lit("test").alias("kind"), F.lit(p).alias("payload"), F.lit(5).alias("priority")) for p in payloads]
    kinds += [F.struct(F.lit("crawl").alias("kind"), F.lit(None).cast("string").alias("payload"), F.lit(10).alias("priority")), F.struct(F.lit("verify").alias("kind"), F.lit(None).cast("string").alias("payload"), F.lit(8).alias("priority"))]
    return targets.select(url_col, F.explode(F.array(*kinds)).alias("t")).select(url_col, "t.kind", "t.payload", "t.priority")


def _sql(text: str) -> str:
    """A text as a DuckDB expression; long runs and control characters are spelled out."""
    parts = re.findall(r"(?s)([\x00-\x1f\ufeff])|((.)\3{59,})|((?:(?!(.)\5{59,})[^\x00-\x1f\ufeff])+)", text)
    made = [f"chr({ord(p[0])})" if p[0] else f"repeat('{p[2]}', {len(p[1])})" if p[1] else "'" + p[3].replace("'", "''") + "'" for p in parts]
    return " || ".join(made) or "''"


_QUOTED = {k: ", ".join(f"('{k}', {_sql(b)})" for b in v) for k, v in BOUNDARIES.items()}


@R.query("boundary_values_by_type", "WITH b AS (SELECT * FROM (VALUES " + ", ".join(_QUOTED.values()) + ") v(kind, boundary)), x AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS v, CASE WHEN length(CAST(user_id AS VARCHAR)) % 4 = 0 THEN 'string' WHEN length(CAST(user_id AS VARCHAR)) % 2 = 0 THEN 'string' ELSE 'integer' END AS kind FROM events UNION ALL SELECT DISTINCT 'u' || user_id || '@x.org', 'email' FROM events) SELECT x.v, x.kind, boundary FROM x JOIN b USING (kind)")
def boundary_values_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "events").select("user_id").distinct()
    values = ids.select(F.explode(F.array(F.col("user_id").cast("string"), F.concat(F.lit("u"), "user_id", F.lit("@x.org")))).alias("v"))
    return boundary_values(values, "v")


@R.query("interesting_int_variants", "WITH v AS (SELECT DISTINCT user_id FROM events) SELECT CAST(user_id AS VARCHAR) AS v, CAST(user_id + d AS VARCHAR) AS variant FROM v, range(-35, 36) r(d) UNION ALL SELECT CAST(user_id AS VARCHAR), CAST(i AS VARCHAR) FROM v, (SELECT unnest([" + ", ".join(str(x) for xs in INTERESTING.values() for x in xs) + "]) AS i)")
def interesting_int_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integer_variants(table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("v")).distinct(), "v")


@R.query("bit_flip_variants", "WITH b AS (SELECT DISTINCT hex(encode(event_type)) AS h, event_type AS v FROM events) SELECT v, CAST(bit AS INTEGER) AS bit, substr(h, 1, bit // 8 * 2) || printf('%02X', xor(CAST('0x' || substr(h, bit // 8 * 2 + 1, 2) AS INTEGER), 128 >> CAST(bit % 8 AS INTEGER))) || substr(h, bit // 8 * 2 + 3) AS data FROM (SELECT v, h, unnest(range(0, length(h) * 4)) AS bit FROM b)")
def bit_flip_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_flips(table(spark, sf_dir, "events").select(F.col("event_type").alias("v")).distinct(), "v", "v").select("v", "bit", F.hex("data").alias("data"))


@R.query("dictionary_variants", "WITH v AS (SELECT DISTINCT source AS v FROM documents), w AS (SELECT DISTINCT lang AS w FROM documents) SELECT v, 'replace' AS mode, w AS variant FROM v, w UNION ALL SELECT v, 'append', v || w FROM v, w UNION ALL SELECT v, 'prepend', w || v FROM v, w")
def dictionary_variants_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return dictionary_variants(d.select(F.col("source").alias("v")).distinct(), "v", d.select(F.col("lang").alias("word")).distinct())


@R.query("generated_tasks", "SELECT url, kind, payload, priority FROM pages, (VALUES ('test', 'p1', 5), ('test', 'p2', 5), ('crawl', NULL, 10), ('verify', NULL, 8)) t(kind, payload, priority)")
def generated_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks(table(spark, sf_dir, "pages"), "url", ["p1", "p2"])


@R.query("seeded_variants")
def seeded_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "pages"), "page_id", "url", n=4, chain=2)


_EVENT_JSON_SQL = """e AS (SELECT event_id AS seq, event_type AS t, props->>'$.k' AS k FROM events)"""


@R.query("json_variants", f"""WITH {_EVENT_JSON_SQL} SELECT seq, 'type' AS kind, '{{"k":"' || k || '"}}' AS text FROM e UNION ALL SELECT seq, 'key', '{{"K":' || k || '}}' FROM e UNION ALL SELECT seq, 'value', '{{"k":null}}' FROM e
UNION ALL SELECT seq, 'structure', '{{"data":{{"k":' || k || '}}}}' FROM e UNION ALL SELECT seq, 'array', '[{{"k":' || k || '}}]' FROM e""")
def json_variants_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewritten_texts(table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "props"), "seq", "props", json_variants)


@R.query("json_key_variants", f"""WITH {_EVENT_JSON_SQL} SELECT seq, 'type' AS kind, '{{"a":' || length(t) || ',"b":' || k || '}}' AS text FROM e UNION ALL SELECT seq, 'key', '{{"A":"' || t || '","b":' || k || '}}' FROM e UNION ALL SELECT seq, 'value', '{{"a":null,"b":' || k || '}}' FROM e
UNION ALL SELECT seq, 'type/b', '{{"a":"' || t || '","b":"' || k || '"}}' FROM e UNION ALL SELECT seq, 'key/b', '{{"B":' || k || ',"a":"' || t || '"}}' FROM e UNION ALL SELECT seq, 'value/b', '{{"a":"' || t || '","b":null}}' FROM e
UNION ALL SELECT seq, 'structure', '{{"data":{{"a":"' || t || '","b":' || k || '}}}}' FROM e UNION ALL SELECT seq, 'array', '[{{"a":"' || t || '","b":' || k || '}}]' FROM e""")
def json_key_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of two keys, the second one first in the text."""
    text = F.concat(F.lit('{"b": '), F.get_json_object("props", "$.k"), F.lit(', "a": "'), "event_type", F.lit('"}'))
    return rewritten_texts(table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), text.alias("x")), "seq", "x", json_variants)


@R.query("xml_variants", """WITH x AS (SELECT doc_id AS seq, lang AS l, source AS s FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL)
SELECT seq, 'tag' AS kind, '<ROW id="' || s || '">' || l || '<b/></row>' AS text FROM x UNION ALL SELECT seq, 'attribute', '<row id="' || s || '" test="1">' || l || '<b/></row>' FROM x
UNION ALL SELECT seq, 'cdata', '<row id="' || s || '"><![CDATA[' || l || ']]><b/></row>' FROM x UNION ALL SELECT seq, 'entity', '<!DOCTYPE row [<!ENTITY own "value">]><row id="' || s || '">&own;<b/></row>' FROM x""")
def xml_variants_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('<row id="'), "source", F.lit('">'), "lang", F.lit("<b/></row>"))
    return rewritten_texts(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), text.alias("x")), "seq", "x", lambda t: xml_variants(t, ("own", "value")))


_NUMBERS_SQL = {bits: ", ".join(f"({x % (1 << bits)}::HUGEINT, {x})" for x in xs) for bits, xs in INTERESTING.items()}


def _rewrites_sql() -> str:
    """Texts of place most eight bytes as numbers: flips are an exclusive or, sums and values replace a window."""
    flips = [f"SELECT v, n, 'bit_flip_{w}' AS kind, place, 0 AS number, xor(x, (({1 << w} - 1)::HUGEINT * p[8 * n - place - {w} + 1])) AS y FROM (SELECT *, unnest(range(8 * n - {w} + 1)) AS place FROM t WHERE 8 * n >= {w})" for w in (1, 2, 4)]
    flips += [f"SELECT v, n, 'byte_flip_{w}', place, 0, xor(x, {(1 << 8 * w) - 1}::HUGEINT * p[8 * (n - place - {w}) + 1]) FROM (SELECT *, unnest(range(n - {w} + 1)) AS place FROM t WHERE n >= {w})" for w in (1, 2, 4)]
    window = lambda w: f"(SELECT *, (x // p[8 * (n - place - {w}) + 1]) % {1 << 8 * w} AS own, p[8 * (n - place - {w}) + 1] AS unit FROM (SELECT *, unnest(range(n - {w} + 1)) AS place FROM t WHERE n >= {w}))"
    turned = lambda own, w: " + ".join(f"(({own}) // {1 << 8 * k} % 256) * {1 << 8 * (w - 1 - k)}" for k in range(w))
    flips += [f"SELECT v, n, 'swap_{w}', place, 0, x + ({turned('own', w)} - own) * unit FROM {window(w)}" for w in (2, 4)]
    for w in (1, 2, 4):
        flips.append(f"SELECT v, n, 'arith_{8 * w}', place, d, x + ((own + d + {1 << 8 * w}) % {1 << 8 * w} - own) * unit FROM {window(w)}, range(-35, 36) r(d) WHERE d <> 0")
        flips.append(f"SELECT v, n, 'interesting_{8 * w}_big', place, number, x + (i - own) * unit FROM {window(w)}, (VALUES {_NUMBERS_SQL[8 * w]}) i(i, number)")
        flips.append(f"SELECT v, n, 'interesting_{8 * w}_little', place, number, x + ({turned('i', w)} - own) * unit FROM {window(w)}, (VALUES {_NUMBERS_SQL[8 * w]}) i(i, number)")
    powers = "[" + ", ".join(f"{1 << k}::HUGEINT" for k in range(65)) + "]"
    return f"""WITH t AS (SELECT v, octet_length(encode(v)) AS n, CAST('0x' || hex(encode(v)) AS HUGEINT) AS x, {powers} AS p FROM (SELECT DISTINCT event_type AS v FROM events) WHERE octet_length(encode(v)) BETWEEN 1 AND 8)
SELECT v, kind, CAST(place AS INTEGER) AS place, CAST(number AS BIGINT) AS number, lpad(hex(CAST(y AS UBIGINT)), CAST(2 * n AS INTEGER), '0') AS data FROM ({' UNION ALL '.join(flips)})"""


@R.query("byte_rewrites", _rewrites_sql())
def byte_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every placed rewrite of the event types of place most eight bytes, so that SQL can hold a text as a number."""
    v = table(spark, sf_dir, "events").select(F.col("event_type").alias("v")).distinct().where(F.octet_length("v").between(1, 8))
    return rewrites(v, "v", "v").select("v", "kind", "place", "number", F.hex("data").alias("data"))


@R.query("unicode_rewrites", """WITH v AS (SELECT DISTINCT source AS v FROM documents WHERE source IS NOT NULL), h AS (SELECT v, length(v) // 2 AS h FROM v)
SELECT v, 'homoglyph' AS kind, hex(encode(regexp_replace(v, 'a', chr(1072)))) AS data FROM v UNION ALL SELECT v, 'direction', hex(encode(chr(8207) || v)) FROM v
UNION ALL SELECT v, 'zero_width', hex(encode(left(v, h) || chr(8203) || substr(v, h + 1))) FROM h UNION ALL SELECT v, 'nul', hex(encode(left(v, h))) || '00' || hex(encode(substr(v, h + 1))) FROM h""")
def unicode_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "documents").select(F.col("source").alias("v")).where("v is not null").distinct()
    return v.select("v", F.explode(unicode_variants(F.col("v"))).alias("x")).select("v", F.col("x.kind").alias("kind"), F.hex(F.encode("x.text", "UTF-8")).alias("data"))


@R.query("json_field_variants", """WITH e AS (SELECT DISTINCT event_type AS t, user_id % 10 AS u FROM events), w AS (SELECT DISTINCT lang AS w FROM documents WHERE lang IS NOT NULL)
SELECT '{"a":"' || t || '","b":"' || u || '"}' AS doc, 'a' AS key, '{"a":"' || w || '","b":"' || u || '"}' AS variant FROM e, w UNION ALL SELECT '{"a":"' || t || '","b":"' || u || '"}', 'b', '{"a":"' || t || '","b":"' || w || '"}' FROM e, w""")
def json_field_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.concat(F.lit('{"a":"'), "event_type", F.lit('","b":"'), (F.col("user_id") % 10).cast("string"), F.lit('"}'))
    values = table(spark, sf_dir, "events").select(doc.alias("doc")).distinct()
    return json_fields(values, "doc", table(spark, sf_dir, "documents").select(F.col("lang").alias("word")))


@R.query("unicode_marks", "SELECT kind, count(*) AS n, count(*) FILTER (kind <> 'homoglyph') AS hidden FROM documents, (VALUES ('homoglyph'), ('direction'), ('zero_width')) v(kind) GROUP BY 1")
def unicode_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "documents").select(F.explode(unicode_variants(F.col("source"))).alias("v")).where("v.kind <> 'nul'")
    return v.groupBy(F.col("v.kind").alias("kind")).agg(F.count("*").alias("n"), F.count_if(hidden_marks(F.col("v.text"))).alias("hidden"))
