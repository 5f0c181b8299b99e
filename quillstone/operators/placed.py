"""Rewrites of byte strings at every place, as column expressions: flips, big-endian arithmetic, swaps, deletions, insertions, clones.

Each place of a value has an array of the variants that fit there; nothing is random but what a hash of (seed, id,
place) draws, so a task that runs again makes the same rows. Everything is substring, hex and concat on binary columns: no Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import Registry
from ..shared import dealt
from ..views import table

R = Registry()

#: Widths in bytes, the largest delta, and the sizes that are deleted, inserted and cloned.
WIDTHS, DELTA, SWAPS, DELETED, INSERTED, CLONED = (1, 2, 4), 35, (2, 4), (1, 2, 4, 8, 16), (1, 4, 16), (1, 8, 32)


class Place:
    """A value's bytes around place k (from 0): pieces and the number that stands there, most significant byte first."""

    def __init__(self, data: Column, k: Column):
        self.data, self.k, self.n = data, k, F.octet_length(data)

    def fits(self, width: int | Column) -> Column:
        return self.k + width <= self.n

    def piece(self, start: Column, size: Column) -> Column:
        return F.substring(self.data, start + 1, size)

    def own(self, width: int) -> Column:
        return self.piece(self.k, F.lit(width))

    def number(self, width: int) -> Column:
        return F.conv(F.hex(self.own(width)), 16, 10).cast("long")

    def replaced(self, width: int, new: Column) -> Column:
        return F.concat(self.piece(F.lit(0), self.k), new, self.piece(self.k + width, self.n))

    def put(self, width: int, value: Column) -> Column:
        """The number in place, wrapped around."""
        return self.replaced(width, digits(width, value))


def digits(width: int, value: Column) -> Column:
    """A number as width bytes, wrapped around."""
    return F.unhex(F.lpad(F.hex(F.pmod(value, F.lit(1 << 8 * width))), 2 * width, "0"))


def _drawn(seed: int, id_col: str, k: Column, what: str) -> Column:
    """Sixteen bytes, in hex, that belong to a seed, an id and a place."""
    return F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(id_col).cast("string"), k.cast("string"), F.lit(what)))


#: Rewrites that belong to a place.
PLACED = ("byte_flip", "add", "swap", "random_byte", "delete", "insert", "clone")


def rewrites_at(mutator: str, data: Column, k: Column, id_col: str, seed: int = 0, delta: int = DELTA) -> Column:
    """A mutator's rewrites of a value that fit at place k: an array of (place, size, delta, variant) in order of size and delta."""
    p, delta = Place(data, k), max(0, delta)

    def row(size: int, d: Column, variant: Column) -> Column:
        return F.struct(p.k.alias("place"), F.lit(size).alias("size"), d.cast("int").alias("delta"), variant.alias("variant"))

    def fitting(forms: dict[int, Column]) -> Column:
        return F.array_compact(F.array(*[F.when(p.fits(size), row(size, F.lit(0), form)) for size, form in forms.items()]))

    def added(width: int) -> Column:
        # the number in place and what stands before and behind it are bound once for all deltas
        at = F.struct(p.number(width).alias("own"), p.piece(F.lit(0), p.k).alias("before"), p.piece(p.k + width, p.n).alias("behind"))
        put = lambda at, x: F.concat(at["before"], digits(width, x), at["behind"])
        around = lambda at: F.transform(F.sequence(at["own"] - delta, at["own"] + delta), lambda x, j: row(width, j - delta, put(at, x)))
        return F.filter(F.flatten(F.transform(F.array(at), around)), lambda x: x["delta"] != 0)

    drawn = lambda what: _drawn(seed, id_col, p.k, what)
    if mutator == "byte_flip":
        return fitting({w: p.put(w, F.lit((1 << 8 * w) - 1) - p.number(w)) for w in WIDTHS})
    if mutator == "add":
        return F.flatten(F.array_compact(F.array(*[F.when(p.fits(w), added(w)) for w in WIDTHS])))
    if mutator == "swap":
        return fitting({w: p.replaced(w, F.concat(*[p.piece(p.k + j, F.lit(1)) for j in reversed(range(w))])) for w in SWAPS})
    if mutator == "random_byte":
        return fitting({1: p.replaced(1, F.unhex(F.substring(drawn("byte"), 1, 2)))})
    if mutator == "delete":
        return fitting({w: p.replaced(w, F.unhex(F.lit(""))) for w in DELETED})
    if mutator == "insert":
        return F.array(*[row(w, F.lit(0), p.replaced(0, F.unhex(F.substring(drawn("insert"), 1, 2 * w)))) for w in INSERTED])
    to = F.pmod(F.conv(F.substring(drawn("clone"), 1, 8), 16, 10).cast("long"), (p.n + 1).cast("long")).cast("int")
    return fitting({w: F.concat(p.piece(F.lit(0), to), p.own(w), p.piece(to, p.n)) for w in CLONED})


def text_rewrites(data: Column, deltas: Iterable[int]) -> Column:
    """As rewrites_at, without a place: an integer in ASCII, of up to 37 digits, with each delta added; null for other values."""
    text = data.cast("string")
    number = F.when(text.rlike(r"^[+-]?[0-9]{1,37}$"), text.cast("decimal(38,0)"))

    def row(d: Column) -> Column:
        variant = F.encode((number + d).cast("decimal(38,0)").cast("string"), "UTF-8")
        return F.struct(F.lit(None).cast("int").alias("place"), F.lit(0).alias("size"), d.alias("delta"), variant.alias("variant"))

    return F.when(number.isNotNull(), F.transform(F.array(*map(F.lit, deltas)).cast("array<int>"), row))


def placed_variants(values: DataFrame, id_col: str, data_col: str, seed: int = 0, delta: int = DELTA) -> DataFrame:
    """(id, mutator, size, delta, place, variant): every rewrite that fits at every place of every value.

    byte_flip, add (delta from -delta to delta without 0) and swap replace size bytes; random_byte replaces one; delete takes
    size bytes away; insert puts drawn ones in; clone copies size bytes from the place to a drawn one. Null and empty values have none
    of them; text_add, for values that are integers in ASCII, has no place. No more than the rewrites of one place are made at a time.
    """
    data = F.col(data_col).cast("binary")
    rows = values.select(id_col, data.alias("__d")).where(F.octet_length("__d") > 0)
    rows = rows.select(id_col, "__d", F.explode(F.sequence(F.lit(0), F.octet_length("__d") - 1)).alias("__k"))
    made = {m: rewrites_at(m, F.col("__d"), F.col("__k"), id_col, seed, delta) for m in PLACED}
    listed = [F.struct(F.lit(m).alias("mutator"), x.alias("__made")) for m, x in made.items()]
    rows = rows.select(id_col, F.inline(F.array(*listed)))
    bytewise = rows.select(id_col, "mutator", F.inline("__made")).select(id_col, "mutator", "size", "delta", "place", "variant")
    return bytewise.unionByName(text_added(values, id_col, data_col, [d for d in range(-delta, delta + 1) if d]))


def text_added(values: DataFrame, id_col: str, data_col: str, deltas: Iterable[int]) -> DataFrame:
    """The values that are integers in ASCII, each with each delta added; numbers of up to 37 digits."""
    listed = values.select(id_col, F.lit("text_add").alias("mutator"), F.inline(text_rewrites(F.col(data_col), deltas)))
    return listed.select(id_col, "mutator", "size", "delta", "place", "variant")


#: Bytes of a table whose values one task rewrites: a value of 18 bytes has some 4,000 rewrites.
PART = 1 << 15


def placed_digests(values: DataFrame, id_col: str, data_col: str, seed: int = 0, delta: int = DELTA) -> DataFrame:
    """(id, mutator, n, digest): how many rewrites the values of an id have, and the MD5 of all, in hex, by place, size and delta.

    Values are shuffled (dealt by the caller, or by id), their rewrites, thousands for each, are not: they are made, listed and
    digested where the id's values are, one mutator at a time. An id with several values has their rewrites in one order.
    """
    values = values.select(id_col, F.col(data_col).cast("binary").alias("__d"))
    owned = values.where(F.octet_length("__d") > 0).groupBy(id_col).agg(F.collect_list("__d").alias("__own"))
    deltas = [d for d in range(-delta, delta + 1) if d]

    def placed(mutator: str) -> Callable[[Column], Column]:
        return lambda v: F.flatten(F.transform(F.sequence(F.lit(0), F.octet_length(v) - 1), lambda k: rewrites_at(mutator, v, k, id_col, seed, delta)))

    def digested(made: Callable[[Column], Column]) -> Column:
        # each array of one value binds what the next step uses more than once
        listed = F.transform(F.array(F.flatten(F.array_compact(F.transform("__own", made)))), lambda x: F.when(F.size("__own") > 1, F.sort_array(x)).otherwise(x))
        digest = lambda x: F.md5(F.array_join(F.transform(x, lambda r: F.hex(r["variant"])), ","))
        return F.get(F.transform(listed, lambda x: F.struct(F.size(x).cast("long").alias("n"), digest(x).alias("digest"))), F.lit(0))

    kinds = {m: digested(placed(m)) for m in PLACED} | {"text_add": digested(lambda v: text_rewrites(v, deltas))}
    rows = owned.select(id_col, "__own", F.explode(F.array(*map(F.lit, kinds))).alias("mutator"))
    made = F.lit(None).cast("struct<n:bigint,digest:string>")
    for mutator, form in kinds.items():
        made = F.when(F.col("mutator") == mutator, form).otherwise(made)
    # the added 0 is formally not deterministic, so that the filter on n is not pushed below, where it would make the lists again
    made = rows.select(id_col, "mutator", made.alias("__made")).select(id_col, "mutator", (F.col("__made.n") + F.monotonically_increasing_id() % 1).alias("n"), "__made.digest")
    return made.where("n > 0")


def _placed_sql() -> str:
    """Every variant in hex, from the hex digits of each value; per id and mutator how many, and the digest of all in order."""
    at, num = "substr(x, 2 * k + 1, {w2})", "CAST('0x' || substr(x, 2 * k + 1, {w2}) AS BIGINT)"
    around = lambda w, new: f"left(x, 2 * k) || {new} || substr(x, 2 * (k + {w}) + 1)"
    put = lambda w, v: around(w, f"lpad(printf('%X', (({v}) % {1 << 8 * w} + {1 << 8 * w}) % {1 << 8 * w}), {2 * w}, '0')")
    drawn = lambda what: f"md5('0/' || id || '/' || k || '/{what}')"
    parts = []
    for w in WIDTHS:
        n = num.format(w2=2 * w)
        parts.append(f"SELECT id, 'byte_flip' AS mutator, {w} AS size, 0 AS delta, k, {put(w, f'{(1 << 8 * w) - 1} - {n}')} AS v FROM p WHERE k + {w} <= n")
        parts.append(f"SELECT id, 'add', {w}, d, k, {put(w, f'{n} + d')} FROM p, (SELECT d FROM range(-{DELTA}, {DELTA + 1}) r(d) WHERE d <> 0) WHERE k + {w} <= n")
    for w in SWAPS:
        parts.append(f"SELECT id, 'swap', {w}, 0, k, {around(w, ' || '.join(f'substr(x, 2 * (k + {j}) + 1, 2)' for j in reversed(range(w))))} FROM p WHERE k + {w} <= n")
    byte = f"upper(left({drawn('byte')}, 2))"
    parts.append(f"SELECT id, 'random_byte', 1, 0, k, {around(1, byte)} FROM p")
    parts += [f"SELECT id, 'delete', {w}, 0, k, left(x, 2 * k) || substr(x, 2 * (k + {w}) + 1) FROM p WHERE k + {w} <= n" for w in DELETED]
    parts += [f"SELECT id, 'insert', {w}, 0, k, left(x, 2 * k) || upper(left({drawn('insert')}, {2 * w})) || substr(x, 2 * k + 1) FROM p" for w in INSERTED]
    parts += [f"SELECT id, 'clone', {w}, 0, k, left(x, 2 * t) || {at.format(w2=2 * w)} || substr(x, 2 * t + 1) FROM (SELECT *, CAST('0x' || left({drawn('clone')}, 8) AS BIGINT) % (n + 1) AS t FROM p) WHERE k + {w} <= n" for w in CLONED]
    parts.append(f"SELECT id, 'text_add', 0, d, NULL, hex(encode(CAST(CAST(s AS HUGEINT) + d AS VARCHAR))) FROM v, (SELECT d FROM range(-{DELTA}, {DELTA + 1}) r(d) WHERE d <> 0) WHERE regexp_full_match(s, '[+-]?[0-9]+')")
    return f"""WITH v AS (SELECT CAST(s_suppkey AS BIGINT) AS id, s_name AS s FROM supplier UNION ALL SELECT 1000000 + s_suppkey, CAST(s_suppkey * 7919 AS VARCHAR) FROM supplier),
p AS (SELECT id, hex(encode(s)) AS x, octet_length(encode(s)) AS n, unnest(range(0, octet_length(encode(s)))) AS k FROM v), made AS ({' UNION ALL '.join(parts)})
SELECT id, mutator, count(*) AS n, md5(string_agg(v, ',' ORDER BY k, size, delta)) AS digest FROM made GROUP BY 1, 2"""


@R.query("placed_rewrites", _placed_sql())
def placed_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rewrites of suppliers' names and of numbers, counted and digested by value and mutator."""
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey").cast("long")
    values = s.select(key.alias("id"), F.col("s_name").alias("v")).unionByName(s.select((key + 1_000_000).alias("id"), (key * 7919).cast("string").alias("v")))
    return placed_digests(dealt(values, PART, F.col("id")), "id", "v")
