"""JSON paths with arrays, queries, wildcards and modifiers, compiled to columns over variants.

A path is keys and places joined by dots: `a.b.0`. `#` is every element of an array (at the end: their number), `#(n>1)` the first
element that a comparison holds for, `#(n>1)#` all of them; `*` and `?` in a key stand for any characters and one; `@name`
applies a modifier. A dot behind `#` goes on inside each element, a bar with the whole. A backslash takes the next
character as it is.

The path is parsed once, on the driver; what reaches the executors is one expression of variant_get, transform and filter, without
Python. Variants hold objects with their keys in order, so objects are rendered compactly and in that order, and a
wildcard meets keys in that order.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.similarity import let
from ..registry import Registry
from ..shared import dealt
from ..views import table

R = Registry()


class PathError(ValueError):
    """A path that does not follow the syntax."""


@dataclass(frozen=True)
class Step:
    """kind: key, wild, each, query or modifier; piped: it is applied to the whole before it, not to each element."""

    kind: str
    name: str = ""
    piped: bool = False
    every: bool = False
    left: tuple[Step, ...] = ()
    op: str = ""
    right: object = None


_OPS = ("==", "!=", "<=", ">=", "!%", "=", "<", ">", "%")
_WILD = re.compile(r"(?<!\\)[*?]")


def parse_path(path: str) -> tuple[Step, ...]:
    """The steps of a path."""
    if not path:
        raise PathError("the path is empty")
    steps, place, piped = [], 0, False
    while place <= len(path):
        step, place = _step(path, place, piped)
        steps.append(step)
        if place == len(path):
            return tuple(steps)
        if path[place] not in ".|":
            raise PathError(f"{path!r}: no separator at {place}")
        piped, place = path[place] == "|", place + 1
    raise PathError(f"{path!r} ends with a separator")


def _step(path: str, place: int, piped: bool) -> tuple[Step, int]:
    if path.startswith("#(", place):
        inner, end = _inside(path, place + 1)
        left, op, right = _comparison(inner)
        every = path.startswith("#", end)
        return Step("query", piped=piped, every=every, left=left, op=op, right=right), end + every
    end = place
    while end < len(path) and path[end] not in ".|":
        end += 2 if path[end] == "\\" else 1
    raw = path[place : min(end, len(path))]
    if not raw:
        raise PathError(f"{path!r}: nothing between separators at {place}")
    if raw == "#":
        return Step("each", piped=piped), end
    if raw.startswith("@"):
        if raw[1:] not in MODIFIERS:
            raise PathError(f"no modifier {raw!r}")
        return Step("modifier", raw[1:], piped), end
    if _WILD.search(raw):
        return Step("wild", raw, piped), end
    return Step("key", re.sub(r"\\(.)", r"\1", raw), piped), min(end, len(path))


def _inside(path: str, place: int) -> tuple[str, int]:
    """What stands between the bracket at place and the one that closes it, and the place behind."""
    depth, quoted, k = 0, False, place
    while k < len(path):
        c = path[k]
        if c == "\\":
            k += 1
        elif c == '"':
            quoted = not quoted
        elif not quoted and c == "(":
            depth += 1
        elif not quoted and c == ")":
            depth -= 1
            if not depth:
                return path[place + 1 : k], k + 1
        k += 1
    raise PathError(f"{path!r}: a bracket is left open")


def _comparison(text: str) -> tuple[tuple[Step, ...], str, object]:
    quoted, depth = False, 0
    for k, c in enumerate(text):
        quoted ^= c == '"'
        depth += 0 if quoted else (c == "(") - (c == ")")
        op = next((o for o in _OPS if text.startswith(o, k)), None) if not quoted and not depth else None
        if op:
            left, right = text[:k].strip(), text[k + len(op) :].strip()
            try:
                value = json.loads(right)
            except ValueError:
                value = right
            return (parse_path(left) if left else ()), "==" if op == "=" else op, value
    return (parse_path(text.strip()) if text.strip() else ()), "", None


def like(pattern: str) -> str:
    """A pattern with * and ? as an anchored regular expression."""
    parts = re.findall(r"\\.|.", pattern, re.DOTALL)
    return "(?s)^" + "".join(".*" if p == "*" else "." if p == "?" else re.escape(p[-1]) for p in parts) + "$"


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _member(v: Column, key: str) -> Column:
    """An object's value of a key; keys that a variant path cannot quote are looked up in its map."""
    if any(c in key for c in "'\\]"):
        return F.try_element_at(_get(v, "$", "map<string,variant>"), F.lit(key))
    return _get(v, f"$['{key}']", "variant")


def _elements(v: Column) -> Column:
    return _get(v, "$", "array<variant>")


def _entries(v: Column) -> Column:
    return F.map_entries(_get(v, "$", "map<string,variant>"))


def _variant(x: Column) -> Column:
    return F.to_variant_object(x)


def _text(v: Column) -> Column:
    return _get(v, "$", "string")


def _is(v: Column, *kinds: str) -> Column:
    return F.schema_of_variant(v).rlike(f"^({'|'.join(kinds)})")


_NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")

#: What a modifier makes of a value; each value is bound to a name first, so that the path to it is followed once.
MODIFIERS: dict[str, Callable[[Column], Column]] = {
    "this": lambda v: v,
    "ugly": lambda v: v,
    "valid": lambda v: v,
    "reverse": lambda v: F.when(_is(v, "ARRAY"), _variant(F.reverse(_elements(v)))).otherwise(v),
    "keys": lambda v: F.when(_is(v, "OBJECT"), F.parse_json(F.to_json(F.transform(_entries(v), lambda e: e["key"])))).otherwise(F.parse_json(F.lit("[]"))),
    "values": lambda v: F.when(_is(v, "OBJECT"), _variant(F.transform(_entries(v), lambda e: e["value"]))).otherwise(v),
    "flatten": lambda v: F.when(_is(v, "ARRAY"), _variant(F.flatten(F.transform(_elements(v), lambda x: F.coalesce(_elements(x), F.array(x)))))).otherwise(v),
    "tostr": lambda v: _quoted(v),
    "fromstr": lambda v: F.try_parse_json(_text(v)),
}


def _quoted(v: Column) -> Column:
    """A value's JSON as a string value."""
    return _get(F.parse_json(F.to_json(F.struct(F.to_json(v).alias("s")))), "$.s", "variant")


def _holds(v: Column, step: Step) -> Column:
    if not step.op:
        return compiled(v, step.left).isNotNull()
    return let(compiled(v, step.left), lambda value: _compared(value, step))


def _compared(value: Column, step: Step) -> Column:
    right, op = step.right, step.op
    if op in ("%", "!%"):
        same = _is(value, "STRING") & _text(value).rlike(like(str(right)))
        return F.coalesce(same if op == "%" else _is(value, "STRING") & ~same, F.lit(False))
    if isinstance(right, bool) or right is None:
        word = {True: "true", False: "false", None: "null"}[right]
        same = F.to_json(value) == word
        return F.coalesce({"==": same, "!=": ~same}.get(op, F.lit(False)), F.lit(False))
    number = isinstance(right, (int, float))
    own = _get(value, "$", "double") if number else _text(value)
    fits = _is(value, *_NUMBERS) if number else _is(value, "STRING")
    compared = {"==": own == right, "!=": own != right, "<": own < right, "<=": own <= right, ">": own > right, ">=": own >= right}[op]
    return F.coalesce(F.when(fits, compared).otherwise(F.lit(op == "!=") & value.isNotNull()), F.lit(False))


def compiled(v: Column, steps: tuple[Step, ...]) -> Column:
    """The variant at the end of the steps from v; null where there is none."""
    if not steps:
        return v
    step, rest = steps[0], steps[1:]
    if step.kind == "key":
        if not step.name.isdigit():
            return compiled(_member(v, step.name), rest)
        place = int(step.name)
        return compiled(let(v, lambda x: F.coalesce(_get(x, f"$[{place}]", "variant"), _member(x, step.name))), rest)
    if step.kind == "wild":
        pattern = like(step.name)
        found = F.get(F.filter(_entries(v), lambda e: e["key"].rlike(pattern)), F.lit(0))["value"]
        return compiled(found, rest)
    if step.kind == "modifier":
        return compiled(let(v, lambda x: F.when(x.isNotNull(), MODIFIERS[step.name](x))), rest)
    if step.kind == "query" and not step.every:
        return compiled(F.get(F.filter(_elements(v), lambda x: _holds(x, step)), F.lit(0)), rest)
    cut = next((k for k, s in enumerate(rest) if s.piped), len(rest))  # up to a bar, steps go on inside each element
    inner, after = rest[:cut], rest[cut:]
    chosen = _elements(v)
    if step.kind == "query":
        chosen = F.filter(chosen, lambda x: _holds(x, step))
    elif not inner:
        return compiled(F.parse_json(F.size(chosen).cast("string")), after) if not after else compiled(_variant(chosen), after)
    if inner:
        chosen = F.filter(F.transform(chosen, lambda x: compiled(x, inner)), lambda x: x.isNotNull())
    return compiled(_variant(chosen), after)


def value_at(document: Column, path: str) -> Column:
    """The value at a path of a variant as text: strings bare, null empty, anything else as JSON; null where there is none."""
    # a type is made for quoted values alone: that of an object or array lists all that is in it
    bare = lambda v, j: F.when(j.startswith('"') & (F.schema_of_variant(v) == "STRING"), _text(v)).otherwise(j)
    shown = lambda v: F.when(F.is_variant_null(v), F.lit("")).when(v.isNotNull(), let(F.to_json(v), lambda j: bare(v, j)))
    return let(compiled(document, parse_path(path)), shown)


def json_value(body: Column, path: str) -> Column:
    """value_at of a text; null where it is no JSON."""
    return value_at(F.try_parse_json(body), path)


def is_plain(path: str) -> bool:
    """Whether a path has keys and places only, without escapes."""
    return all(re.fullmatch(r"[^.|#@*?\\()]+", p) for p in path.split("."))


# --- Query: every kind of step over nested documents ------------------------------------------------------------

_DOCUMENT = (
    '{"k": %k%, "a.b": "dotted", "data": {"user": {"name": "u%u%", "id": %u%, "nick": null}, "flags": [true, false]},'
    ' "items": [{"id": "x", "n": %n%, "t": "%t%"}, {"id": "y", "n": 5, "t": "view"}, {"id": "z", "n": 9}],'
    ' "rows": [[1, 2], [%n%], 3], "tags": ["%t%", "b"], "none": [], "text": "{\\"in\\": %n%}"}'
)

#: Path and, in SQL over k, u (user), n (0 to 9) and t (type), what it must give.
PATHS: dict[str, str] = {
    "k": "k::VARCHAR",
    "data.user.name": "'u' || u",
    "data.user.id": "u::VARCHAR",
    "data.user.nick": "''",
    "data.user.missing": "NULL",
    "data.user": "'{\"id\":' || u || ',\"name\":\"u' || u || '\",\"nick\":null}'",
    "data.flags": "'[true,false]'",
    "data.flags.0": "'true'",
    "a\\.b": "'dotted'",
    "items.0.n": "n::VARCHAR",
    "items.2.id": "'z'",
    "items.7.id": "NULL",
    "items.#": "'3'",
    "none.#": "'0'",
    "none": "'[]'",
    "items.#.n": "'[' || n || ',5,9]'",
    "items.#.t": "'[\"' || t || '\",\"view\"]'",
    "items.#.n|0": "n::VARCHAR",
    "items.#.n|@reverse": "'[9,5,' || n || ']'",
    'items.#(id=="y").n': "'5'",
    'items.#(id=="none").n': "NULL",
    "items.#(n>4).id": "CASE WHEN n > 4 THEN 'x' ELSE 'y' END",
    "items.#(n<=4)#.id": "CASE WHEN n <= 4 THEN '[\"x\"]' ELSE '[]' END",
    "items.#(n!=5)#.id": "CASE WHEN n <> 5 THEN '[\"x\",\"z\"]' ELSE '[\"z\"]' END",
    "items.#(n>=5)#|#": "CASE WHEN n >= 5 THEN '3' ELSE '2' END",
    "items.#(t)#.id": "'[\"x\",\"y\"]'",
    'items.#(t%"v*").id': "CASE WHEN t LIKE 'v%' THEN 'x' ELSE 'y' END",
    'items.#(t!%"*i*")#.id': "CASE WHEN t LIKE '%i%' THEN '[]' ELSE '[\"x\"]' END",
    'tags.#(=="b")': "'b'",
    "rows.@flatten": "'[1,2,' || n || ',3]'",
    "rows.1.0": "n::VARCHAR",
    "da*.us?r.na*": "'u' || u",
    "data.user.@keys": "'[\"id\",\"name\",\"nick\"]'",
    "data.user.@values|1": "'u' || u",
    "text.@fromstr.in": "n::VARCHAR",
    "tags.@this.0": "t",
    "items.1.@tostr": "'{\"id\":\"y\",\"n\":5,\"t\":\"view\"}'",
}


def _paths_sql() -> str:
    rows = "SELECT event_id AS seq, CAST(props->>'$.k' AS BIGINT) AS k, user_id AS u, event_id % 10 AS n, event_type AS t FROM events"
    return f"WITH e AS ({rows}) " + " UNION ALL ".join(f"SELECT seq, '{p.replace(chr(39), chr(39) * 2)}' AS path, {sql} AS value FROM e" for p, sql in PATHS.items())


#: Bytes of events, with some sixty times their size in documents and paths, that one task works through.
EVENTS_BYTES = 1 << 19


def nested_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, body): a nested document for each event."""
    e = dealt(table(spark, sf_dir, "events"), EVENTS_BYTES)
    body = F.lit(_DOCUMENT)
    for name, value in (("k", F.get_json_object("props", "$.k")), ("u", F.col("user_id").cast("string")), ("n", (F.col("event_id") % 10).cast("string")), ("t", F.col("event_type"))):
        body = F.replace(body, F.lit(f"%{name}%"), value)
    return e.select(F.col("event_id").alias("seq"), body.alias("body"))


@R.query("json_paths", _paths_sql())
def json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = nested_documents(spark, sf_dir).select("seq", F.try_parse_json("body").alias("document"))
    found = F.array(*[F.struct(F.lit(p).alias("path"), value_at(F.col("document"), p).alias("value")) for p in PATHS])
    return d.select("seq", F.explode(found).alias("f")).select("seq", "f.path", "f.value")
