"""Scalar text functions as column expressions: counting, decoding, formatting, type inference, durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import Registry
from ..shared import spread
from ..views import docs, table

R = Registry()

#: Entities that are unescaped, and the tags that make a text HTML.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}
HTML_TAGS = ("<html", "<body", "<head", "<div", "<span", "<p>", "<a ", "<!doctype")
#: Nanoseconds of the units of a duration.
UNITS = {"ns": 1, "us": 1_000, "µs": 1_000, "μs": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000}


def word_count(text: Column) -> Column:
    """Maximal runs of letters and digits."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{Nd}]+"))


def line_count(text: Column) -> Column:
    """Line feeds plus one; 0 for an empty text."""
    return F.when(F.octet_length(text) == 0, 0).otherwise(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)


def duration_ns(text: Column) -> Column:
    """A duration such as `1h2m3.5s` in ns; null unless the whole text is one."""
    number = r"([0-9]+(?:\.[0-9]*)?|\.[0-9]+)(ns|us|µs|μs|ms|s|m|h)"
    parts = F.regexp_extract_all(text, F.lit(number), F.lit(0))

    def worth(part: Column) -> Column:
        unit = F.regexp_extract(part, r"[a-zµμ]+$", 0)
        size = F.when(F.lit(False), 0)
        for name, ns in UNITS.items():
            size = size.when(unit == name, ns)
        return (F.regexp_extract(part, r"^[0-9.]+", 0).cast("decimal(20,9)") * size.cast("decimal(17,0)")).cast("bigint")

    total = F.aggregate(F.transform(parts, worth), F.lit(0).cast("bigint"), lambda a, b: a + b)
    signed = F.when(text.startswith("-"), -total).otherwise(total)
    return F.when(text.rlike(rf"^[+-]?(?:{number})+$"), signed).when(text.rlike(r"^[+-]?0$"), F.lit(0).cast("bigint"))


def html_unescape(text: Column) -> Column:
    """Six entities, the ampersand last, so that nothing is unescaped twice by accident of order."""
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def url_encode_rfc3986(text: Column) -> Column:
    """Percent-encoding in which a space is %20 and only unreserved characters stay."""
    form = F.url_encode(text)
    return F.replace(F.replace(F.replace(form, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def url_decode_lenient(text: Column) -> Column:
    """`+` becomes a space and valid escapes their bytes; invalid escapes stay as they are."""
    plain = F.replace(text, F.lit("+"), F.lit(" "))
    parts = F.regexp_extract_all(plain, F.lit(r"(?s)(?:%[0-9A-Fa-f]{2})+|%|[^%]+"), F.lit(0))
    decoded = F.transform(parts, lambda p: F.when(p.rlike(r"^(%[0-9A-Fa-f]{2})+$"), F.decode(F.unhex(F.replace(p, F.lit("%"), F.lit(""))), "UTF-8")).otherwise(p))
    return F.array_join(decoded, "")


def truncated(text: Column, most: int) -> Column:
    """The text, or its first characters and `...` if it is longer."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def truncated_bytes(text: Column, most: int) -> Column:
    """The text, or its first `most` bytes in UTF-8 and `...` if it has more; a character that is cut in two is left out."""
    data = F.encode(text, "UTF-8")
    bytes_at = lambda k: F.conv(F.hex(F.substring(data, F.lit(most + 1 - k), F.lit(1))), 16, 10).cast("int")
    # bytes 0x80 to 0xBF go on a character: those at the cut, at most three, belong to one that begins before it
    back = F.lit(0)
    for k in (3, 2, 1, 0):
        going = F.lit(True)
        for j in range(k):
            going = going & bytes_at(j).between(0x80, 0xBF)
        back = F.when(going & ~bytes_at(k).between(0x80, 0xBF), k) if k == 3 else back.when(going & ~bytes_at(k).between(0x80, 0xBF), k)
    kept = F.decode(F.substring(data, F.lit(1), F.lit(most) - back), "UTF-8")
    return F.when(F.octet_length(data) > most, F.concat(kept, F.lit("..."))).otherwise(text)


def _tenths(n: Column, unit: int) -> Column:
    """n / unit with one decimal, rounded as the binary quotient is: ties by its exact value, then to even."""
    whole, rest, half = F.floor(n / (unit // 10)), n % (unit // 10), unit // 20
    quotient = n / float(unit)
    fraction = ((quotient - F.floor(quotient)) * float(1 << 52)).cast("bigint").cast("decimal(20,0)")
    remainder = (n - F.floor(quotient) * unit).cast("decimal(18,0)")
    above = fraction * F.lit(unit).cast("decimal(8,0)") - remainder * F.lit(1 << 52).cast("decimal(17,0)")
    up = (rest > half) | ((rest == half) & ((above > 0) | ((above == 0) & (whole % 2 == 1))))
    tenths = whole + F.when(up, 1).otherwise(0)
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def number_text(n: Column) -> Column:
    """1.0K and 1.0M from a thousand and a million on."""
    millions, thousands = F.concat(_tenths(n, 1_000_000), F.lit("M")), F.concat(_tenths(n, 1_000), F.lit("K"))
    return F.when(n >= 1_000_000, millions).when(n >= 1_000, thousands).otherwise(n.cast("string"))


def duration_text(ns: Column) -> Column:
    """µs below a millisecond, ms below a second, then seconds, minutes and seconds, hours and minutes."""
    seconds = F.floor(ns / 1_000_000_000)
    return (
        F.when(ns < 1_000_000, F.concat(F.floor(ns / 1_000).cast("string"), F.lit("µs")))
        .when(ns < 1_000_000_000, F.concat(F.floor(ns / 1_000_000).cast("string"), F.lit("ms")))
        .when(ns < 60_000_000_000, F.format_string("%.1fs", ns / 1_000_000_000.0))
        .when(ns < 3_600_000_000_000, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m"), (seconds % 60).cast("string"), F.lit("s")))
        .otherwise(F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h"), (F.floor(seconds / 60) % 60).cast("string"), F.lit("m")))
    )


def bytes_text(n: Column) -> Column:
    """B to PB by 1024, two decimals."""
    text = F.format_string("%.2f PB", n / float(1 << 50))
    for shift, unit in ((40, "TB"), (30, "GB"), (20, "MB"), (10, "KB"), (0, "B")):
        below = F.when(F.abs(n) < float(1 << (shift + 10)), F.format_string(f"%.2f {unit}", n / float(1 << shift)))
        text = below.otherwise(text)
    return text


def is_json(text: Column) -> Column:
    """Valid JSON, an object or an array."""
    return (F.octet_length(text) >= 2) & text.rlike(r"^[{\[]") & F.try_parse_json(text).isNotNull()


def inferred_type(text: Column) -> Column:
    """The kind of a value, by the first test that it passes; the order of the tests matters."""
    lower = F.lower(text)
    html = F.lit(False)
    for tag in HTML_TAGS:
        html = html | lower.contains(tag)
    return (
        F.when(F.octet_length(text) == 0, "unknown")
        .when(is_json(text), "json")
        .when(text.startswith("<"), F.when(html, "html").otherwise("xml"))
        .when(text.rlike(r"^[A-Za-z0-9+/_=-]{4,}\.[A-Za-z0-9+/_=-]{4,}\.[A-Za-z0-9+/_=-]{4,}$"), "jwt")
        .when(text.rlike(r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"), "uuid")
        .when(text.rlike(r"(?s)^[^@]+@.+\.[^.]+$") & ~text.rlike(r"(?s)^[^@]+@\.[^.]+$"), "email")
        .when(text.rlike(r"^(https?|ftp|file)://"), "url")
        .when((F.octet_length(text) % 4 == 0) & text.rlike(r"^[A-Za-z0-9+/_-]{2,}([A-Za-z0-9+/_-]{2}|[A-Za-z0-9+/_-]=|==)$"), "base64")
        .when((F.octet_length(text) % 2 == 0) & text.rlike(r"^[0-9A-Fa-f]{2,}$"), "hex")
        .when(text.rlike(r"^-?[0-9]+$"), "integer")
        .when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), "float")
        .otherwise("string")
    )


def quick_type(text: Column) -> Column:
    """The kind by a glance at the first byte and the shape; a lone minus passes as an integer."""
    return (
        F.when(text.rlike(r"^[{\[]"), "json")
        .when(text.startswith("<"), "xml")
        .when(text.rlike(r"^-?[0-9]*$") & (F.octet_length(text) > 0), "integer")
        .when((F.octet_length(text) == 36) & text.rlike(r"^.{8}-.{4}-.{4}-.{4}-.{12}$"), "uuid")
        .otherwise("string")
    )


#: Columns, as SQL, whose values exercise the type tests: of events and documents.
_VALUES_SQL = """v AS (SELECT props AS s FROM events UNION ALL SELECT CAST(value AS VARCHAR) FROM events UNION ALL SELECT CAST(event_id AS VARCHAR) FROM events
 UNION ALL SELECT event_type FROM events UNION ALL SELECT md5(CAST(event_id AS VARCHAR)) FROM events UNION ALL SELECT url FROM pages UNION ALL SELECT html FROM pages
 UNION ALL SELECT 'user' || user_id || '@mail.example.com' FROM events UNION ALL SELECT '[' || user_id || ', ' || event_id || ']' FROM events UNION ALL SELECT '{broken' || user_id FROM events)"""


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, p = spread(table(spark, sf_dir, "events")), spread(table(spark, sf_dir, "pages"))
    mail = F.concat(F.lit("user"), F.col("user_id"), F.lit("@mail.example.com"))
    pair = F.concat(F.lit("["), F.col("user_id"), F.lit(", "), F.col("event_id"), F.lit("]"))
    of_events = [F.col("props"), F.col("value").cast("string"), F.col("event_id").cast("string"), F.col("event_type"), F.md5(F.col("event_id").cast("string")), mail, pair, F.concat(F.lit("{broken"), F.col("user_id"))]
    return e.select(F.explode(F.array(*of_events)).alias("s")).unionAll(p.select(F.explode(F.array("url", "html")).alias("s")))


@R.query(
    "type_inference",
    f"""WITH {_VALUES_SQL} SELECT CASE WHEN octet_length(encode(s)) = 0 THEN 'unknown' WHEN regexp_matches(s, '^[{{\\[]') AND json_valid(s) THEN 'json'
 WHEN starts_with(s, '<') THEN CASE WHEN regexp_matches(lower(s), '<html|<body|<head|<div|<span|<p>|<a |<!doctype') THEN 'html' ELSE 'xml' END
 WHEN regexp_matches(s, '^[A-Za-z0-9+/_=-]{{4,}}\\.[A-Za-z0-9+/_=-]{{4,}}\\.[A-Za-z0-9+/_=-]{{4,}}$') THEN 'jwt'
 WHEN regexp_matches(s, '^[0-9A-Fa-f]{{8}}-[0-9A-Fa-f]{{4}}-[0-9A-Fa-f]{{4}}-[0-9A-Fa-f]{{4}}-[0-9A-Fa-f]{{12}}$') THEN 'uuid'
 WHEN strpos(s, '@') > 1 AND regexp_matches(s, '(?s)^[^@]+@.+\\.[^.]+$') THEN 'email' WHEN regexp_matches(s, '^(https?|ftp|file)://') THEN 'url'
 WHEN length(s) >= 4 AND octet_length(encode(s)) % 4 = 0 AND regexp_matches(s, '^[A-Za-z0-9+/_-]{{2,}}([A-Za-z0-9+/_-]{{2}}|[A-Za-z0-9+/_-]=|==)$') THEN 'base64'
 WHEN octet_length(encode(s)) % 2 = 0 AND regexp_matches(s, '^[0-9A-Fa-f]{{2,}}$') THEN 'hex' WHEN regexp_matches(s, '^-?[0-9]+$') THEN 'integer'
 WHEN regexp_matches(s, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN 'float' ELSE 'string' END AS kind, count(*) AS n FROM v GROUP BY 1""",
)
def type_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, sf_dir).groupBy(inferred_type(F.col("s")).alias("kind")).agg(F.count("*").alias("n"))


@R.query(
    "quick_types",
    f"""WITH {_VALUES_SQL} SELECT CASE WHEN regexp_matches(s, '^[{{\\[]') THEN 'json' WHEN starts_with(s, '<') THEN 'xml' WHEN length(s) > 0 AND regexp_matches(s, '^-?[0-9]*$') THEN 'integer'
 WHEN octet_length(encode(s)) = 36 AND regexp_matches(s, '^.{{8}}-.{{4}}-.{{4}}-.{{4}}-.{{12}}$') THEN 'uuid' ELSE 'string' END AS kind, count(*) AS n FROM v GROUP BY 1""",
)
def quick_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, sf_dir).groupBy(quick_type(F.col("s")).alias("kind")).agg(F.count("*").alias("n"))


@R.query(
    "text_counts",
    """SELECT doc_id, CAST(len(regexp_extract_all(text, '[\\p{L}\\p{Nd}]+')) AS INTEGER) AS n_words,
 CASE WHEN octet_length(encode(text)) = 0 THEN 0 ELSE CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INTEGER) END AS n_lines, CAST(octet_length(encode(text)) AS INTEGER) AS n_bytes FROM documents""",
)
def text_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", word_count(t).alias("n_words"), line_count(t).alias("n_lines"), F.octet_length(t).alias("n_bytes"))


@R.query(
    "number_formats",
    """SELECT DISTINCT n, CASE WHEN n >= 1000000 THEN printf('%.1fM', n / 1000000.0) WHEN n >= 1000 THEN printf('%.1fK', n / 1000.0) ELSE CAST(n AS VARCHAR) END AS short FROM (SELECT event_id * 997 AS n FROM events)""",
)
def number_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").select((F.col("event_id") * 997).alias("n")).distinct()
    return n.select("n", number_text(F.col("n")).alias("short"))


@R.query(
    "duration_formats",
    """SELECT seq, CASE WHEN t < 1000000 THEN CAST(t // 1000 AS VARCHAR) || 'µs' WHEN t < 1000000000 THEN CAST(t // 1000000 AS VARCHAR) || 'ms' WHEN t < 60000000000 THEN printf('%.1fs', t / 1000000000.0)
 WHEN t < 3600000000000 THEN CAST(t // 60000000000 AS VARCHAR) || 'm' || CAST(t // 1000000000 % 60 AS VARCHAR) || 's' ELSE CAST(t // 3600000000000 AS VARCHAR) || 'h' || CAST(t // 60000000000 % 60 AS VARCHAR) || 'm' END AS shown
 FROM (SELECT event_id AS seq, CAST(power(7, event_id % 17) AS BIGINT) * (1 + event_id % 5) AS t FROM events)""",
)
def duration_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.pow(F.lit(7), F.col("event_id") % 17).cast("bigint") * (1 + F.col("event_id") % 5)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), duration_text(t).alias("shown"))


@R.query(
    "byte_formats",
    """SELECT seq, CASE WHEN n < 1024 THEN printf('%.2f B', n) WHEN n < 1048576 THEN printf('%.2f KB', n / 1024) WHEN n < 1073741824 THEN printf('%.2f MB', n / 1048576) WHEN n < 1099511627776 THEN printf('%.2f GB', n / 1073741824)
 WHEN n < 1125899906842624 THEN printf('%.2f TB', n / 1099511627776) ELSE printf('%.2f PB', n / 1125899906842624) END AS shown FROM (SELECT event_id AS seq, power(2.0, event_id % 56) * 1.25 AS n FROM events)""",
)
def byte_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.pow(F.lit(2.0), F.col("event_id") % 56) * 1.25
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), bytes_text(n).alias("shown"))


@R.query("truncated_texts", """SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS shown FROM documents""")
def truncated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", truncated(F.col("text"), 100).alias("shown"))


@R.query("truncated_bytes", """WITH d AS (SELECT doc_id, text, hex(encode(text)) AS x FROM documents), c AS (SELECT *, list_filter([0, 1, 2, 3], lambda k: (CAST('0x' || substr(x, CAST(201 - 2 * k AS BIGINT), 2) AS INTEGER) & 192) <> 128)[1] AS back FROM d WHERE length(x) > 200)
SELECT doc_id, decode(unhex(left(x, CAST(200 - 2 * back AS BIGINT)))) || '...' AS shown FROM c UNION ALL SELECT doc_id, text FROM d WHERE x IS NULL OR length(x) <= 200""")
def truncated_bytes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents cut to a hundred bytes, as reports cut them."""
    return docs(spark, sf_dir).select("doc_id", truncated_bytes(F.col("text"), 100).alias("shown"))


@R.query("url_encoding", """SELECT page_id, replace(url_encode(url), '+', '%20') AS encoded, url AS decoded FROM pages""")
def url_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", url_encode_rfc3986(F.col("url")).alias("encoded"))
    return p.withColumn("decoded", url_decode_lenient(F.col("encoded")))


@R.query(
    "entity_unescape",
    """SELECT page_id, md5(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')) AS digest FROM pages""",
)
def entity_unescape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(html_unescape(F.col("html"))).alias("digest"))


@R.query(
    "string_transforms",
    """SELECT conv_id, turn, upper(role) AS shout, trim('  ' || role || ' ') AS trimmed, to_base64(encode(role)) AS packed, md5(lower(text)) AS lower_digest FROM conversations""",
)
def string_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    padded = F.concat(F.lit("  "), F.col("role"), F.lit(" "))
    return c.select("conv_id", "turn", F.upper("role").alias("shout"), F.trim(padded).alias("trimmed"), F.base64(F.encode("role", "UTF-8")).alias("packed"), F.md5(F.lower("text")).alias("lower_digest"))


@R.query(
    "duration_parsing",
    """SELECT event_id AS seq, CAST(event_id % 7 AS BIGINT) * 3600000000000 + (event_id % 50) * 60000000000 + CAST(event_id % 40 AS BIGINT) * 1500000000 + (event_id % 900) * 1000000 AS ns FROM events""",
)
def duration_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    text = F.concat((e % 7).cast("string"), F.lit("h"), (e % 50).cast("string"), F.lit("m"), ((e % 40) * 1.5).cast("string"), F.lit("s"), (e % 900).cast("string"), F.lit("ms"))
    return table(spark, sf_dir, "events").select(e.alias("seq"), duration_ns(text).alias("ns"))


@R.query("content_hashes", """SELECT doc_id, sha256(text) AS sha, md5(text) AS md5, CAST(octet_length(encode(text)) AS INTEGER) AS size FROM documents""")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("sha"), F.md5("text").alias("md5"), F.octet_length("text").alias("size"))


