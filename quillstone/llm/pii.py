"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

Card, bank, phone and social-security numbers, addresses of hosts and of mailboxes, dates and credentials are
found by pattern, validated (checksums, calendar, ranges) and replaced by another value of the same
format. Each format is permuted by a Feistel network whose round function is a keyed SHA-256, so equal
values get equal pseudonyms in every document, whatever their separators, and different values different
ones. Checksums are computed anew and a card's network stays, so that a pseudonym passes the validation its original passed.
What fails validation stays as it is, and so does all other text.

Everything is SQL functions over one row at a time: no shuffle, no Python. Texts that hold none of the signs that
every value has (MAY_HOLD) are passed through after one scan. No pattern repeats a group without a bound, so that
the length of a text costs time in proportion and no stack; values of any length are permuted in pieces.

A pseudonym can be undone by whoever has the key. It is the caller's, or the session's setting KEY_SETTING, or else a
random one of the driver's process, with which values are linked within that process only. Its digest reaches the
executors as the row of a scalar subquery, so that neither plans nor event logs show it.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name

ROUNDS = 8
KEY_SETTING = "spark.quillstone.pseudonym.secret"
_OWN_KEY = secrets.token_hex(32)

#: The names of credentials, and what they consist of.
CREDENTIAL_NAME = r"(?i:password|passwd|passphrase|secret|token|api[_-]?key|access[_-]?key)[\"']?[ \t]*[=:]"
_SECRET = "[A-Za-z0-9+/_-]{8,}"
#: The patterns of each kind of value, tried in this order. Behind a colon a credential is quoted, holds a
#: digit or a change of case, or ends its line; else "the secret: everything changed" would be one.
PATTERNS = {
    "credential": CREDENTIAL_NAME + rf"(?:(?<==)[ \t]*[\"']?{_SECRET}|[ \t]*(?:[\"']|(?=[A-Za-z+/_-]*[0-9]|[A-Za-z0-9+/_-]*[a-z][A-Z])){_SECRET}|[ \t]*{_SECRET}(?=[ \t]*+(?![^\r\n])))",
    "cloud_key": r"(?<![A-Za-z0-9])A[KS]IA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){1,10}",
    "ip6": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){1,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,4})?)(?![0-9A-Za-z:])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}[./-][0-9]{2}[./-][0-9]{4})(?![0-9/-]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|\+[2-9][0-9]{0,2}(?:[ -]?\([0-9]{1,4}\))?(?:[ -]?[0-9]{2,4}){2,5}(?![0-9]|\.[0-9])|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9.-])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])",
}
#: A text without any of these holds no value: each pattern has one of them as a necessary part.
MAY_HOLD = r"[0-9@]|A[KS]IA|[0-9A-Fa-f]:[0-9A-Fa-f]|" + CREDENTIAL_NAME
#: Lengths and first digits of card numbers, by network. Of all digits that stand alone a tenth pass the checksum.
CARD_NUMBER = "^(?:4[0-9]{12}(?:[0-9]{3}){0,2}|(?:5[1-5]|2[2-7]|35)[0-9]{14}|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}|6[0-9]{13,18})$"
#: Long values are permuted in pieces of so many characters.
PIECE = 64
#: Years of one Gregorian cycle: 146,097 days, the product of the two radices.
FIRST_YEAR, DAYS_LEFT, DAYS_RIGHT = 1800, 189, 773


def _key(key: Column | str) -> Column:
    return F.lit(key) if isinstance(key, str) else key


def _prf(key: Column | str, kind: str, round_no: Column, half: Column) -> Column:
    """48 keyed bits of a half, as a nonnegative number."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", _key(key), F.lit(kind), round_no.cast("string"), half), 256), 1, 12), 16, 10).cast("long")


def feistel_pair(x: Column, y: Column, left: int, right: int, key: Column | str, kind: str) -> Column:
    """struct(x, y): a keyed permutation of the pairs of x below left and y below right."""

    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        moved_x = (acc["x"] + _prf(key, kind, i, acc["y"].cast("string"))) % left
        moved_y = (acc["y"] + _prf(key, kind, i, acc["x"].cast("string"))) % right
        return F.struct(F.when(even, moved_x).otherwise(acc["x"]).alias("x"), F.when(even, acc["y"]).otherwise(moved_y).alias("y"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(x.cast("long").alias("x"), y.cast("long").alias("y")), step)


def feistel_number(n: Column, left: int, right: int, key: Column | str, kind: str) -> Column:
    """A keyed permutation of the numbers below left * right."""
    pair = feistel_pair(F.floor(n / right), n % right, left, right, key, kind)
    return F.element_at(F.transform(F.array(pair), lambda p: p["x"] * right + p["y"]), 1)


def feistel_digits(digits: Column, key: Column | str, kind: str) -> Column:
    """A keyed permutation of the digit strings of one length, up to 18."""

    def step(acc: Column, i: Column) -> Column:
        size = F.length(acc["l"])
        moved = (acc["l"].cast("long") + _prf(key, kind, i, acc["r"])) % F.pow(F.lit(10), size).cast("long")
        return F.struct(acc["r"].alias("l"), F.lpad(moved.cast("string"), size, F.lit("0")).alias("r"))

    half = F.floor(F.length(digits) / 2).cast("int")
    start = F.struct(F.substring(digits, F.lit(1), half).alias("l"), F.substring(digits, half + 1, F.length(digits)).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda acc: F.concat(acc["l"], acc["r"]))


#: Characters are permuted within these, place by place; those in none of them stay.
KINDS_OF_LETTERS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")
HEX_DIGITS = ("0123456789abcdef",)


def feistel_letters(word: Column, key: Column | str, kind: str, alphabets: tuple[str, ...] = KINDS_OF_LETTERS) -> Column:
    """A keyed permutation of the strings with characters of the same alphabets in the same places.

    Each piece of PIECE characters is a Feistel network of its own, whose rounds take one digest each.
    """

    def shifted(c: Column, by: Column) -> Column:
        out = c
        for alphabet in alphabets:
            place = F.instr(F.lit(alphabet), c)
            out = F.when((c != "") & (place > 0), F.substring(F.lit(alphabet), (place - 1 + by) % len(alphabet) + 1, F.lit(1))).otherwise(out)
        return out

    def permuted(piece: Column, number: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            mark = F.sha2(F.concat_ws("|", _key(key), F.lit(kind), number.cast("string"), i.cast("string"), acc["r"]), 256)
            moved = _let(mark, lambda d: F.array_join(F.transform(F.split(acc["l"], ""), lambda c, k: shifted(c, F.conv(F.substring(d, 2 * k + 1, F.lit(2)), 16, 10).cast("int"))), ""))
            return F.struct(acc["r"].alias("l"), moved.alias("r"))

        half = F.floor(F.length(piece) / 2).cast("int")
        start = F.struct(F.substring(piece, F.lit(1), half).alias("l"), F.substring(piece, half + 1, F.length(piece)).alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda acc: F.concat(acc["l"], acc["r"]))

    return F.array_join(F.transform(F.regexp_extract_all(word, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), permuted), "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _refilled(shape: Column, symbols: Column, which: str) -> Column:
    """shape, with its characters of the class `which` replaced by those of symbols, in order."""

    def step(acc: Column, c: Column) -> Column:
        fits = c.rlike(which)
        return F.struct(
            F.concat(acc["out"], F.when(fits, F.substring(symbols, acc["k"], F.lit(1))).otherwise(c)).alias("out"),
            (acc["k"] + F.when(fits, 1).otherwise(0)).alias("k"),
        )

    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), step, lambda acc: acc["out"])


def _luhn(digits: Column, doubled: int) -> Column:
    """The Luhn sum, doubling every second digit from the right, the last one if doubled is 0."""

    def worth(c: Column, i: Column) -> Column:
        twice = c.cast("int") * 2
        return F.when(i % 2 == doubled, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(c.cast("int"))

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), worth), F.lit(0), lambda a, b: a + b)


def _mod97(text: Column) -> Column:
    """The remainder by 97 of a text of digits and capital letters, read as in bank account numbers."""

    def step(acc: Column, c: Column) -> Column:
        value = F.when(c.rlike("^[0-9]$"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (acc * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _card(m: Column, key: Column) -> Column:
    """The first four digits, those of the network, stay."""

    def made(body: Column) -> Column:
        return F.concat(body, ((10 - _luhn(body, 0) % 10) % 10).cast("string"))

    def of(d: Column) -> Column:
        body = F.concat(F.substring(d, 1, 4), feistel_digits(F.substring(d, F.lit(5), F.length(d) - 5), key, "card"))
        return F.when(d.rlike(CARD_NUMBER) & (_luhn(d, 1) % 10 == 0), _refilled(m, _let(body, made), "[0-9]")).otherwise(m)

    return _let(_digits(m), of)


def _iban(m: Column, key: Column) -> Column:
    def of(d: Column) -> Column:
        country, account = F.substring(d, 1, 2), F.substring(d, F.lit(5), F.length(d))

        def made(new: Column) -> Column:
            check = F.lpad((98 - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
            return _refilled(m, F.concat(country, check, new), "[A-Z0-9]")

        valid = (_mod97(F.concat(account, F.substring(d, 1, 4))) == 1) & F.length(d).between(15, 34)
        return F.when(valid, _let(feistel_letters(account, key, "iban"), made)).otherwise(m)

    return _let(F.regexp_replace(m, " ", ""), of)


def _phone(m: Column, key: Column) -> Column:
    def of(d: Column) -> Column:
        kept = F.when(m.startswith("+1"), 2).when(m.startswith("+"), 3).otherwise(1)
        rest = F.substring(d, kept + 1, F.length(d))
        return F.when(F.length(d).between(8, 15), _refilled(m, F.concat(F.substring(d, F.lit(1), kept), feistel_digits(rest, key, "phone")), "[0-9]")).otherwise(m)

    return _let(_digits(m), of)


def _ip(m: Column, key: Column) -> Column:
    def octets(n: Column) -> Column:
        return F.concat_ws(".", *[(F.floor(n / (1 << s)) % 256).cast("string") for s in (24, 16, 8, 0)])

    def of(p: Column) -> Column:
        number = sum(F.element_at(p, k + 1) * (1 << s) for k, s in enumerate((24, 16, 8, 0)))
        return F.when(F.array_max(p) < 256, _let(feistel_number(number, 1 << 16, 1 << 16, key, "ip"), octets)).otherwise(m)

    return _let(F.transform(F.split(m, r"\."), lambda x: x.cast("long")), of)


def _ssn(m: Column, key: Column) -> Column:
    def shown(n: Column) -> Column:
        area, rest = F.floor(n / 989901) + 1, n % 989901
        area = area + F.when(area >= 666, 1).otherwise(0)
        return F.concat_ws("-", F.lpad(area.cast("string"), 3, "0"), F.lpad((F.floor(rest / 9999) + 1).cast("string"), 2, "0"), F.lpad((rest % 9999 + 1).cast("string"), 4, "0"))

    area, group, serial = (F.element_at(F.split(m, "-"), k).cast("long") for k in (1, 2, 3))
    number = (area - 1 - F.when(area > 666, 1).otherwise(0)) * 989901 + (group - 1) * 9999 + serial - 1
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    return F.when(valid, _let(feistel_number(number, 898, 989901, key, "ssn"), shown)).otherwise(m)


def _date(m: Column, key: Column) -> Column:
    """Dates keep their order of fields and separators; where day and month could be either, the day is taken to come first."""

    def of(d: Column) -> Column:
        year_first = m.rlike("^[0-9]{4}[^0-9]")
        a, b = F.substring(d, 1, 2), F.substring(d, 3, 2)
        month_first = ~year_first & (a.cast("int") <= 12) & (b.cast("int") > 12)
        year = F.when(year_first, F.substring(d, 1, 4)).otherwise(F.substring(d, 5, 4))
        month = F.when(year_first, F.substring(d, 5, 2)).when(month_first, a).otherwise(b)
        day = F.when(year_first, F.substring(d, 7, 2)).when(month_first, b).otherwise(a)
        origin = F.to_date(F.lit(f"{FIRST_YEAR}-01-01"))

        def shown(n: Column) -> Column:
            new = F.date_add(origin, n.cast("int"))
            pattern = F.when(year_first, F.date_format(new, "yyyyMMdd")).when(month_first & (F.dayofmonth(new) > 12), F.date_format(new, "MMddyyyy"))
            return _refilled(m, pattern.otherwise(F.date_format(new, "ddMMyyyy")), "[0-9]")

        def permuted(date: Column) -> Column:
            days = F.datediff(date, origin)
            known = date.isNotNull() & days.between(0, DAYS_LEFT * DAYS_RIGHT - 1)
            return F.when(known, _let(feistel_number(days, DAYS_LEFT, DAYS_RIGHT, key, "date"), shown)).otherwise(m)

        return _let(F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-MM-dd"), permuted)

    return _let(_digits(m), of)


def _email(m: Column, key: Column) -> Column:
    """The mailbox and its domain are replaced, each on its own; the last label stays."""

    def of(p: Column) -> Column:
        domain = F.element_at(p, 2)
        last = F.substring_index(domain, ".", -1)
        labels = F.substring(domain, F.lit(1), F.length(domain) - F.length(last) - 1)
        return F.concat(feistel_letters(F.element_at(p, 1), key, "email"), F.lit("@"), feistel_letters(labels, key, "domain"), F.lit("."), last)

    return _let(F.split(m, "@"), of)


def _credential(m: Column, key: Column) -> Column:
    """The value behind the name and the sign is replaced; strings of hex digits stay such."""
    name = F.regexp_extract(m, CREDENTIAL_NAME + r"[ \t]*[\"']?", 0)

    def of(value: Column) -> Column:
        hexed = value.rlike("^[0-9a-f]+$")
        return F.when(hexed, feistel_letters(value, key, "hex", HEX_DIGITS)).otherwise(feistel_letters(value, key, "credential"))

    return F.concat(name, _let(F.substring(m, F.length(name) + 1, F.length(m)), of))


def _ip6(m: Column, key: Column) -> Column:
    """Capital digits stay capital where there are only such; a mixed address comes out in small ones."""
    new = feistel_letters(F.lower(m), key, "ip6", HEX_DIGITS)
    return F.when(m.rlike("[A-F]") & ~m.rlike("[a-f]"), F.upper(new)).otherwise(new)


def _cloud_key(m: Column, key: Column) -> Column:
    return F.concat(F.substring(m, 1, 4), feistel_letters(F.substring(m, F.lit(5), F.length(m)), key, "cloud_key"))


KINDS: dict[str, Callable[[Column, Column], Column]] = {
    "credential": _credential,
    "cloud_key": _cloud_key,
    "email": _email,
    "ip6": _ip6,
    "iban": _iban,
    "date": _date,
    "ssn": _ssn,
    "phone": _phone,
    "ip": _ip,
    "card": _card,
}


def _any(kinds: dict) -> str:
    return "|".join(f"(?:{PATTERNS[k]})" for k in kinds)


def pseudonym(value: Column, key: Column) -> Column:
    """The pseudonym of one found value; the value itself if it fails its kind's validation."""
    chosen = None
    for kind, make in KINDS.items():
        fits = value.rlike(f"^(?:{PATTERNS[kind]})$")
        chosen = F.when(fits, make(value, key)) if chosen is None else chosen.when(fits, make(value, key))
    return chosen.otherwise(value)


def session_key(spark: SparkSession) -> str:
    """The key of the session's setting, or else the random one of this process."""
    return spark.conf.get(KEY_SETTING, None) or _OWN_KEY


def _key_column(spark: SparkSession, key: str) -> Column:
    """The key's digest as a column whose value no plan shows: a scalar subquery over one row."""
    digest = hashlib.sha256(key.encode()).hexdigest()
    return spark.createDataFrame([(digest,)], "k string").select("k").scalar()


def pseudonymise(docs: DataFrame, key: str | None = None, id_col: str = "doc_id", text_col: str = "text", counts: bool = True) -> DataFrame:
    """docs with the text replaced, and with counts n_found and n_replaced (long) behind its columns.

    key: whoever has it can undo the pseudonyms; None takes session_key(). Dates from FIRST_YEAR on within one
    Gregorian cycle of 400 years count, others stay. A null text stays null with counts of 0, an empty one empty; repeated rows are
    treated alike; texts of any length are searched whole, from the left, and values do not overlap. All other
    columns stay as they are (with counts, a column of docs that has the name of one is replaced by it); an empty table
    gives no rows.
    """
    if not id_col or id_col not in docs.columns:
        raise ValueError(f"no column {id_col!r}")
    pattern, text = _any(KINDS), F.col(text_col)
    found_at, new_at, key_at = (free_name(docs, x) for x in ("found", "new", "key"))
    found, new = F.col(found_at), F.col(new_at)
    marked = docs.withColumn(key_at, _key_column(docs.sparkSession, key or session_key(docs.sparkSession)))
    marked = marked.withColumn(found_at, F.when(text.rlike(MAY_HOLD), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    marked = marked.withColumn(new_at, F.when(F.size(found) > 0, F.transform(found, lambda m: pseudonym(m, F.col(key_at)))))
    joined = F.array_join(F.zip_with(F.split(text, pattern, -1), new, lambda p, r: F.concat(p, F.coalesce(r, F.lit("")))), "")
    changed = F.size(F.filter(F.zip_with(found, new, lambda a, b: a != b), lambda x: x))
    made = {text_col: F.when(new.isNotNull(), joined).otherwise(text)}
    if counts:
        made["n_found"] = F.when(new.isNotNull(), F.size(found)).otherwise(0).cast("long")
        made["n_replaced"] = F.when(new.isNotNull(), changed).otherwise(0).cast("long")
    return marked.withColumns(made).drop(found_at, new_at, key_at)
