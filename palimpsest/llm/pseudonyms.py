"""Format-preserving pseudonyms for personal data, in SQL functions only.

Numbers and dates that are valid in their format are permuted inside it by a
keyed Feistel network: equal values get equal pseudonyms in every document,
different values different ones, and the result is valid again. Mail addresses
and secret tokens, which have no numeric format, get keyed digests of their form.

=========  ==========================================================  =====================
kind       valid if                                                     permuted over
=========  ==========================================================  =====================
card       13 to 19 digits, alone, in groups of four or as 4-6-5 or 4-6-4  all digits but the check digit, which keeps its distance to the Luhn digit
phone      a country code and ten digits, or ten digits in groups       the ten digits
abroad     + and country code, then groups of 7 to 14 digits; 0n in pairs  the digits after the country code or 0
ssn        area 001-899 without 666, group 01-99, serial 0001-9999      the valid numbers
ipv4       four parts of 0 to 255                                       32 bits
date       a calendar date of 1900 to 2099 (y-m-d, d/m/y, d.m.y, m/d/y)  those days, up to the 12th and after it apart
email      local part and domain                                        digest; domain ``mail.invalid``
token      32 to 64 hexadecimal digits with a letter                    digest of the same length and case
=========  ==========================================================  =====================

A slashed date that reads both ways is day before month, so a day that is written
month first and read so lies after the 12th of its month. As days up to the 12th
and the others are permuted apart, its pseudonym reads that way only, too: a day has
one pseudonym in all forms, and in each form different days have different ones.

Text between the values stays as it is, to the character.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Walks back into a domain; each leaves it with a chance below one in two.
WALKS = 64
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9](?:[A-Za-z0-9.-]{0,250}[A-Za-z0-9])?\.[A-Za-z]{2,24}(?![A-Za-z0-9])"
_TOKEN = r"(?<![0-9A-Za-z])(?=[0-9]*[A-Fa-f])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])"
_IPV4 = rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?[0-9])"
_PHONE = r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9])"
_ABROAD = r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}(?=(?:[ .()-]{1,3}[0-9]+){1,6}(?![0-9]))(?=(?:[ .()-]{0,3}[0-9]){7,14}(?![ .-]?[0-9]))(?:[ .-]\(?[0-9]{1,8}\)?){1,6}|0[1-9](?: [0-9]{2}){4}|0[1-9](?:\.[0-9]{2}){4}|0[1-9](?:-[0-9]{2}){4})(?![ .-]?[0-9])"
_SSN = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"
_DATE = r"(?<![0-9/.-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.](?:19|20)[0-9]{2})(?![0-9]|[/.-][0-9])"
_CARD = r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5})(?![0-9A-Za-z])"
_ANY = "|".join([_EMAIL, _TOKEN, _IPV4, _PHONE, _ABROAD, _SSN, _DATE, _CARD])
#: A quick test that every value passes.
_HINT = r"@|[0-9][0-9./)-]|[0-9A-Fa-f]{32}"


def _long(x) -> Column:
    return F.lit(x).cast("long")


def _noise(key: str, tweak: Column, round_: Column, value: Column) -> Column:
    """48 keyed bits."""
    said = F.concat_ws("|", F.lit(key), tweak, round_.cast("string"), value.cast("string"))
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.sha2(said, 256)), 256), 1, 12), 16, 10).cast("long")


def _feistel(value: Column, a: Column, b: Column, key: str, tweak: Column) -> Column:
    """Permutes 0 .. a*b - 1 by alternating halves modulo ``a`` and ``b``."""

    def step(s: Column, k: Column) -> Column:
        even = k % 2 == 0
        left = F.when(even, F.pmod(s.l + _noise(key, tweak, k, s.r), a)).otherwise(s.l)
        right = F.when(even, s.r).otherwise(F.pmod(s.r + _noise(key, tweak, k, s.l), b))
        return F.struct(left.alias("l"), right.alias("r"))

    start = F.struct(F.floor(value / b).cast("long").alias("l"), F.pmod(value, b).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s.l * b + s.r)


def _within(value: Column, size: int, key: str, tweak: str, valid: Callable[[Column], Column] = lambda v: F.lit(True)) -> Column:
    """Permutes the valid ones of 0 .. size - 1: elsewhere, the permutation is walked on until it is back."""
    a = int(size**0.5) + 1
    b = -(-size // a)
    turn = lambda v: _feistel(v, _long(a), _long(b), key, F.lit(tweak))
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), turn(value), lambda v, _: F.when((v < size) & valid(v), v).otherwise(turn(v)))


def _digits_permuted(digits: Column, key: str, tweak: Column) -> Column:
    """A digit string of up to 18 digits, permuted among those of its length."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    a, b = F.pow(F.lit(10.0), half).cast("long"), F.pow(F.lit(10.0), n - half).cast("long")
    return F.lpad(_feistel(digits.cast("long"), a, b, key, F.concat_ws("/", tweak, n.cast("string"))).cast("string"), 20, "0").substr(F.lit(21) - n, n)


def _luhn(payload: Column) -> Column:
    """The check digit of a payload."""
    n = F.length(payload)

    def add(s: Column, i: Column) -> Column:
        d = payload.substr(n - i, F.lit(1)).cast("int")
        return s + F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.pmod(-F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add), F.lit(10))


def _filled(template: Column, digits: Column) -> Column:
    """The template with its digits replaced in order."""
    def put(s: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.struct(F.concat(s.out, F.when(digit, digits.substr(s.at, F.lit(1))).otherwise(c)).alias("out"), F.when(digit, s.at + 1).otherwise(s.at).alias("at"))

    return F.aggregate(F.split(template, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), put, lambda s: s.out)


def _only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _card(value: Column, key: str) -> Column:
    digits = _only_digits(value)
    payload = digits.substr(F.lit(1), F.length(digits) - 1)
    new = _digits_permuted(payload, key, F.lit("card"))
    check = F.pmod(F.substring(digits, -1, 1).cast("int") - _luhn(payload) + _luhn(new), F.lit(10))
    return _filled(value, F.concat(new, check.cast("string")))


def _phone(value: Column, key: str) -> Column:
    digits = _only_digits(value)
    country = digits.substr(F.lit(1), F.length(digits) - 10)
    return _filled(value, F.concat(country, _digits_permuted(F.substring(digits, -10, 10), key, F.concat(F.lit("phone"), country))))


def _abroad(value: Column, key: str) -> Column:
    digits = _only_digits(value)
    fixed = F.regexp_extract(value, r"^\+?(0(?=[1-9])|[0-9]{1,3})", 1)
    rest = digits.substr(F.length(fixed) + 1, F.length(digits))
    return _filled(value, F.concat(fixed, _digits_permuted(rest, key, F.concat(F.lit("phone"), fixed))))


def _ssn(value: Column, key: str) -> Column:
    area, group, serial = (F.substring(value, at, n).cast("long") for at, n in ((1, 3), (5, 2), (8, 4)))
    place = F.when(area > 666, area - 2).otherwise(area - 1) * (99 * 9999) + (group - 1) * 9999 + serial - 1
    new = _within(place, 898 * 99 * 9999, key, "ssn")
    new_area = F.floor(new / (99 * 9999)).cast("int") + 1
    return F.format_string("%03d-%02d-%04d", F.when(new_area >= 666, new_area + 1).otherwise(new_area), F.pmod(F.floor(new / 9999), F.lit(99)).cast("int") + 1, F.pmod(new, F.lit(9999)).cast("int") + 1)


def _ipv4(value: Column, key: str) -> Column:
    part = F.split(value, r"\.")
    number = sum((part[i].cast("long") * 256 ** (3 - i) for i in range(1, 4)), part[0].cast("long") * 256**3)
    new = _feistel(number, _long(1 << 16), _long(1 << 16), key, F.lit("ipv4"))
    return F.concat_ws(".", *[F.pmod(F.floor(new / 256**k).cast("long"), F.lit(256)).cast("string") for k in (3, 2, 1, 0)])


def _day_permuted(day: Column, key: str) -> Column:
    """year * 10000 + month * 100 + day of another day, in the same part of its month: up to the 12th, or after it."""

    def part(first: int, days: int, tweak: str) -> Column:
        dated = lambda v: (F.floor(v / (12 * days)).cast("int") + 1900, F.pmod(F.floor(v / days), F.lit(12)).cast("int") + 1, F.pmod(v, F.lit(days)).cast("int") + first)

        def valid(v: Column) -> Column:
            year, month, of_month = dated(v)
            return of_month <= F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1))))

        def written(v: Column) -> Column:
            year, month, of_month = dated(v)
            return year * 10_000 + month * 100 + of_month

        place = ((F.year(day) - 1900) * 12 + F.month(day) - 1) * days + F.dayofmonth(day) - first
        new = _within(place.cast("long"), 200 * 12 * days, key, tweak, valid)
        return F.transform(F.array(new), written)[0]

    return F.when(F.dayofmonth(day) <= 12, part(1, 12, "date")).otherwise(part(13, 19, "late date"))


def _date(value: Column, key: str) -> Column:
    """Invalid dates stay as they are; day before month is preferred where both read."""
    by = lambda form: F.try_to_timestamp(value, F.lit(form)).cast("date")
    dashed, dotted, day_first = value.rlike("^[0-9]{4}-"), value.contains("."), by("dd/MM/yyyy")
    day = F.when(dashed, by("yyyy-MM-dd")).when(dotted, by("dd.MM.yyyy")).otherwise(F.coalesce(day_first, by("MM/dd/yyyy")))

    def written(n: Column) -> Column:
        year, month, of_month = (F.lpad(x.cast("string"), w, "0") for x, w in ((F.floor(n / 10_000), 4), (F.pmod(F.floor(n / 100), F.lit(100)), 2), (F.pmod(n, F.lit(100)), 2)))
        slashed = F.when(day_first.isNotNull(), F.concat_ws("/", of_month, month, year)).otherwise(F.concat_ws("/", month, of_month, year))
        return F.when(dashed, F.concat_ws("-", year, month, of_month)).when(dotted, F.concat_ws(".", of_month, month, year)).otherwise(slashed)

    return F.when(day.isNull(), value).otherwise(F.transform(F.array(_day_permuted(day, key)), written)[0])


def _email(value: Column, key: str) -> Column:
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(value)), 256), 1, 16), F.lit("@mail.invalid"))


def _token(value: Column, key: str) -> Column:
    new = F.sha2(F.concat_ws("|", F.lit(key), F.lit("token"), F.lower(value)), 256).substr(F.lit(1), F.length(value))
    return F.when(value.rlike("[A-F]"), F.upper(new)).otherwise(new)


_KINDS: list[tuple[str, Callable[[Column, str], Column]]] = [("@", _email), (f"^(?:{_TOKEN})$", _token), (f"^(?:{_IPV4})$", _ipv4), (f"^(?:{_SSN})$", _ssn), (f"^(?:{_DATE})$", _date), (f"^(?:{_PHONE})$", _phone), (f"^(?:{_ABROAD})$", _abroad)]


def pseudonymize(docs: DataFrame, key: str, text_column: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in the text, and n_values, the values found in each.

    Null texts stay null with 0 values; empty texts stay empty. Values that look
    like dates without being one stay. Other columns, repeated rows and the order
    of columns are kept; a column named n_values is replaced.
    """
    text = F.col(text_column)
    # The values are set off by a control character; where a text has that itself, it is written with a second one meanwhile.
    plain = F.replace(F.replace(text, F.lit("\x02"), F.lit("\x02b")), F.lit("\x01"), F.lit("\x02a"))
    back = lambda c: F.replace(F.replace(c, F.lit("\x02a"), F.lit("\x01")), F.lit("\x02b"), F.lit("\x02"))
    segments = F.split(F.regexp_replace(plain, f"(?:{_ANY})", "\x01$0\x01"), "\x01", -1)

    def one(segment: Column, i: Column) -> Column:
        value = _card(segment, key)
        for form, make in reversed(_KINDS):
            value = F.when(segment.rlike(form), make(segment, key)).otherwise(value)
        return F.when(i % 2 == 0, back(segment)).otherwise(value)

    hint = F.coalesce(text.rlike(_HINT), F.lit(False))
    order = [c for c in docs.columns if c != "n_values"]
    out = docs.drop("n_values").withColumn("_segments", F.when(hint, segments))
    new = F.when(F.size("_segments") > 1, F.array_join(F.transform("_segments", one), "")).otherwise(text)
    count = F.when(hint, F.floor((F.size("_segments") - 1) / 2)).otherwise(0).cast("int")
    return out.withColumns({text_column: new, "n_values": count}).select(*order, "n_values")
