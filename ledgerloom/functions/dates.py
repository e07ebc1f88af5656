"""Dates in running text, as Column expressions: every hint with its value, place and certainty."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of months, in the order in which they are tried.
URDU_MONTHS = {"جنوری": 1, "فروری": 2, "مارچ": 3, "اپریل": 4, "مئی": 5, "جون": 6, "جولائی": 7, "اگست": 8, "ستمبر": 9, "اکتوبر": 10, "نومبر": 11, "دسمبر": 12}
ENGLISH_MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4, "may": 5, "jun": 6, "june": 6, "jul": 7, "july": 7,
    "aug": 8, "august": 8, "sep": 9, "september": 9, "oct": 10, "october": 10, "nov": 11, "november": 11, "dec": 12, "december": 12,
}
ISO = r"\b(\d{4})-(\d{2})-(\d{2})\b"
NUMERIC = r"\b(\d{1,2})[./-](\d{1,2})[./-](\d{4})\b"
#: Stand around a match while a text is cut; a text's own are read as blanks.
OPEN, CLOSE = "\uf8fe", "\uf8ff"
HINT = "array<struct<value:string,raw:string,line:int,confidence:string>>"


def named(months: dict[str, int]) -> str:
    return r"\b(\d{1,2})\s*[-.]?\s*(" + "|".join(months) + r")\s*[-.]?\s*(\d{4})\b"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def matches(text: Column, pattern: str) -> Column:
    """(raw, line) of every match, in order; line: line breaks before its start."""

    def found(parts: Column) -> Column:
        breaks = F.transform(parts, lambda p: F.length(p) - F.length(F.translate(p, "\n", "")))
        numbered = F.transform(parts, lambda p, i: F.struct(F.substring_index(p, CLOSE, 1).alias("raw"), i.alias("i")))
        later = F.filter(numbered, lambda s: s["i"] > 0)
        return bound(breaks, lambda b: F.transform(later, lambda s: F.struct(s["raw"].alias("raw"), F.aggregate(F.slice(b, F.lit(1), s["i"]), F.lit(0), lambda n, k: n + k).alias("line"))))

    return bound(F.split(F.regexp_replace(F.translate(text, OPEN + CLOSE, "  "), f"(?iU){pattern}", f"{OPEN}$0{CLOSE}"), OPEN), found)


def _hint(value: Column, hit: Column, confidence: Column) -> Column:
    return F.struct(value.cast("string").alias("value"), hit["raw"].alias("raw"), hit["line"].cast("int").alias("line"), confidence.alias("confidence"))


def _date(year: Column, month: Column, day: Column) -> Column:
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    return F.concat(year, F.lit("-"), two(month), F.lit("-"), two(day))


def _iso(hit: Column, strict: bool) -> Column:
    p = F.split(hit["raw"], "-")
    fits = p[1].cast("int").between(1, 12) & p[2].cast("int").between(1, 31)
    return F.when(fits, _hint(hit["raw"], hit, F.lit("high")))


def _numeric(hit: Column, strict: bool) -> Column:
    """Day first.  Strict: a day or month above 12 settles it (such a month is kept as it is), both small ones are ambiguous and have no value."""
    p = F.split(hit["raw"], "[./-]")
    d, m = p[0].cast("int"), p[1].cast("int")
    value = _date(p[2], p[1], p[0])
    if not strict:
        return F.when(m.between(1, 12) & d.between(1, 31), _hint(value, hit, F.lit("med")))
    sure = F.when(d > 12, m.between(1, 12) & (d <= 31)).otherwise(d >= 1)
    return F.when((d <= 12) & (m <= 12), _hint(F.lit(None), hit, F.lit("low"))).when(sure, _hint(value, hit, F.lit("high")))


def _named(months: dict[str, int]) -> Callable[[Column, bool], Column]:
    def read(hit: Column, strict: bool) -> Column:
        day, year = F.regexp_extract(hit["raw"], r"(?U)^(\d{1,2})", 1), F.regexp_extract(hit["raw"], r"(?U)(\d{4})$", 1)
        name = F.lower(F.regexp_replace(hit["raw"], r"(?U)[\d\s.-]", ""))
        month = F.element_at(F.create_map(*[F.lit(x) for kv in months.items() for x in kv]), name)
        return F.when(month.isNotNull() & day.cast("int").between(1, 31), _hint(_date(year, month, day), hit, F.lit("high")))

    return read


def _branch(text: Column, pattern: str, read: Callable[[Column, bool], Column], strict: bool) -> Column:
    hints = F.transform(matches(F.coalesce(text, F.lit("")), pattern), lambda h: read(h, strict))
    return F.filter(hints, lambda h: h.isNotNull()).cast(HINT)


def date_hints(text: Column, strict: bool = True) -> Column:
    """An array of (value, raw, line, confidence).

    Four branches, in this order: year-month-day, day-month-year, Urdu months,
    English months.  A date found before, or an ambiguous spelling found
    before, isn't repeated.  Days over 31 and, but for the numeric branch's
    sure months, months over 12 are no dates.  A null text has no hints.
    """
    branches = [(ISO, _iso), (NUMERIC, _numeric), (named(URDU_MONTHS), _named(URDU_MONTHS)), (named(ENGLISH_MONTHS), _named(ENGLISH_MONTHS))]
    every = F.concat(*[_branch(text, pattern, read, strict) for pattern, read in branches])
    key = lambda h: F.coalesce(h["value"], h["raw"])
    return bound(every, lambda hints: bound(F.transform(hints, key), lambda keys: F.filter(hints, lambda h, i: F.array_position(keys, key(h)) == i + 1)))
