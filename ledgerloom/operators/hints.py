"""Hints in deeds: identity numbers, dates, revenue references and areas, each with its place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.dates import bound, date_hints, matches

#: Fixed values: (type, pattern, groups that make the value, confidence), in the order in which they are looked for; dates come after the identity numbers.
NUMBERS = [
    ("cnic", r"\b(\d{5})-(\d{7})-(\d{1})\b", "1-2-3", "high"),
    ("cnic", r"\b(\d{5})(\d{7})(\d)\b", "1-2-3", "high"),
]
REFERENCES = [
    ("khewat", r"(?:کھاتہ|کھیوٹ|Khewat|Khewat\s+No\.?|کھاتہ\s+نمبر)\s*[:\-]?\s*(\d+)", "1", "high"),
    ("khewat", r"(\d+)\s*(?:کھاتہ|کھیوٹ|Khewat)", "1", "high"),
    ("khatoni", r"(?:کھتونی|Khatoni|Khatoni\s+No\.?|کھتونی\s+نمبر)\s*[:\-]?\s*(\d+)", "1", "high"),
    ("khatoni_range", r"(\d+)\s*(?:تا|to|-)\s*(\d+)\s*(?:کھتونی|Khatoni)", "1-2", "high"),
    ("khasra", r"(?:خسرہ|Khasra|Khasra\s+No\.?)\s*[:\-]?\s*([\d/]+)", "1", "high"),
    ("khasra", r"([\d/]+)\s*(?:خسرہ|Khasra)", "1", "high"),
    ("mutation", r"(?:انتقال|Mutation|Mutation\s+No\.?|Intiqal)\s*[:\-]?\s*(\d+)", "1", "high"),
    ("mutation", r"(\d+)\s*(?:انتقال|Mutation|Intiqal)", "1", "high"),
    ("area", r"(\d+)\s*(?:کنال|kanal)\s+(\d+)\s*(?:مرلہ|marla)", "", "med"),
    ("area", r"(\d+)\s*(?:مربع\s*فٹ|sq\.?\s*ft\.?|sqft)", "", "med"),
]
HINT = "array<struct<type:string,value:string,raw:string,line:int,confidence:string>>"
MOST = 100


def _family(text: Column, kind: str, pattern: str, groups: str, confidence: str) -> Column:
    def hint(m: Column) -> Column:
        parts = [F.regexp_extract(m["raw"], f"(?iU){pattern}", int(g)) for g in groups.split("-")] if groups else [F.lit(None).cast("string")]
        return F.struct(F.lit(kind).alias("type"), (F.concat_ws("-", *parts) if groups else parts[0]).alias("value"), m["raw"].alias("raw"), m["line"].cast("int").alias("line"), F.lit(confidence).alias("confidence"))

    return F.transform(matches(text, pattern), hint).cast(HINT)


def domain_hints(text: Column, strict: bool = True, most: int = MOST) -> Column:
    """An array of (type, value, raw, line, confidence), at most `most`.

    A type and value count once, at their first place.  Areas have no value and
    ambiguous dates none either, so the first of each stands for all.
    """
    text = F.coalesce(text, F.lit(""))
    dates = F.transform(date_hints(text, strict), lambda h: F.struct(F.lit("date").alias("type"), h["value"].alias("value"), h["raw"].alias("raw"), h["line"].alias("line"), h["confidence"].alias("confidence"))).cast(HINT)
    every = F.concat(*[_family(text, *n) for n in NUMBERS], dates, *[_family(text, *r) for r in REFERENCES])
    key = lambda h: F.concat_ws(" ", h["type"], F.coalesce(h["value"], F.lit("")))
    return bound(every, lambda hints: bound(F.transform(hints, key), lambda keys: F.slice(F.filter(hints, lambda h, i: F.array_position(keys, key(h)) == i + 1), 1, most)))
