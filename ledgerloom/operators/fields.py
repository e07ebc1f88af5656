"""A dossier's fields in the text of a page: patterns by certainty, the surest first match counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.dates import bound, matches

_NAME = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)"
#: A field's patterns and their confidence, surest first.
PATTERNS = {
    "property.plot_number": [(r"(?:plot|plot\s*no\.?|plot\s*#|plot\s*number)\s*[:]?\s*(\d+)", 0.95), (r"plot\s*(\d+)", 0.85), (r"no\.?\s*(\d+)", 0.70)],
    "property.block": [(r"block\s*([A-Z])", 0.95), (r"block\s*-\s*([A-Z])", 0.95)],
    "property.phase": [(r"phase\s*(\d+)", 0.95), (r"phase\s*-\s*(\d+)", 0.95), (r"phase\s*([IVX]+)", 0.90)],
    "property.mouza": [(rf"mouza\s+{_NAME}", 0.90), (r"mouza\s*[:]?\s*([A-Z][a-z]+)", 0.85)],
    "property.tehsil": [(rf"tehsil\s+{_NAME}", 0.90), (r"tehsil\s*[:]?\s*([A-Z][a-z]+)", 0.85)],
    "property.district": [(rf"district\s+{_NAME}", 0.90), (r"district\s*[:]?\s*([A-Z][a-z]+)", 0.85)],
    "property.khasra_numbers": [(r"khasra\s*no\.?\s*[:]?\s*(\d+(?:[/-]\d+)?)", 0.95), (r"khasra\s*(\d+(?:[/-]\d+)?)", 0.90)],
    "registry.registry_number": [(r"registry\s*no\.?\s*[:]?\s*(\d+)", 0.90), (r"registration\s*no\.?\s*[:]?\s*(\d+)", 0.85)],
    "registry.registry_date": [(r"registry\s*date\s*[:]?\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})", 0.85), (r"registration\s*date\s*[:]?\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})", 0.85)],
    "stamp.estamp_id_or_number": [(r"e[-\s]?stamp\s*(?:id|no\.?|number)\s*[:]?\s*([A-Z0-9\-]+)", 0.95), (r"estamp\s*[:]?\s*([A-Z0-9\-]+)", 0.90), (r"stamp\s*paper\s*(?:id|no\.?)\s*[:]?\s*([A-Z0-9\-]+)", 0.85)],
}
#: Schemes that are looked for by name, in this order, and their confidence.
SCHEMES = ("faisal town", "union town", "dha", "defence", "bahria town", "model town", "gulberg", "johar town", "wapda town")
SCHEME_SCORE, AROUND = 0.85, 20
FIELD = "array<struct<field:string,value:string,raw:string,line:int,confidence:double>>"


def _all(text: Column, field: str, pattern: str, confidence: float) -> Column:
    """Every match of a pattern in a lower-case text whose value can be the field's."""

    def hit(m: Column) -> Column:
        value = F.trim(F.regexp_extract(m["raw"], f"(?iU){pattern}", 1))
        return F.struct(F.lit(field).alias("field"), (F.upper(value) if field == "property.block" else value).alias("value"), m["raw"].alias("raw"), m["line"].cast("int").alias("line"), F.lit(confidence).alias("confidence"))

    found = F.transform(matches(text, pattern), hit).cast(FIELD)
    if field == "property.plot_number":
        return F.filter(found, lambda h: F.coalesce(h["value"].try_cast("int").between(1, 9999), F.lit(False)))
    if field == "stamp.estamp_id_or_number":
        return F.filter(found, lambda h: F.length(h["value"]) >= 5)
    return found


def _scheme(text: Column, low: Column) -> Column:
    """The first listed scheme that occurs, as the capitalised words around its first place, or its own name."""
    out = F.lit(None).cast("struct<field:string,value:string,raw:string,line:int,confidence:double>")
    for name in reversed(SCHEMES):
        parts = F.split(low, rf"(?U)\b{name}\b", 2)
        at = F.length(parts[0])
        start = F.greatest(F.lit(0), at - AROUND)
        context = F.substring(text, start + 1, at + len(name) + AROUND - start)
        capital = F.regexp_extract(context, _NAME, 1)
        line = (at - F.length(F.translate(parts[0], "\n", ""))).cast("int")
        one = F.struct(F.lit("property.scheme_name").alias("field"), F.when(capital != "", capital).otherwise(name.title()).alias("value"), F.lit(name).alias("raw"), line.alias("line"), F.lit(SCHEME_SCORE).alias("confidence"))
        out = F.when(F.size(parts) > 1, one).otherwise(out)
    return out


def page_fields(text: Column) -> Column:
    """An array of (field, value, raw, line, confidence): one for each field that a page has, and every khasra number.

    Patterns read the text in lower case; of equally sure matches the first
    counts.  A null text has no fields.
    """

    def found(pair: Column) -> Column:
        own, low = pair["text"], pair["low"]
        parts = []
        for field, patterns in PATTERNS.items():
            every = F.concat(*[_all(low, field, p, c) for p, c in patterns])
            if field == "property.khasra_numbers":
                parts.append(bound(every, lambda hits: bound(F.transform(hits, lambda h: h["value"]), lambda values: F.filter(hits, lambda h, i: F.array_position(values, h["value"]) == i + 1))))
            else:
                parts.append(F.slice(every, 1, 1))
        return F.concat(*parts, F.array_compact(F.array(_scheme(own, low))))

    return bound(F.struct(F.coalesce(text, F.lit("")).alias("text"), F.lower(F.coalesce(text, F.lit(""))).alias("low")), found)
