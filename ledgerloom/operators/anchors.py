"""Entities of a page by anchor words: what follows (or precedes) a word that announces it.

A page is its tokens in order.  Each label has anchors, sequences of tokens in
lower case, of which the first listed that stands at a place counts there; the
first fitting token among the next few is the entity.  A token that several
anchors reach is one entity, with the surest confidence.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.dates import bound
from ..functions.text import broken_token


@dataclass(frozen=True)
class Anchors:
    """anchors: (tokens, confidence) in order; reach: how many tokens after an anchor are tried; fits: what one must look like; joins: what the next token must look like to belong to it."""

    label: str
    anchors: tuple[tuple[tuple[str, ...], float], ...]
    reach: int
    fits: str
    strip: str = ""
    joins: str = ""


#: The anchors of each label.
ANCHORED = (
    Anchors("PLOT_NO", ((("plot", "no"), 0.85), (("plot", "number"), 0.85), (("plot", "#"), 0.85), (("plot",), 0.70), (("commercial", "plot"), 0.85), (("پلاٹ", "نمبر"), 0.85), (("پلاٹ",), 0.85)), 3, r"^[\dA-Za-z\-/]+$", joins=r"^[A-Za-z\-/]{1,5}$"),
    Anchors("REGISTRY_NO", tuple(((*a.split(),), 0.80) for a in ("reg", "reg.", "registration", "registry", "instrument", "doc no", "deed no", "document no", "رجسٹری نمبر", "رجسٹری")), 3, r"^[\d\-/]+$"),
    Anchors("AMOUNT", (*(((a,), 0.85) for a in ("rs", "rs.", "pkr", "rupees", "rupee", "₨")), (("consideration",), 0.75)), 6, r"^[\d,]+(\.\d+)?$", strip=".,;:"),
)
#: Fixed values: (label, pattern of a token by itself, confidence).
ALONE = (("DATE", r"^(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{1,2}-\d{1,2})$", 0.80), ("CNIC", r"\b(\d{5}-\d{7}-\d|\d{13})\b", 0.95))
#: What a scheme's name ends with, how many tokens before it are the name, and its confidence.
SUFFIXES, NAME_TOKENS, SUFFIX_SCORE = ("housing scheme", "society", "town", "city", "scheme", "cooperative society"), 8, 0.75
ENTITY = "array<struct<label:string,at:int,value:string,confidence:double>>"


def _clean(token: Column) -> Column:
    return ~broken_token(token)


def _entity(label: str, at: Column, value: Column, confidence: Column) -> Column:
    return F.struct(F.lit(label).alias("label"), at.cast("int").alias("at"), value.alias("value"), confidence.cast("double").alias("confidence"))


def _after(words: Column, low: Column, a: Anchors) -> Column:
    """What each place's anchor announces: entities, several of a token possible."""
    firsts = F.array(*[F.lit(x) for x in dict.fromkeys(seq[0] for seq, _ in a.anchors)])
    places = F.filter(F.transform(low, lambda w, i: F.struct(i.alias("i"), F.array_contains(firsts, w).alias("ok"))), lambda p: p["ok"])

    def found(p: Column) -> Column:
        out = F.lit(None).cast("struct<n:int,c:double>")
        for seq, c in reversed(a.anchors):
            here = F.slice(low, p["i"] + 1, F.lit(len(seq))) == F.array(*[F.lit(x) for x in seq])
            out = F.when(here, F.struct(F.lit(len(seq)).alias("n"), F.lit(c).alias("c"))).otherwise(out)

        def near(hit: Column) -> Column:
            start = p["i"] + hit["n"]
            tokens = F.transform(F.slice(words, start + 1, F.lit(a.reach)), lambda w, k: F.struct((start + k).alias("at"), (F.regexp_replace(w, f"[{a.strip}]+$", "") if a.strip else w).alias("w"), _clean(w).alias("ok")))
            first = F.try_element_at(F.filter(tokens, lambda t: t["ok"] & t["w"].rlike(a.fits)), F.lit(1))

            def grown(t: Column) -> Column:
                after = F.try_element_at(words, (t["at"] + 2).cast("int"))
                value = F.when(F.coalesce(after.rlike(a.joins), F.lit(False)), F.concat(t["w"], F.lit("-"), after)).otherwise(t["w"]) if a.joins else t["w"]
                return F.when(t.isNotNull(), _entity(a.label, t["at"], value, hit["c"]))

            return F.when(hit.isNotNull(), bound(first, grown))

        return bound(out, near)

    return F.filter(F.transform(places, found), lambda e: e.isNotNull()).cast(ENTITY)


def _before(words: Column, low: Column, suffix: str) -> Column:
    """The clean tokens, up to eight, before the first place of a suffix that makes a name of them."""
    text = F.array_join(low, " ")
    parts = F.split(text, rf"(?U)\b{suffix}\b")

    def name(prefix: Column) -> Column:
        # The token that begins at the suffix, or the next one if it begins within a token.
        at = F.length(prefix) - F.length(F.translate(prefix, " ", "")) + F.when((prefix != "") & ~prefix.endswith(" "), 1).otherwise(0)

        def made(n: Column) -> Column:
            start = F.greatest(F.lit(0), n - NAME_TOKENS)
            tokens = F.filter(F.transform(F.slice(words, start + 1, n - start), lambda w, k: F.struct((start + k).alias("at"), w.alias("w"))), lambda t: _clean(t["w"]))
            value = F.array_join(F.transform(tokens, lambda t: t["w"]), " ")
            fits = (n > 0) & (n < F.size(words)) & (F.size(tokens) > 0) & ~value.rlike("[.!?]$") & F.substring(value, 1, 1).rlike(r"^\p{Lu}")
            return F.when(fits, _entity("SCHEME_NAME", F.try_element_at(tokens, F.lit(1))["at"], value, F.lit(SUFFIX_SCORE)))

        return bound(at.cast("int"), made)

    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), suffix))
    made = F.when(F.size(parts) > 1, F.transform(prefixes, name)).otherwise(F.array().cast(ENTITY))
    return F.slice(F.filter(made, lambda e: e.isNotNull()), 1, 1).cast(ENTITY)


def token_entities(text: Column) -> Column:
    """An array of (label, at, value, confidence) by the place of the token, then label; a null text has none."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")

    def found(w: Column) -> Column:
        low = F.transform(w, F.lower)
        every = F.concat(*[_after(w, low, a) for a in ANCHORED], *[_by_itself(w, *x) for x in ALONE], *[_before(w, low, s) for s in SUFFIXES])
        ranked = F.array_sort(every, lambda a, b: F.when(_key(a) < _key(b), -1).when(_key(a) > _key(b), 1).otherwise(0))
        return bound(ranked, lambda r: F.filter(r, lambda e, i: (i == 0) | ~F.coalesce(_same(e, F.get(r, i - 1)), F.lit(False))))

    return bound(words, found)


def _by_itself(words: Column, label: str, pattern: str, confidence: float) -> Column:
    hits = F.transform(words, lambda t, i: F.when(_clean(t) & t.rlike(pattern), _entity(label, i, t, F.lit(confidence))))
    return F.filter(hits, lambda e: e.isNotNull()).cast(ENTITY)


def _key(e: Column) -> Column:
    return F.struct(e["at"], e["label"], -e["confidence"], -F.length(e["value"]), e["value"])


def _same(a: Column, b: Column) -> Column:
    return (a["at"] == b["at"]) & (a["label"] == b["label"])
