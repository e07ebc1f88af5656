"""Extraction of fields from text lines, gates on values, and keyword classification.

An extractor is a pattern with a confidence; its matches become rows, so the
best value of a field is a window over (confidence, pattern order, place).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ARABIC, broken_token, squeeze
from .windows import first_by


@dataclass(frozen=True)
class Pattern:
    field: str
    regex: str
    confidence: float
    group: int = 1


def extract(pages: DataFrame, patterns: list[Pattern], keys: list[str]) -> DataFrame:
    """(keys, field, value, confidence, pattern_ord, match_ord) of every match."""
    found = [_matches(p, o) for o, p in enumerate(patterns)]
    return pages.select(*keys, F.explode(F.concat(*found)).alias("m")).select(*keys, "m.*")


def _matches(p: Pattern, order: int) -> Column:
    def one(v: Column, i: Column) -> Column:
        return F.struct(F.lit(p.field).alias("field"), F.trim(v).alias("value"), F.lit(p.confidence).alias("confidence"), F.lit(order).alias("pattern_ord"), i.alias("match_ord"))

    return F.transform(F.regexp_extract_all("text", F.lit(p.regex), F.lit(p.group)), one)


def distinct_in_rows(pages: DataFrame, patterns: list[Pattern], keys: list[str]) -> DataFrame:
    """(keys, field, value): each lower-case value of a field once for each row of pages, without an exchange; keys tell rows apart."""

    def one(p: Pattern) -> Column:
        return F.transform(F.regexp_extract_all("text", F.lit(p.regex), F.lit(p.group)), lambda v: F.struct(F.lit(p.field).alias("field"), F.lower(F.trim(v)).alias("value")))

    found = [one(p) for p in patterns]
    return pages.select(*keys, F.explode(F.array_distinct(F.concat(*found))).alias("m")).select(*keys, "m.*")


def best_in_rows(pages: DataFrame, patterns: list[Pattern], keys: list[str]) -> DataFrame:
    """(keys, field, value, confidence): what best_values would choose, as the first match of the first pattern that has one, without an exchange."""
    fields: dict[str, list[Pattern]] = {}
    for p in sorted(patterns, key=lambda p: -p.confidence):
        fields.setdefault(p.field, []).append(p)
    one = lambda p: F.when(F.regexp_like("text", F.lit(p.regex)), F.struct(F.lit(p.field).alias("field"), F.trim(F.regexp_extract("text", p.regex, p.group)).alias("value"), F.lit(p.confidence).alias("confidence")))
    best = F.array_compact(F.array(*[F.coalesce(*[one(p) for p in ps]) for ps in fields.values()]))
    return pages.select(*keys, F.explode(best).alias("m")).select(*keys, "m.*")


def entity_tokens(tokens: DataFrame, patterns: list[Pattern], labels: list[str], keys: list[str]) -> DataFrame:
    """(keys, label, value, x0, y0, x1, y1) of the tokens that are entities of the wanted labels, boxes normalised to 0..1000.

    tokens (keys, word, left, top, right, bottom, width, height): a token takes
    the first label whose pattern fits all of it.
    """
    label = F
    for p in patterns:
        if p.field in labels:
            label = label.when(F.col("word").rlike(f"^(?:{p.regex})$"), p.field)
    unit = lambda c, size: F.least(F.lit(1000), F.greatest(F.lit(0), (F.col(c) * 1000 / F.col(size)).cast("int")))
    found = tokens.withColumn("label", label.otherwise(None)).where("label IS NOT NULL")
    return found.select(*keys, "label", F.col("word").alias("value"), unit("left", "width").alias("x0"), unit("top", "height").alias("y0"), unit("right", "width").alias("x1"), unit("bottom", "height").alias("y1"))


def best_values(found: DataFrame, keys: list[str]) -> DataFrame:
    """The best value of each field: by confidence, then pattern, then place."""
    return first_by(found, [*keys, "field"], [F.desc("confidence"), "pattern_ord", "match_ord"])


def distinct_values(found: DataFrame, keys: list[str]) -> DataFrame:
    """Each value of a field once, at its highest confidence; case doesn't matter."""
    return first_by(found, [*keys, "field", F.lower("value")], [F.desc("confidence"), "pattern_ord", "match_ord"])


def parsed_date(value: Column) -> Column:
    """yyyy-mm-dd of a day-first date with . / or -; null for impossible days (29 February always passes)."""
    at = lambda i: F.regexp_extract(value, "^\\s*([0-9]{1,2})[./-]([0-9]{1,2})[./-]([0-9]{4})\\s*$", i).try_cast("int")
    d, m, y = at(1), at(2), at(3)
    most = F.when(m == 2, 29).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    good = y.between(1900, 2100) & m.between(1, 12) & d.between(1, 31) & (d <= most)
    return F.when(good, F.concat_ws("-", y.cast("string"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")))


def _checked(ok: Column, value: Column, reason: Column) -> Column:
    return F.struct(ok.alias("ok"), F.when(ok, value).alias("value"), F.when(~ok, reason).alias("reason"))


def cnic_gate(value: Column) -> Column:
    """13 digits, written 5-7-1."""
    d = F.regexp_replace(value, "[^0-9]", "")
    return _checked(F.length(d) == 13, F.concat_ws("-", F.substring(d, 1, 5), F.substring(d, 6, 7), F.substring(d, 13, 1)), F.lit("not 13 digits"))


def amount_gate(value: Column) -> Column:
    """Digits of an amount: four or more, or any with a currency before them."""
    d = F.regexp_replace(value, "[^0-9]", "")
    return _checked((d != "") & ((F.length(d) >= 4) | value.rlike("(?i)(rs|pkr)")), d, F.lit("too small without a currency"))


def date_gate(value: Column) -> Column:
    p = parsed_date(value)
    return _checked(p.isNotNull(), p, F.lit("no date"))


def plot_gate(value: Column) -> Column:
    """A number of 1 to 9999 with an optional word, number first."""
    n, w = F.regexp_extract(value, "([0-9]+)", 1), F.regexp_extract(value, "([A-Za-z]+)", 1)
    good = n.try_cast("int").between(1, 9999)
    return _checked(F.coalesce(good, F.lit(False)), F.concat_ws("-", n, F.nullif(w, F.lit(""))), F.lit("no plot number"))


GATES = {"cnic": cnic_gate, "amount": amount_gate, "date": date_gate, "plot": plot_gate}


def gate(key: Column, value: Column) -> Column:
    """The gate whose name the key contains; other keys pass with any text."""
    out = F
    for name, check in GATES.items():
        out = out.when(key.contains(name), check(value))
    plain = F.trim(value)
    return out.otherwise(_checked(F.coalesce(plain != "", F.lit(False)), plain, F.lit("empty")))


#: Phrases no name holds, and words of sentences.
NARRATIVE = (
    "appears", "vide", "in this regard", "property", "competent", "owner", "letter", "reference", "submitted", "documents", "above mentioned", "lawful", "according", "respect", "regard", "hereby", "whereas",
    "therefore", "aforesaid", "aforementioned", "aforesaid property", "executed by", "in witness", "witness whereof", "witnesses named",
    "ولد", "ساکن", "ضلع", "تحصیل", "شناختی", "کارڈ", "نمبر", "مکان", "پلاٹ", "رہائشی", "اور", "یا", "بیع", "فروخت", "خریداری", "فروخت کنندہ", "خریدار",
)
STOPWORDS = ("the", "is", "are", "was", "were", "this", "that", "with", "from", "for")


def _first_fault(*faults: tuple[Column, str]) -> Column:
    out = F
    for bad, reason in faults:
        out = out.when(bad, reason)
    return out.otherwise(None)


def _verdict(fault: Column, value: Column) -> Column:
    return F.struct(fault.isNull().alias("ok"), F.when(fault.isNull(), value).alias("value"), fault.alias("reason"))


def _words(v: Column) -> Column:
    return F.filter(F.split(v, " "), lambda w: w != "")


def name_validator(value: Column) -> Column:
    """A line that can be a name: 3 to 80 characters, no narrative, no sentence signs, few digits, at most 8 words, mostly letters."""
    v = squeeze(value)
    solid = F.regexp_replace(v, "\\s", "")
    size = F.greatest(F.length(solid), F.lit(1))
    told = F.lower(v).rlike("|".join(NARRATIVE))
    letters, digits = F.length(F.regexp_replace(solid, "[^\\p{L}]", "")) / size, F.length(F.regexp_replace(solid, "[^\\p{Nd}]", "")) / size
    least = F.when(v.rlike(f"[{ARABIC}]") & ~v.rlike("[A-Za-z]"), 0.45).otherwise(0.70)
    return _verdict(_first_fault((F.length(v) > 80, "too long"), (F.length(v) < 3, "too short"), (told, "narrative"), (v.rlike("[.,;:!?]"), "punctuation"), (digits > 0.2, "digits"), (F.size(_words(v)) > 8, "too many words"), (letters < least, "few letters")), v)


def cnic_validator(value: Column) -> Column:
    d = F.regexp_replace(F.regexp_replace(squeeze(value), "(?i)^(cnic|nic|id)\\s*:?\\s*", ""), "[\\s.\\-]", "")
    return _verdict(_first_fault((~d.rlike("^[0-9]{13}$"), "invalid CNIC format")), F.concat_ws("-", F.substring(d, 1, 5), F.substring(d, 6, 7), F.substring(d, 13, 1)))


def plot_validator(value: Column) -> Column:
    n = F.regexp_extract(value, "([0-9]+)", 1)
    inside = F.coalesce(F.when(F.length(n) <= 9, n.try_cast("int")).between(1, 9999), F.lit(False))
    return _verdict(_first_fault((n == "", "no number"), (~inside, "out of range")), n)


def khasra_validator(value: Column) -> Column:
    found = F.transform(F.regexp_extract_all(squeeze(value), F.lit("([0-9]+[/-][0-9]+)"), F.lit(1)), lambda x: F.replace(x, F.lit("-"), F.lit("/")))
    return _verdict(_first_fault((F.size(found) == 0, "no khasra")), F.array_join(found, ", "))


def registry_validator(value: Column) -> Column:
    v = squeeze(value)
    words = _words(F.lower(v))
    told = (F.size(words) > 3) & F.arrays_overlap(words, F.array(*[F.lit(w) for w in STOPWORDS]))
    return _verdict(_first_fault((F.length(v) > 40, "too long"), (v.rlike("[.,;:!?]"), "punctuation"), (told, "narrative"), (~v.rlike("^[A-Za-z0-9/\\- ]+$"), "invalid characters")), F.upper(v))


def estamp_validator(value: Column) -> Column:
    v = F.trim(F.regexp_replace(squeeze(value), "(?i)^(e[-\\s]?stamp|estamp|stamp\\s*paper|psid|challan)\\s*(?:id|no\\.?|number)?\\s*:?\\s*", ""))
    return _verdict(_first_fault((F.length(v) > 50, "too long"), (v == "", "empty"), (~v.rlike("^[A-Za-z0-9\\-_]+$"), "invalid characters")), F.upper(v))


def validate(key: Column, value: Column) -> Column:
    """(ok, value, reason) by the validator that the key's words call for; other keys pass unchanged."""
    k = F.lower(key)
    return (
        F.when(k.contains("name"), name_validator(value)).when(k.contains("nic"), cnic_validator(value)).when(k.contains("plot"), plot_validator(value)).when(k.contains("khasra"), khasra_validator(value))
        .when(k.contains("registry") & k.contains("number"), registry_validator(value)).when(k.contains("stamp"), estamp_validator(value)).otherwise(_verdict(F.lit(None).cast("string"), value))
    )


#: Fields, their other names, least lengths and kinds.
FIELD_ALIASES = {
    "party.seller.names": "seller_name", "party.buyer.names": "buyer_name", "party.witness.names": "party_name", "party.name.raw": "party_name", "party.cnic": "cnic", "party.cnic_number": "cnic_number", "consideration.amount": "amount",
    "property.plot_number": "plot_number", "property.khasra_number": "khasra_number", "property.khasra_numbers": "khasra_number", "document.execution_date": "execution_date", "registry.registry_date": "registration_date", "registry.registration_date": "registration_date",
}
LEAST_LENGTH = {
    "owner_name": 4, "buyer_name": 4, "seller_name": 4, "party_name": 4, "transferor": 4, "transferee": 4, "cnic": 15, "cnic_number": 15, "amount": 1, "consideration": 1, "price": 1, "plot_number": 2, "khasra_number": 2,
    "date": 6, "registration_date": 6, "lien_status": 3, "noc_status": 3,
}
NAME_FIELDS = ("owner_name", "buyer_name", "seller_name", "party_name", "transferor", "transferee")
AMOUNT_FIELDS, DATE_FIELDS, CNIC_FIELDS = ("amount", "consideration", "price"), ("date", "registration_date", "execution_date"), ("cnic", "cnic_number")
HIGH_RISK = (*NAME_FIELDS, *CNIC_FIELDS, *AMOUNT_FIELDS, "khasra_number", "plot_number", "property_area")
SOFT_FLOOR = 0.05


def canonical_field(field: Column) -> Column:
    name = F.trim(F.coalesce(field, F.lit("")))
    out = F
    for alias, to in FIELD_ALIASES.items():
        out = out.when(name == alias, to)
    return out.otherwise(F.element_at(F.split(name, "\\."), -1))


def candidate_check(field: Column, value: Column, quality: Column) -> Column:
    """(valid, factor, reason): whether a value can be the field's, and what is left of its confidence."""
    f, v = canonical_field(field), F.trim(F.coalesce(value, F.lit("")))
    digits, solid = F.regexp_replace(v, "[^0-9]", ""), F.regexp_replace(v, "\\s", "")
    cnic = F.when(F.length(digits) == 13, F.concat_ws("-", F.substring(digits, 1, 5), F.substring(digits, 6, 7), F.substring(digits, 13, 1))).otherwise(digits)
    least = F
    for name, n in LEAST_LENGTH.items():
        least = least.when(f == name, n)
    words = _words(squeeze(v))

    def result(valid: bool, factor: float, reason: Column | str | None = None) -> Column:
        reason = reason if isinstance(reason, Column) else F.lit(reason).cast("string")
        return F.struct(F.lit(valid).alias("valid"), F.lit(factor).alias("factor"), reason.alias("reason"))

    return (
        F.when(~v.rlike("[A-Za-z0-9\\u0600-\\u06FF]"), result(False, 0.0, "junk_token_pattern"))
        .when(F.coalesce(F.length(v) < least.otherwise(None), F.lit(False)), result(False, 0.1, F.concat(F.lit("short_"), F.substring(f, 1, 20), F.lit("_candidate"))))
        .when(f.isin(*CNIC_FIELDS) & ~cnic.rlike("^[0-9]{5}-[0-9]{7}-[0-9]$"), result(False, 0.15, "invalid_cnic_format"))
        .when(f.isin(*CNIC_FIELDS), result(True, 1.0))
        .when(f.isin(*AMOUNT_FIELDS) & ~F.regexp_replace(v, "[\\s,.]", "").rlike("^[0-9]+$"), result(False, 0.2, "malformed_amount"))
        .when(f.isin(*DATE_FIELDS) & ~v.rlike("\\b[0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{1,4}\\b"), result(False, 0.2, "invalid_date_format"))
        .when(f.isin(*DATE_FIELDS), result(True, 0.9))
        .when(f.isin(*NAME_FIELDS) & (F.length(digits) > F.length(solid) * 0.5), result(False, 0.15, "name_high_digit_ratio"))
        .when(f.isin(*NAME_FIELDS) & (F.size(words) == 1) & (F.length(v) < 6), result(True, 0.4, "short_name_candidate"))
        .when(f.isin(*HIGH_RISK) & quality.isin("poor", "unusable"), result(True, 0.3, "low_quality_page"))
        .otherwise(result(True, 1.0))
    )


def quality_gated(field: Column, value: Column, quality: Column, confidence: Column) -> Column:
    """(confidence, review, notes): confidence times the page's and the value's factors; what needs a reviewer, and why."""
    check = candidate_check(field, value, quality)
    base = F.coalesce(confidence, F.lit(0.0)) * lookup(quality, QUALITY_FACTORS, QUALITY_FACTORS["unavailable"])
    final = F.least(F.lit(1.0), F.greatest(F.lit(0.0), base * check["factor"]))
    final = F.when(check["valid"] & (check["factor"] < 1.0), F.greatest(final, F.least(base, F.lit(SOFT_FLOOR)))).otherwise(final)
    low = quality.isin("poor", "unusable", "unavailable")
    risky = canonical_field(field).isin(*HIGH_RISK) & (quality != "good")
    notes = F.array_distinct(F.array_compact(F.array(F.when(low, F.concat(F.lit("Autofill promotion blocked due to OCR quality ("), quality, F.lit(")"))).when(risky, F.concat(F.lit("High-risk field requires good OCR quality (current: "), quality, F.lit(")"))), check["reason"])))
    return F.struct(final.alias("confidence"), (low | risky | ~check["valid"]).alias("review"), F.array_join(notes, "; ").alias("notes"))


def hardened(value: Column, confidence: Column, low_quality: Column) -> Column:
    """(confidence, review, notes): on low-quality text at most 0.4, with a note, and one more for values of under 10 characters."""
    size = F.length(F.trim(F.coalesce(value, F.lit(""))))
    capped = F.when(low_quality, F.least(F.coalesce(confidence, F.lit(0.4)), F.lit(0.4))).otherwise(confidence)
    notes = F.array_compact(F.array(F.when(low_quality, "Autofill downgraded due to low-quality OCR"), F.when(low_quality & (size < 10), F.concat(F.lit("Autofill downgraded: short value ("), size.cast("string"), F.lit(" chars) on low-quality OCR")))))
    return F.struct(capped.alias("confidence"), low_quality.alias("review"), F.array_join(notes, "; ").alias("notes"))


def autofill(candidates: DataFrame, dossier: DataFrame, overwrite: bool = False) -> DataFrame:
    """The dossier after a run: (case_id, field, value, confidence, status).

    candidates (case_id, field, value, confidence, ord, quality); dossier
    (case_id, field, value).  The best candidate of a field passes the gate, the
    field's validator and the quality gate; it then fills the field, unless one
    is there (and overwrite isn't set).  status: kept, extracted, needs_review;
    what fails a gate leaves no row.
    """
    best = candidates.groupBy("case_id", "field").agg(F.max_by(F.struct("value", "confidence", "quality"), F.struct("confidence", -F.col("ord"))).alias("b")).select("case_id", "field", "b.*")

    def passed(df: DataFrame, check: Column) -> DataFrame:
        """Rows whose value a gate lets through, with what it makes of it; a generator, so that checks aren't copied into each other."""
        others = [c for c in df.columns if c != "value"]
        return df.select(*others, F.explode(F.filter(F.array(check), lambda g: g["ok"])).alias("g")).select(*others, F.col("g.value").alias("value"))

    first = passed(best, gate(F.col("field"), F.col("value")))
    second = passed(first, validate(F.col("field"), F.col("value")))
    gated = second.select("case_id", "field", "value", F.explode(F.array(quality_gated(F.col("field"), F.col("value"), F.col("quality"), F.col("confidence")))).alias("q"))
    new = gated.select("case_id", "field", "value", F.col("q.confidence").alias("confidence"), F.when(F.col("q.review"), "needs_review").otherwise("extracted").alias("status"), F.lit(0 if overwrite else 1).alias("_rank"))
    old = dossier.where(F.trim("value") != "").select("case_id", "field", "value", F.lit(None).cast("double").alias("confidence"), F.lit("kept").alias("status"), F.lit(1 if overwrite else 0).alias("_rank"))
    return first_by(old.unionByName(new), ["case_id", "field"], ["_rank"]).drop("_rank")


#: How much a page's quality leaves of a confidence.
QUALITY_FACTORS = {"good": 1.0, "fair": 0.8, "poor": 0.4, "unusable": 0.2, "unavailable": 0.3}
#: Confidence of a value by the method that found it.
METHOD_CONFIDENCE = {"label": 0.92, "anchor": 0.90, "section": 0.85}


def lookup(column: Column, values: dict[str, float], other: float) -> Column:
    out = F
    for k, v in values.items():
        out = out.when(column == k, v)
    return out.otherwise(other)


def classify(text: Column, keywords: dict[str, list[str]]) -> Column:
    """(type, confidence, hits): the class of most keyword hits (capped at 5 each), calibrated by its margin."""
    low = F.lower(text)

    def hits(words: list[str]) -> Column:
        total = F.lit(0)
        for w in words:
            total = total + F.least(((F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w)).cast("int"), F.lit(5))
        return total

    ranked = F.sort_array(F.array(*[F.struct(hits(w).alias("hits"), F.lit(-i).alias("i"), F.lit(k).alias("type")) for i, (k, w) in enumerate(keywords.items())]), False)
    top, second = ranked[0], ranked[1]
    margin = (top["hits"] - second["hits"]) / F.greatest(top["hits"], F.lit(1))
    confidence = F.greatest(F.lit(0.55), F.least(F.lit(0.98), 0.55 + 0.4 * margin + 0.02 * (top["hits"] - 1)))
    return F.struct(F.when(top["hits"] == 0, "unknown").otherwise(top["type"]).alias("type"), F.when(top["hits"] == 0, 0.3).otherwise(F.round(confidence, 4)).alias("confidence"), top["hits"].alias("hits"))


def name_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value, accepted, score, reasons): lines that could be a person's name."""
    v = F.trim(F.regexp_replace("line", "[ \\t]+", " "))
    words = F.size(F.filter(F.split(v, " "), lambda w: w != ""))
    rules = [("empty", v == ""), ("digits", v.rlike("[0-9]")), ("long", F.length(v) > 60), ("sentence", v.contains(". ")), ("one word", words < 2), ("many words", words > 5), ("signs", v.rlike("[|@=#$%&*]"))]
    reasons = F.array_compact(F.array(*[F.when(c, n) for n, c in rules]))
    score = F.round(F.least(words / 3, F.lit(1.0)) * 0.5 + F.when(v.rlike("^[A-ZÀ-Þ]"), 0.5).otherwise(0.2), 4)
    return lines.select(*keys, v.alias("value"), ((F.size(reasons) == 0) & (score >= 0.75)).alias("accepted"), score.alias("score"), F.array_join(reasons, ",").alias("reasons"))


#: Words that no line of a name has.
NAME_STOPS = (
    "appears", "lawful", "owner", "property", "competent", "sell", "vide", "reference", "letter", "regard", "hereby", "whereas", "submitted", "observed", "plot", "khasra", "mouza", "tehsil", "district", "lda", "dha", "rda", "in", "of", "the", "and", "to",
    "for", "with", "through", "under", "above", "mentioned", "shall", "will", "may", "has", "have", "had", "is", "are", "was", "were", "been", "being", "be", "do", "does", "did", "done", "can", "could", "should", "would", "must", "might", "this", "that",
    "these", "those", "a", "an", "as", "at", "by", "from", "into", "on", "onto", "per", "than", "up", "via", "within", "without",
)
NAME_VERBS = (
    "appears", "undertakes", "declares", "states", "confirms", "certifies", "submits", "requests", "authorizes", "agrees", "shall", "will", "may", "has", "have", "had", "is", "are", "was", "were", "been", "being", "be", "do", "does", "did", "done",
    "can", "could", "should", "would", "must", "might", "acknowledges", "warrants", "represents", "covenants",
)
KIN = "(?i)^[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*,\\s*(?:son|s/o|d/o|w/o)"
#: As KIN, for Java: its groups recurse for each repetition unless they are possessive, and a line of thousands of words overflows a task's stack, which ends the executor. What follows the words is no part of one, so nothing is lost.
_KIN_POSSESSIVE = KIN.replace(")*,", ")*+,")
LEAST_NAME_SCORE = 0.75


def scored_name_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line, accepted, score, flags) of every line that isn't blank.

    Seven filters reject a line, each with its flag; a line that passes them all
    is scored by its initials, short words and capitals, and is accepted from
    0.75 on.  Rejected lines that reach the score have it too.
    """
    x = lines.select(*keys, F.trim(F.regexp_replace("line", "^\\s+|\\s+$", "")).alias("line")).where("line <> ''")
    x = x.withColumn("_w", F.filter(F.split("line", "\\s+"), lambda w: w != ""))
    words, low, n = F.col("_w"), F.transform("_w", F.lower), F.size("_w")
    letters = F.length(F.regexp_replace("line", "[^\\p{L}\\s]", "")) / F.length("line")
    filters = [
        ("too_long", F.length("line") > 60), ("has_digits", F.col("line").rlike("(?U)\\d")), ("has_sentence_punct", F.col("line").rlike("[;:]")), ("has_comma", F.contains("line", F.lit(",")) & ~F.col("line").rlike(_KIN_POSSESSIVE)), ("bad_token_count", (n < 2) | (n > 5)),
        ("has_stopword", F.arrays_overlap(low, F.array(*[F.lit(w) for w in NAME_STOPS]))), ("has_sentence_verb", F.arrays_overlap(low, F.array(*[F.lit(w) for w in NAME_VERBS]))), ("low_alpha_ratio", letters < 0.85),
    ]
    hard = F.array_compact(F.array(*[F.when(c, name) for name, c in filters]))
    single = F.size(F.filter(words, lambda w: F.length(w) == 1))
    short = F.size(F.filter(words, lambda w: F.length(w) == 2))
    proper = F.forall(words, lambda w: F.substring(w, 1, 1).rlike("\\p{Lu}"))
    score = F.lit(1.0) - F.when(single > 1, 0.1 * (single - 1)).otherwise(0.0) - F.when(short > 3, 0.15).otherwise(0.0) + F.when(proper, 0.05).otherwise(0.0)
    soft = F.array_compact(F.array(F.when(single > 1, "many_initials").when(single == 1, "has_initial"), F.when(short > 3, "many_short_tokens").when(short > 0, "has_short_tokens"), F.when(proper, "proper_case")))
    x = x.select(*keys, "line", hard.alias("_hard"), F.round(score, 4).alias("_score"), soft.alias("_soft"))
    passed, enough = F.size("_hard") == 0, F.col("_score") >= LEAST_NAME_SCORE
    flags = F.when(~passed, F.col("_hard")).when(enough, F.col("_soft")).otherwise(F.concat(F.array(F.lit("low_score")), "_soft"))
    return x.select(*keys, "line", (passed & enough).alias("accepted"), F.when(passed, F.col("_score")).alias("score"), F.array_join(flags, ",").alias("flags"))


LEAST_CONFIDENCE, LEAST_WORDS = 0.55, 10


def chosen_engine(attempts: DataFrame, key: str, force: Column | None = None) -> DataFrame:
    """(key, engine, confidence, words, used_fallback) of attempts (key, engine, confidence, words).

    The primary attempt stands unless its confidence is under 0.55 or it has
    under ten words (or force holds): then the fallback counts if it is surer,
    or as sure with more words.  If what is chosen is still as poor and there is
    a text-only attempt, that one counts.
    """
    one = lambda e: F.max(F.when(F.col("engine") == e, F.struct("engine", "confidence", "words"))).alias(e)
    x = attempts.groupBy(key).agg(one("primary"), one("fallback"), one("text_only"), F.max(force if force is not None else F.lit(False)).alias("_force"))
    poor = lambda a: (a["confidence"] < LEAST_CONFIDENCE) | (a["words"] < LEAST_WORDS)
    p, f = F.col("primary"), F.col("fallback")
    better = (f["confidence"] > p["confidence"]) | ((f["confidence"] == p["confidence"]) & (f["words"] > p["words"]))
    x = x.withColumn("_best", F.when((F.col("_force") | poor(p)) & F.coalesce(better, F.lit(False)), f).otherwise(p))
    x = x.withColumn("_best", F.when(poor(F.col("_best")) & F.col("text_only").isNotNull(), F.col("text_only")).otherwise(F.col("_best")))
    return x.select(key, "_best.*", (F.col("_best.engine") != "primary").alias("used_fallback"))


#: Labels of spans, and the mean confidence that a span needs.
SPAN_LABELS = ("PERSON_NAME", "CNIC", "PLOT_NO", "SCHEME_NAME", "REGISTRY_NO", "DATE", "AMOUNT")
LEAST_SPAN, LEAST_CNIC_SPAN = 0.60, 0.70


def token_spans(tokens: DataFrame, page: str, keep_low: bool = False) -> DataFrame:
    """(page, label, value, first, size, confidence, low) of tokens (page, word_no, token_no, word, label, confidence).

    A word takes the label of its surest token (the first of equals), B- and I-
    removed; other labels than SPAN_LABELS are O.  Neighbouring words of one
    label are a span; its mean confidence must be 0.60, 0.70 for CNIC, else it
    is low and left out.  Spans with a word of broken text are left out.
    """
    bare = F.regexp_replace("label", "^[BI]-", "")
    words = tokens.groupBy(page, "word_no").agg(F.min("word").alias("word"), F.max_by(F.struct(F.when(bare.isin(*SPAN_LABELS), bare).otherwise("O").alias("label"), "confidence"), F.struct("confidence", -F.col("token_no"))).alias("best")).select(page, "word_no", "word", "best.*")
    w = Window.partitionBy(page).orderBy("word_no")
    fresh = F.when((F.lag("label").over(w) == F.col("label")) & (F.lag("word_no").over(w) == F.col("word_no") - 1), 0).otherwise(1)
    runs = words.withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(w)).withColumn("_bad", broken_token(F.col("word")))
    spans = runs.where("label <> 'O'").groupBy(page, "_run", "label").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_no", "word"))), lambda x: x["word"]), " ").alias("value"), F.min("word_no").alias("first"), F.count("*").alias("size"), F.avg("confidence").alias("confidence"), F.max("_bad").alias("_bad")
    )
    low = F.col("confidence") < F.when(F.col("label") == "CNIC", LEAST_CNIC_SPAN).otherwise(LEAST_SPAN)
    return spans.where("NOT _bad").withColumn("low", low).where(F.lit(keep_low) | ~F.col("low")).drop("_run", "_bad")
