"""Text functions as Column expressions; what no built-in does exactly runs over Arrow arrays."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Arabic letter ranges.
ARABIC = "\\u0600-\\u06FF\\u0750-\\u077F\\u08A0-\\u08FF\\uFB50-\\uFDFF\\uFE70-\\uFEFF"
#: Signs of text that was decoded wrongly: box drawing, blocks, shapes, and single signs.
MOJIBAKE = "\\u2500-\\u257F\\u2580-\\u259F\\u25A0-\\u25FF\\u00BA\\u00FC\\u00BF\\u00BB"
CONTROLS = "\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F"
#: Digits of Arabic script in the order 0 to 9, Arabic-Indic before extended.
DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"


def count_of(text: Column, chars: str) -> Column:
    """How many characters of a class a text has."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]", ""))


def share(part: Column, whole: Column) -> Column:
    """part / whole; NaN, which is above any limit, of nothing."""
    return F.when(whole == 0, F.lit(float("nan"))).otherwise(part / whole)


def rounded(x: Column, places: int) -> Column:
    """x (not negative) to some places as DuckDB rounds it: the product with the power of ten decides, half goes up.

    The built-in round decides by the shortest decimal form, which lies on the other side for some doubles, as 41 / 640.
    """
    product = x * F.lit(10.0**places)
    whole = F.floor(product)
    return F.when(F.isnan(x), x).otherwise((whole + (product - whole >= 0.5).cast("int")) / F.lit(10.0**places))


def printed(x: Column, places: int) -> Column:
    """x to some places as C's printf has it: the double's exact value decides, half to even.

    format_string decides by the shortest decimal form, half up, so 1 / 32 and most ties differ.
    """

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if pd.isna(v) else f"{v:.{places}f}")

    return run(x)


def squeeze(text: Column) -> Column:
    """Runs of white space to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(text, "[ \\t\\n\\r\\f\\x0B]+", " "))


def arabic_ratio(text: Column) -> Column:
    solid = F.length(F.regexp_replace(text, "[ \\t\\n\\r]", ""))
    return F.when(solid == 0, 0.0).otherwise(count_of(text, ARABIC) / solid)


def mojibake(text: Column) -> Column:
    """(corrupted, ratio, count, total): corrupted above a ratio of 0.02 or a count of 2."""
    count, total = count_of(text, MOJIBAKE) + count_of(text, CONTROLS), F.length(text)
    ratio = F.when(total == 0, 0.0).otherwise(count / total)
    return F.struct(((ratio > 0.02) | (count > 2)).alias("corrupted"), ratio.alias("ratio"), count.alias("count"), total.alias("total"))


def broken_token(token: Column) -> Column:
    """Empty, with box-drawing signs, or mostly control characters."""
    controls = F.length(token) - F.length(F.regexp_replace(token, "\\p{C}", ""))
    return (token == "") | token.rlike("[─│┌┐└┘├┤┬┴┼═║╔╗╚╝]") | (controls * 2 > F.length(token))


def corrupted(text: Column) -> Column:
    """(corrupted, reason): empty before mojibake."""
    empty = text.isNull() | (F.trim(text) == "")
    bad = mojibake(text)["corrupted"]
    return F.struct((empty | bad).alias("corrupted"), F.when(empty, "empty").when(bad, "mojibake").otherwise("ok").alias("reason"))


def tidy(text: Column) -> Column:
    """Line ends unified, runs of blanks to one, at most one empty line, line ends and text ends trimmed."""
    out = F.regexp_replace(text, "\\r\\n?", "\n")
    out = F.regexp_replace(out, "[ \\t]+", " ")
    out = F.regexp_replace(out, " +\\n", "\n")
    out = F.regexp_replace(out, "\\n{3,}", "\n\n")
    return F.regexp_replace(out, "^[ \\n]+|[ \\n]+$", "")


def ascii_digits(text: Column) -> Column:
    return F.translate(text, DIGITS + "،۔", "0123456789" * 2 + ",.")


def occurrences(text: Column, phrase: str) -> Column:
    """Non-overlapping occurrences of a phrase."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(phrase), F.lit("")))) / len(phrase)).cast("int")


def any_of(text: Column, phrases: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: text.contains(p))


def ocr_signal(text: Column, confidence: Column) -> Column:
    odd = count_of(text, "^A-Za-z0-9 \\t\\n\\r") / F.length(text)
    return F.when((F.length(F.trim(text)) < 50) | (confidence < 40), "LOW").when(odd > 0.6, "REVIEW_REQUIRED").otherwise("GOOD")


def page_score(text: Column, confidence: Column) -> Column:
    """0.5 min(words / 40, 1) + 0.35 min(mean length / 5, 1) + 0.15 confidence; 0.1 below 5 words; at most 0.29 for very short words."""
    words = F.filter(F.split(text, "[ \\t\\n\\r]+"), lambda w: w != "")
    n = F.size(words)
    chars = F.length(F.regexp_replace(text, "[ \\t\\n\\r]+", ""))
    mean = F.when(n > 0, chars / n).otherwise(0.0)
    score = F.least(n / 40, F.lit(1.0)) * 0.5 + F.least(mean / 5, F.lit(1.0)) * 0.35 + F.coalesce(confidence, F.lit(0.5)) * 0.15
    return F.when(n < 5, 0.1).when(mean < 2.5, F.least(score, F.lit(0.29))).otherwise(score)


def unit_confidence(c: Column) -> Column:
    """Confidences in per cent or per ten thousand to 0..1; negative ones to null."""
    return F.when(c < 0, None).when((c > 1.5) & (c <= 100), c / 100).when(c > 100, F.least(c / 10000 * 100, F.lit(1.0))).otherwise(F.least(c, F.lit(1.0)))


def _some(texts: pa.Array, which: pa.Array, change: Callable[[str], str]) -> pa.Array:
    """The batch with change() in the texts that `which` marks; the others pass as they are, and null ones."""
    hit = pc.fill_null(which, False)
    if not pc.any(hit).as_py():
        return texts
    return pc.replace_with_mask(texts, hit, pa.array([change(x) for x in texts.filter(hit).to_pylist()], texts.type))


def _normalized(texts: pa.Array, form: str) -> pa.Array:
    """ASCII texts are normal in every form.  (Arrow's own utf8_normalize leaves composed forms decomposed.)"""
    return _some(texts, pc.invert(pc.string_is_ascii(texts)), lambda x: unicodedata.normalize(form, x))


@F.arrow_udf(StringType())
def nfkc(texts: pa.Array) -> pa.Array:
    return _normalized(texts, "NFKC")


#: What the first byte of every letter of Arabic script looks like when it is decoded wrongly.
BROKEN = "[ØÙÚÛÝàï]"


def repaired(x: str | None) -> str | None:
    """A text that was UTF-8 read as Latin-1 or Windows-1252, read anew, if that makes it clean and more Arabic."""
    if not x:
        return x
    arabic, signs = re.compile(f"[{ARABIC}]"), re.compile(f"[{MOJIBAKE}{CONTROLS}]")
    for encoding in ("latin-1", "cp1252"):
        try:
            y = x.encode(encoding, "strict" if encoding == "latin-1" else "ignore").decode("utf-8", "strict" if encoding == "latin-1" else "ignore")
        except UnicodeError:
            continue
        if len(y) >= 3 and not signs.search(y) and len(arabic.findall(y)) > len(arabic.findall(x)):
            return y
    return x


def _repaired(texts: pa.Array) -> pa.Array:
    """repaired() of the texts that have a broken letter."""
    return _some(texts, pc.match_substring_regex(texts, BROKEN), repaired)


@F.arrow_udf(StringType())
def repair(texts: pa.Array) -> pa.Array:
    return _repaired(texts)


@F.arrow_udf(StringType())
def persistable(texts: pa.Array) -> pa.Array:
    """Control characters but line ends and tabs out, NFC, repaired."""
    clean = pc.replace_substring_regex(texts, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", "")
    return _repaired(_normalized(clean, "NFC"))


def for_matching(text: Column) -> Column:
    return F.translate(squeeze(F.regexp_replace(nfkc(text), "[^A-Za-z0-9\\u0080-\\uFFFF ]+", " ")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def signature(key: str, text: Column) -> Column:
    """HMAC-SHA256 as two hashes over the padded key, in the JVM."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in raw)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(text, "UTF-8")), 256))), 256)


def render(template: str, values: dict[str, Column]) -> Column:
    """{{name}} replaced by values; unknown names stay."""
    out = F.lit(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("{{" + k + "}}"), F.coalesce(v.cast("string"), F.lit("")))
    return out
