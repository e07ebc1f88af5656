"""Queries of extraction, validation and classification (X, V, C)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Tables
from ..functions.text import squeeze
from ..operators import extraction as X
from ..operators import parties as P
from ..operators import windows as W
from ..operators.extraction import parsed_date  # noqa: F401
from ..registry import query
from ..session import spread

_MAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\\.[A-Za-z0-9.-]+[A-Za-z]"
_IP = "[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}"
_NUM = "[0-9]{13,16}"
PATTERNS = [X.Pattern("email", f"({_MAIL})", 0.9), X.Pattern("ip", f"({_IP})", 0.8), X.Pattern("number", f"({_NUM})", 0.7), X.Pattern("email", "(mailto)", 0.5)]


def found(t: Tables) -> DataFrame:
    return X.extract(t.documents, PATTERNS, ["doc_id"])


def _sql(field: str, regex: str) -> str:
    return f"SELECT doc_id, '{field}' AS field, unnest(regexp_extract_all(text, '{regex}')) AS value FROM documents"


@query("X01_extract_numbers", f"SELECT DISTINCT doc_id, value FROM ({_sql('number', _NUM)})")
def extract_numbers(t: Tables) -> DataFrame:
    return X.distinct_in_rows(t.documents, [p for p in PATTERNS if p.field == "number"], ["doc_id"]).select("doc_id", "value")


@query("X02_extract_names", "WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{2,}, [a-z]+')) AS value FROM documents) SELECT doc_id, min(lower(substr(value, 1, 100))) AS value FROM m WHERE length(value) > 2 GROUP BY doc_id, lower(value)")
def extract_names(t: Tables) -> DataFrame:
    m = X.extract(t.documents, [X.Pattern("name", "([A-Z][a-z]{2,}, [a-z]+)", 0.5)], ["doc_id"])
    return X.distinct_values(m.where("length(value) > 2"), ["doc_id"]).select("doc_id", F.lower(F.substring("value", 1, 100)).alias("value"))


@query("X03_first_match", f"SELECT doc_id, nullif(regexp_extract(text, '({_IP})', 1), '') AS ip, nullif(regexp_extract(text, '({_MAIL})', 1), '') AS email FROM documents")
def first_match(t: Tables) -> DataFrame:
    one = lambda p: F.nullif(F.regexp_extract("text", f"({p})", 1), F.lit(""))
    return t.documents.select("doc_id", one(_IP).alias("ip"), one(_MAIL).alias("email"))


@query("X04_risk_keywords", "SELECT doc_id, concat_ws(', ', CASE WHEN contains(lower(text), 'token') THEN 'token' END, CASE WHEN contains(lower(text), 'license') THEN 'license' END) AS v FROM documents WHERE contains(lower(text), 'token') OR contains(lower(text), 'license')")
def risk_keywords(t: Tables) -> DataFrame:
    low = F.lower("text")
    hits = F.filter(F.array(F.lit("token"), F.lit("license")), lambda k: low.contains(k))
    return t.documents.select("doc_id", hits.alias("h")).where(F.size("h") > 0).select("doc_id", F.array_join("h", ", ").alias("v"))


@query("X05_all_fields", f"SELECT field, count(*) AS n FROM (SELECT DISTINCT * FROM (SELECT doc_id, field, lower(value) AS value FROM ({_sql('number', _NUM)} UNION ALL {_sql('ip', _IP)} UNION ALL {_sql('email', _MAIL)}))) GROUP BY field")
def all_fields(t: Tables) -> DataFrame:
    return X.distinct_in_rows(t.documents, PATTERNS[:3], ["doc_id"]).groupBy("field").agg(F.count("*").alias("n"))


@query("X06_best_of_field", f"SELECT doc_id, field, value FROM (SELECT doc_id, 'ip' AS field, regexp_extract(text, '({_IP})', 1) AS value FROM documents UNION ALL SELECT doc_id, 'number', regexp_extract(text, '({_NUM})', 1) FROM documents UNION ALL SELECT doc_id, 'email', regexp_extract(text, '({_MAIL})', 1) FROM documents) WHERE value <> ''")
def best_of_field(t: Tables) -> DataFrame:
    return X.best_in_rows(t.documents, PATTERNS[:3], ["doc_id"]).select("doc_id", "field", "value")


_TOKENS = "SELECT doc_id, unnest(range(len(string_split(line, ' ')))) AS i, unnest(string_split(line, ' ')) AS word, line_no FROM lines"


@query("X07_token_anchors", f"WITH w AS ({_TOKENS}), n AS (SELECT *, lead(word, 1) OVER (PARTITION BY doc_id, line_no ORDER BY i) AS w1, lead(word, 2) OVER (PARTITION BY doc_id, line_no ORDER BY i) AS w2 FROM w) SELECT doc_id, line_no, CAST(i AS INTEGER) AS i, CASE WHEN regexp_matches(w1, '^[a-z]{{4,}}$') THEN w1 WHEN regexp_matches(w2, '^[a-z]{{4,}}$') THEN w2 END AS value FROM n WHERE word = 'the' AND (regexp_matches(w1, '^[a-z]{{4,}}$') OR regexp_matches(w2, '^[a-z]{{4,}}$'))")
def token_anchors(t: Tables) -> DataFrame:
    """The first acceptable token within two after an anchor token, from array slices of each line."""
    w = F.split("line", " ")
    at = t.lines.select("doc_id", "line_no", w.alias("w"), F.posexplode(w).alias("i", "word")).where("word = 'the'")
    near = F.filter(F.slice("w", F.col("i") + 2, F.lit(2)), lambda x: x.rlike("^[a-z]{4,}$"))
    return at.select("doc_id", "line_no", "i", F.try_element_at(near, F.lit(1)).alias("value")).where("value IS NOT NULL")


@query(
    "X08_entities",
    f"""WITH w AS (SELECT doc_id, line_no, unnest(range(len(string_split(line, ' ')))) AS i, unnest(string_split(line, ' ')) AS word FROM lines),
    p AS (SELECT *, coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id, line_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x FROM w),
    s AS (SELECT doc_id, max(length(line)) AS wide, count(*) AS high FROM lines GROUP BY doc_id)
    SELECT doc_id, line_no, CAST(i AS INTEGER) AS i, CASE WHEN regexp_full_match(word, '{_IP}') THEN 'ip' ELSE 'number' END AS label, word AS value,
    CAST(x * 1000 // greatest(wide, 1) AS INTEGER) AS x0, CAST(line_no * 1000 // high AS INTEGER) AS y0, CAST((x + length(word)) * 1000 // greatest(wide, 1) AS INTEGER) AS x1, CAST((line_no + 1) * 1000 // high AS INTEGER) AS y1
    FROM p JOIN s USING (doc_id) WHERE regexp_full_match(word, '{_IP}') OR regexp_full_match(word, '{_NUM}')""",
)
def entities(t: Tables) -> DataFrame:
    """Tokens of a page with their boxes; of the patterns' labels, two are wanted."""
    words = F.split("line", " ")
    page = t.lines.groupBy("doc_id").agg(F.greatest(F.max(F.length("line")), F.lit(1)).alias("width"), F.count("*").alias("height"))
    size = F.aggregate(F.slice("w", F.lit(1), F.col("i")), F.lit(0), lambda n, x: n + F.length(x) + 1)
    at = t.lines.select("doc_id", "line_no", words.alias("w"), F.posexplode(words).alias("i", "word")).where(F.col("word").rlike("[0-9]")).withColumn("left", size)
    boxes = at.select("doc_id", "line_no", "i", "word", "left", F.col("line_no").alias("top"), (F.col("left") + F.length("word")).alias("right"), (F.col("line_no") + 1).alias("bottom"))
    return X.entity_tokens(boxes.join(page, "doc_id"), [PATTERNS[1], PATTERNS[2], PATTERNS[0]], ["ip", "number"], ["doc_id", "line_no", "i"])


@query("X09_name_lines", "SELECT count(*) AS n, count(CASE WHEN regexp_matches(trim(line), '[0-9]') THEN 1 END) AS with_digits FROM lines")
def name_lines(t: Tables) -> DataFrame:
    n = X.name_lines(t.lines, ["doc_id", "line_no"])
    return n.agg(F.count("*").alias("n"), F.count(F.when(F.concat(F.lit(","), "reasons", F.lit(",")).contains(",digits,"), 1)).alias("with_digits"))


@query("X10_domain_hints", f"WITH h AS (SELECT DISTINCT doc_id, field, value FROM ({_sql('number', '[0-9]{5,}')} UNION ALL {_sql('ip', _IP)})) SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY field, value) <= 100")
def domain_hints(t: Tables) -> DataFrame:
    h = X.extract(t.documents, [X.Pattern("number", "([0-9]{5,})", 0.6), X.Pattern("ip", f"({_IP})", 0.8)], ["doc_id"]).select("doc_id", "field", "value").distinct()
    return W.first_by(h, ["doc_id"], ["field", "value"], 100)


#: Pages of deeds: a case's order lines choose among these, in the order of their numbers.
DEED_LINES = ["Sale Deed", "Vendor: Ali Raza Khan", "3520112345671", "Purchaser", "Bilal Ahmed Qureshi", "نام بمعہ ولدیت: کاشف زابد", "مشتری", "بائع", "Witness: Hamza Tariq Mehmood; s/o X", "35202-7654321-3", "it is hereby agreed as follows", "گواہان", "Dr. Nadia Hassan Malik", ""]


def deed_lines(t: Tables) -> DataFrame:
    line = F.element_at(F.array(*[F.lit(x) for x in DEED_LINES]), ((F.col("l_orderkey") + F.col("l_partkey")) % len(DEED_LINES) + 1).cast("int"))
    return t.raw("lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("l_linenumber").alias("line_no"), F.col("l_partkey").alias("part"), line.alias("line"))


@query("X11_party_roles")
def party_roles(t: Tables) -> DataFrame:
    """Each order as a deed of a few lines; tests/test_parties.py holds the plan against a plain form, document by document."""
    return P.party_roles(deed_lines(t).groupBy("doc_id", "page", "line_no").agg(F.min_by("line", "part").alias("line")))


_DEED = "|".join(P.DEED_WORDS)


@query("X12_document_test", f"SELECT doc_id, regexp_matches(lower(text), '{_DEED}') OR contains(lower(text), 'license') AS v FROM documents")
def document_test(t: Tables) -> DataFrame:
    """Deeds by their words; licences are let in, as few of the given texts are deeds."""
    return t.documents.select("doc_id", (P.is_sale_deed(F.col("text")) | F.lower("text").contains("license")).alias("v"))


_DEEDS = "SELECT l_orderkey, l_linenumber, l_partkey, ([" + ", ".join(f"'{x}'" for x in DEED_LINES) + f"])[(l_orderkey + l_partkey) % {len(DEED_LINES)} + 1] AS line FROM lineitem"


@query("X12b_section_markers", f"SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN contains(line, 'بائع') OR contains(lower(line), 'vendor') THEN 'seller' WHEN contains(line, 'مشتری') OR contains(lower(line), 'purchaser') THEN 'buyer' WHEN contains(line, 'گواہ') OR contains(lower(line), 'witness') THEN 'witness' END AS role FROM ({_DEEDS})")
def section_markers(t: Tables) -> DataFrame:
    return deed_lines(t).select(F.col("doc_id").alias("l_orderkey"), F.col("line_no").alias("l_linenumber"), F.col("part").alias("l_partkey"), P.section_of(F.col("line")).alias("role"))


@query("X13_structured", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Ali Raza' WHEN 1 THEN 'Mr X' END AS seller, CASE event_id % 4 WHEN 0 THEN 'Bilal Khan' WHEN 1 THEN 'Sara Bibi' END AS buyer FROM events")
def structured(t: Tables) -> DataFrame:
    texts = F.array(F.lit("between Ali Raza (hereinafter called the Vendor) and Bilal Khan (hereinafter called the Vendee)"), F.lit("BETWEEN Mr X\n (HEREINAFTER so called VENDOR)\n AND Sara Bibi s/o Y (hereinafter be called vendee)"), F.lit("between the property of Z (hereinafter called Vendor) and A, B (hereinafter called Vendee)"), F.lit("nothing"))
    return spread(t.audit.select("event_id")).select("event_id", P.vendor_and_vendee(F.element_at(texts, (F.col("event_id") % 4 + 1).cast("int"))).alias("v")).select("event_id", "v.seller", "v.buyer")


_D = "regexp_replace(v, '[^0-9]', '', 'g')"


@query("V01_gate", f"WITH x AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'party.cnic' WHEN 1 THEN 'consideration.amount' ELSE 'title' END AS key, CASE event_id % 3 WHEN 0 THEN '35202 1234567 ' || (event_id % 20) WHEN 1 THEN CASE WHEN event_id % 2 = 0 THEN 'Rs ' ELSE '' END || (event_id % 5000) ELSE trim(action) END AS v FROM audit) SELECT event_id, CASE WHEN key = 'party.cnic' THEN CASE WHEN length({_D}) = 13 THEN substr({_D}, 1, 5) || '-' || substr({_D}, 6, 7) || '-' || substr({_D}, 13, 1) END WHEN key = 'title' THEN v ELSE CASE WHEN length({_D}) >= 4 OR contains(v, 'Rs') THEN {_D} END END AS value FROM x")
def gate_query(t: Tables) -> DataFrame:
    k = F.col("event_id") % 3
    x = t.audit.select("event_id", F.when(k == 0, "party.cnic").when(k == 1, "consideration.amount").otherwise("title").alias("key"), F.when(k == 0, F.concat(F.lit("35202 1234567 "), (F.col("event_id") % 20).cast("string"))).when(k == 1, F.concat(F.when(F.col("event_id") % 2 == 0, "Rs ").otherwise(""), (F.col("event_id") % 5000).cast("string"))).otherwise(F.trim("action")).alias("v"))
    return x.select("event_id", X.gate(F.col("key"), F.col("v"))["value"].alias("value"))


KEYS = ["party.name", "party.cnic", "property.plot_number", "property.khasra_number", "registry.number", "estamp.id", "title"]
VALUES = [
    "Ali Khan", "Ab", "the owner of it", "Muhammad Ali, Esq", "A1 2345 99", "one two three four five six seven eight nine", "کاشف زابد", "ولد کریم", "x" * 85, "CNIC: 35202-1234567-1", "3520212345671", "35202  1234567 1", "3520-21",
    "Plot No. 12", "Plot # 99999", "0", "123/4, 125-1", "Book 5/Vol-2", "this is the book of deeds", "AB/12; x", "e-Stamp No: PB-LHR-123", "PSID 9", "", "Al-1 == 9", "challan number: 77 a",
]
_KV = f"SELECT event_id, ([{', '.join(repr(k) for k in KEYS)}])[event_id % 7 + 1] AS k, trim(regexp_replace(([{', '.join(repr(v) for v in VALUES)}])[(event_id // 7) % {len(VALUES)} + 1], '\\s+', ' ', 'g')) AS v FROM events"
_SOLID = "regexp_replace(v, '\\s', '', 'g')"
_TOLD = "regexp_matches(lower(v), '" + "|".join(X.NARRATIVE) + "')"
_CN = "regexp_replace(regexp_replace(v, '^(cnic|nic|id)\\s*:?\\s*', '', 'i'), '[\\s.-]', '', 'g')"
_PN = "regexp_extract(v, '([0-9]+)', 1)"
_ES = "trim(regexp_replace(v, '^(e[-\\s]?stamp|estamp|stamp\\s*paper|psid|challan)\\s*(?:id|no\\.?|number)?\\s*:?\\s*', '', 'i'))"
_KH = "regexp_extract_all(v, '[0-9]+[/-][0-9]+')"
_FAULT = f"""CASE k
    WHEN 'party.name' THEN CASE WHEN length(v) > 80 THEN 'too long' WHEN length(v) < 3 THEN 'too short' WHEN {_TOLD} THEN 'narrative' WHEN regexp_matches(v, '[.,;:!?]') THEN 'punctuation'
        WHEN length(regexp_replace({_SOLID}, '[^0-9]', '', 'g')) > 0.2 * length({_SOLID}) THEN 'digits' WHEN len(string_split(v, ' ')) > 8 THEN 'too many words'
        WHEN length(regexp_replace({_SOLID}, '[^\\p{{L}}]', '', 'g')) < CASE WHEN regexp_matches(v, '[\\p{{Arabic}}]') AND NOT regexp_matches(v, '[A-Za-z]') THEN 0.45 ELSE 0.7 END * length({_SOLID}) THEN 'few letters' END
    WHEN 'party.cnic' THEN CASE WHEN NOT regexp_full_match({_CN}, '[0-9]{{13}}') THEN 'invalid CNIC format' END
    WHEN 'property.plot_number' THEN CASE WHEN {_PN} = '' THEN 'no number' WHEN length({_PN}) > 9 OR NOT CAST({_PN} AS HUGEINT) BETWEEN 1 AND 9999 THEN 'out of range' END
    WHEN 'property.khasra_number' THEN CASE WHEN len({_KH}) = 0 THEN 'no khasra' END
    WHEN 'registry.number' THEN CASE WHEN length(v) > 40 THEN 'too long' WHEN regexp_matches(v, '[.,;:!?]') THEN 'punctuation' WHEN len(string_split(v, ' ')) > 3 AND len(list_intersect(string_split(lower(v), ' '), ['the', 'is', 'are', 'was', 'were', 'this', 'that', 'with', 'from', 'for'])) > 0 THEN 'narrative' WHEN NOT regexp_full_match(v, '[A-Za-z0-9/ -]+') THEN 'invalid characters' END
    WHEN 'estamp.id' THEN CASE WHEN length({_ES}) > 50 THEN 'too long' WHEN {_ES} = '' THEN 'empty' WHEN NOT regexp_full_match({_ES}, '[A-Za-z0-9_-]+') THEN 'invalid characters' END END"""
_GOOD = f"CASE k WHEN 'party.cnic' THEN substr({_CN}, 1, 5) || '-' || substr({_CN}, 6, 7) || '-' || substr({_CN}, 13, 1) WHEN 'property.plot_number' THEN {_PN} WHEN 'property.khasra_number' THEN replace(array_to_string({_KH}, ', '), '-', '/') WHEN 'registry.number' THEN upper(v) WHEN 'estamp.id' THEN upper({_ES}) ELSE v END"


def keyed_values(t: Tables, keys: list[str], values: list[str]) -> DataFrame:
    nth = lambda of, n: F.element_at(F.array(*[F.lit(x) for x in of]), (n % len(of) + 1).cast("int"))
    return t.raw("events").select("event_id", nth(keys, F.col("event_id")).alias("k"), nth(values, F.expr(f"event_id div {len(keys)}")).alias("v"), "value")


@query("V02_field_validators", f"SELECT event_id, reason, CASE WHEN reason IS NULL THEN {_GOOD} END AS value FROM (SELECT *, {_FAULT} AS reason FROM ({_KV}))")
def field_validators(t: Tables) -> DataFrame:
    """Every value under every key, so each validator meets each kind of fault; the value of a key without one is only trimmed."""
    x = keyed_values(t, KEYS, VALUES).select("event_id", X.validate(F.col("k"), squeeze(F.col("v"))).alias("r"))
    return x.select("event_id", "r.reason", "r.value")


FIELDS = ["party.seller.names", "party.cnic", "consideration.amount", "registry.registry_date", "document.execution_date", "property.khasra_numbers", "x.lien_status", "owner_name", "title"]
GIVEN = ["Ali", "Ali Raza Khan", "A1 23456", "---", "35202-1234567-1", "3520212345671", "35202 12", "Rs 5,000", "5,000.00", "12/01/2022", "on 2022-1-12 at", "12 Jan 2022", "", "x", "  ab  ", "کاشف زابد"]
_FV = f"SELECT event_id, value AS q, ([{', '.join(repr(k) for k in ['seller_name', 'cnic', 'amount', 'registration_date', 'execution_date', 'khasra_number', 'lien_status', 'owner_name', 'title'])}])[event_id % 9 + 1] AS f, trim(([{', '.join(repr(v) for v in GIVEN)}])[(event_id // 9) % {len(GIVEN)} + 1]) AS v FROM events"
_LEAST = "CASE f WHEN 'seller_name' THEN 4 WHEN 'owner_name' THEN 4 WHEN 'cnic' THEN 15 WHEN 'amount' THEN 1 WHEN 'khasra_number' THEN 2 WHEN 'registration_date' THEN 6 WHEN 'lien_status' THEN 3 ELSE 0 END"
_DG = "regexp_replace(v, '[^0-9]', '', 'g')"
_CHECK = f"""CASE WHEN NOT regexp_matches(v, '[A-Za-z0-9\\p{{Arabic}}]') THEN 'F|0.0|junk_token_pattern' WHEN length(v) < {_LEAST} THEN 'F|0.1|short_' || f || '_candidate'
    WHEN f = 'cnic' THEN CASE WHEN length({_DG}) = 13 THEN 'T|1.0|' ELSE 'F|0.15|invalid_cnic_format' END
    WHEN f = 'amount' AND NOT regexp_full_match(regexp_replace(v, '[\\s,.]', '', 'g'), '[0-9]+') THEN 'F|0.2|malformed_amount'
    WHEN f IN ('registration_date', 'execution_date') THEN CASE WHEN regexp_matches(v, '\\b[0-9]{{1,4}}[./-][0-9]{{1,2}}[./-][0-9]{{1,4}}\\b') THEN 'T|0.9|' ELSE 'F|0.2|invalid_date_format' END
    WHEN f IN ('seller_name', 'owner_name') AND length({_DG}) > 0.5 * length(regexp_replace(v, '\\s', '', 'g')) THEN 'F|0.15|name_high_digit_ratio'
    WHEN f IN ('seller_name', 'owner_name') AND NOT contains(v, ' ') AND length(v) < 6 THEN 'T|0.4|short_name_candidate'
    WHEN f IN ('seller_name', 'owner_name', 'cnic', 'amount', 'khasra_number') AND q < 45 THEN 'T|0.3|low_quality_page' ELSE 'T|1.0|' END"""


def _quality(value):
    """Levels as quality_level gives them: poor under 0.45."""
    from ..operators.kpis import quality_level

    return quality_level(value / 100)


@query("V03_validate_candidate", f"SELECT event_id, r[1] = 'T' AS valid, CAST(r[2] AS DOUBLE) AS factor, nullif(r[3], '') AS reason FROM (SELECT event_id, string_split({_CHECK}, '|') AS r FROM ({_FV}))")
def validate_candidate(t: Tables) -> DataFrame:
    x = keyed_values(t, FIELDS, GIVEN)
    return x.select("event_id", X.candidate_check(F.col("k"), F.col("v"), _quality(F.col("value"))).alias("r")).select("event_id", "r.*")


_LV = "CASE WHEN value >= 70 THEN 1.0 WHEN value >= 45 THEN 0.8 WHEN value >= 30 THEN 0.4 ELSE 0.2 END"


@query("V04_quality_gate", f"SELECT event_id, round(0.9 * {_LV}, 6) AS confidence, {_LV} < 0.8 AS review FROM audit")
def quality_gate(t: Tables) -> DataFrame:
    from ..operators.kpis import quality_level

    factor = X.lookup(quality_level(F.col("value") / 100), X.QUALITY_FACTORS, 0.3)
    return t.audit.select("event_id", F.round(0.9 * factor, 6).alias("confidence"), (factor < 0.8).alias("review"))


@query("V05_cap_low_quality", "SELECT event_id, CASE WHEN value < 45 THEN least(value / 100, 0.4) ELSE value / 100 END AS confidence, value < 45 AS review, CASE WHEN value >= 45 THEN '' WHEN length(trim(props)) < 10 THEN 'Autofill downgraded due to low-quality OCR; Autofill downgraded: short value (' || length(trim(props)) || ' chars) on low-quality OCR' ELSE 'Autofill downgraded due to low-quality OCR' END AS notes FROM audit")
def cap_low_quality(t: Tables) -> DataFrame:
    return t.audit.select("event_id", X.hardened(F.col("props"), F.col("value") / 100, F.col("value") < 45).alias("h")).select("event_id", "h.*")


_LEVEL = "CASE WHEN q >= 70 THEN 'good' WHEN q >= 45 THEN 'fair' WHEN q >= 30 THEN 'poor' ELSE 'unusable' END"
_FOUND = f"SELECT doc_id, doc_id * 37 % 100 AS q, 'party.cnic' AS f, regexp_extract(text, '({_NUM})', 1) AS v, 0.7 AS c FROM documents UNION ALL SELECT doc_id, doc_id * 37 % 100, 'party.email', regexp_extract(text, '({_MAIL})', 1), 0.9 FROM documents UNION ALL SELECT doc_id, doc_id * 37 % 100, 'property.plot_number', regexp_extract(text, '({_IP})', 1), 0.8 FROM documents"
_FACTOR = "CASE WHEN q >= 70 THEN 1.0 WHEN q >= 45 THEN 0.8 WHEN q >= 30 THEN 0.4 ELSE 0.2 END"


@query(
    "V06_autofill",
    f"""WITH b AS (SELECT * FROM ({_FOUND}) WHERE v <> ''),
    g AS (SELECT doc_id, q, f, c, CASE f WHEN 'party.cnic' THEN substr(v, 1, 5) || '-' || substr(v, 6, 7) || '-' || substr(v, 13, 1) WHEN 'property.plot_number' THEN regexp_extract(v, '([0-9]+)', 1) ELSE v END AS v FROM b
        WHERE f = 'party.email' OR (f = 'party.cnic' AND length(v) = 13) OR (f = 'property.plot_number' AND CAST(regexp_extract(v, '([0-9]+)', 1) AS INTEGER) BETWEEN 1 AND 9999)),
    r AS (SELECT *, {_FACTOR} AS pf, f <> 'party.email' AS risky, f = 'property.plot_number' AND length(v) < 2 AS short FROM g),
    n AS (SELECT doc_id AS case_id, f AS field, v AS value, round(CASE WHEN short THEN c * pf * 0.1 WHEN risky AND f <> 'party.cnic' AND q < 45 THEN greatest(c * pf * 0.3, least(c * pf, 0.05)) ELSE c * pf END, 6) AS confidence, CASE WHEN q < 45 OR (risky AND q < 70) OR short THEN 'needs_review' ELSE 'extracted' END AS status FROM r),
    o AS (SELECT doc_id AS case_id, 'party.email' AS field, 'kept' AS value, CAST(NULL AS DOUBLE) AS confidence, 'kept' AS status FROM documents WHERE doc_id % 2 = 1)
    SELECT * FROM o UNION ALL SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.case_id = n.case_id AND o.field = n.field)""",
)
def autofill(t: Tables) -> DataFrame:
    """Candidates of all documents through both gates and the quality gate; every odd document's email is filled already."""
    names = {"number": "party.cnic", "email": "party.email", "ip": "property.plot_number"}
    best = X.best_in_rows(t.documents, PATTERNS[:3], ["doc_id"])
    candidates = best.select(F.col("doc_id").alias("case_id"), X.lookup(F.col("field"), names, None).alias("field"), "value", "confidence", F.lit(0).alias("ord"), _quality(F.col("doc_id") * 37 % 100).alias("quality"))
    filled = t.documents.where("doc_id % 2 = 1").select(F.col("doc_id").alias("case_id"), F.lit("party.email").alias("field"), F.lit("kept").alias("value"))
    return X.autofill(candidates, filled).withColumn("confidence", F.round("confidence", 6))


@query("V07_method_confidence", "SELECT event_id, CASE action WHEN 'click' THEN 0.92 WHEN 'view' THEN 0.90 WHEN 'error' THEN 0.85 ELSE 0.70 END AS confidence FROM audit")
def method_confidence(t: Tables) -> DataFrame:
    method = F.when(F.col("action") == "click", "label").when(F.col("action") == "view", "anchor").when(F.col("action") == "error", "section")
    return t.audit.select("event_id", X.lookup(method, X.METHOD_CONFIDENCE, 0.70).alias("confidence"))


_KEYS = {"licensed": ["license", "public"], "insult": ["idiot", "clown", "trash"], "secret": ["token", "password"]}
_H = {k: " + ".join(f"least((length(lower(text)) - length(replace(lower(text), '{w}', ''))) // {len(w)}, 5)" for w in ws) for k, ws in _KEYS.items()}


@query("C01_classify", f"WITH h AS (SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in _H.items())} FROM documents) SELECT doc_id, CASE WHEN greatest(licensed, insult, secret) = 0 THEN 'unknown' WHEN licensed >= insult AND licensed >= secret THEN 'licensed' WHEN insult >= secret THEN 'insult' ELSE 'secret' END AS type, CAST(greatest(licensed, insult, secret) AS INTEGER) AS hits FROM h")
def classify(t: Tables) -> DataFrame:
    c = t.documents.select("doc_id", X.classify(F.col("text"), _KEYS).alias("c"))
    return c.select("doc_id", F.col("c.type").alias("type"), F.col("c.hits").alias("hits"))


_TOP = "list_reverse_sort([licensed, insult, secret])"


@query("C02_prediction_review", f"WITH h AS (SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in _H.items())} FROM documents), t AS (SELECT doc_id, {_TOP}[1] AS a, {_TOP}[2] AS b FROM h) SELECT doc_id, CASE WHEN a = 0 THEN 0.3 ELSE round(greatest(0.55, least(0.98, 0.55 + 0.4 * (a - b)::DOUBLE / greatest(a, 1) + 0.02 * (a - 1))), 4) END < 0.7 AS unsure FROM t")
def prediction_review(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", (X.classify(F.col("text"), _KEYS)["confidence"] < 0.7).alias("unsure"))


@query("C03_engine_choice", "SELECT user_id, max(value) AS best, max(value) < 55 AS fallback FROM audit GROUP BY user_id")
def engine_choice(t: Tables) -> DataFrame:
    return t.audit.groupBy("user_id").agg(F.max(F.struct("value", "event_id")).alias("m")).select("user_id", F.col("m.value").alias("best"), (F.col("m.value") < 55).alias("fallback"))


@query("C04_token_spans", "WITH x AS (SELECT *, CASE WHEN value >= 60 THEN action ELSE 'O' END AS label FROM audit), c AS (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY user_id ORDER BY event_id) IS NOT DISTINCT FROM label THEN 0 ELSE 1 END AS ch FROM x), r AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM c) SELECT user_id, min(label) AS label, min(event_id) AS first_id, count(*) AS size FROM r WHERE label <> 'O' GROUP BY user_id, run")
def token_spans(t: Tables) -> DataFrame:
    x = t.audit.withColumn("label", F.when(F.col("value") >= 60, F.col("action")).otherwise("O"))
    runs = W.islands(x, ["user_id"], ["event_id"], F.col("label"))
    return runs.where("label <> 'O'").groupBy("user_id", "run").agg(F.min("label").alias("label"), F.min("event_id").alias("first_id"), F.count("*").alias("size")).drop("run")
