"""Queries of page layout and of hints with a place: spatial joins, label transfer, reading order, dates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Tables
from ..functions import dates as D
from ..functions.text import repair
from ..operators import fields as FD
from ..operators import hints as H
from ..operators import layout as L
from ..operators.anchors import token_entities as token_found
from ..registry import query
from ..session import spread

# --- words and annotations of a page, from order lines ---
_WORDS = "SELECT l_orderkey AS page, l_partkey AS word, l_linenumber AS line, CAST(l_quantity * 10 AS INTEGER) AS x1, CAST(l_partkey % 900 AS INTEGER) AS y1, CAST(l_quantity * 10 + 40 AS INTEGER) AS x2, CAST(l_partkey % 900 + 20 AS INTEGER) AS y2 FROM lineitem"
LABELS = ["DATE", "CNIC", "AMOUNT", "PLOT_NO", "PERSON_NAME", "SCHEME_NAME", "REGISTRY_NO", "STAMP"]
#: By l_suppkey % 4: where a note's box begins against its word, and how large it is; a point in a word, a word's like, a row, a corner of the page.
OFFSETS = [(15, 8, 4, 3), (-3, -2, 44, 22), (-200, -5, 400, 30), (-150, -300, 420, 500)]


def _by_kind(k: int) -> str:
    return f"([{', '.join(str(o[k]) for o in OFFSETS)}])[l_suppkey % 4 + 1]"


_NOTES = f"""SELECT l_orderkey AS page, l_linenumber * 1000000 + l_partkey AS note, ([{', '.join(f"'{x}'" for x in LABELS)}])[l_suppkey % 8 + 1] AS label,
    CAST(l_quantity * 10 AS INTEGER) + {_by_kind(0)} AS ax1, CAST(l_partkey % 900 AS INTEGER) + {_by_kind(1)} AS ay1,
    CAST(l_quantity * 10 AS INTEGER) + {_by_kind(0)} + {_by_kind(2)} AS ax2, CAST(l_partkey % 900 AS INTEGER) + {_by_kind(1)} + {_by_kind(3)} AS ay2 FROM lineitem WHERE l_suppkey % 3 > 0"""
_CUT = "(greatest(0, least(x2, ax2) - greatest(x1, ax1)) * greatest(0, least(y2, ay2) - greatest(y1, ay1)))"
_MATCHED = f"""SELECT * FROM (SELECT *, CASE WHEN {_CUT}::DOUBLE / ((x2 - x1) * (y2 - y1) + (ax2 - ax1) * (ay2 - ay1) - {_CUT}) >= 0.3 THEN 1
    WHEN (ax1 + ax2) / 2.0 BETWEEN x1 AND x2 AND (ay1 + ay2) / 2.0 BETWEEN y1 AND y2 THEN 2 WHEN (x1 + x2) / 2.0 BETWEEN ax1 AND ax2 AND (y1 + y2) / 2.0 BETWEEN ay1 AND ay2 THEN 3 END AS tier FROM ({_WORDS}) JOIN ({_NOTES}) USING (page))
    WHERE tier IS NOT NULL QUALIFY tier = min(tier) OVER (PARTITION BY page, note)"""
_PRIORITY = "CASE label " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in L.PRIORITY.items()) + " END"
KEY = ["page", "word", "line", "x1"]


def words(t: Tables) -> DataFrame:
    x, y = (F.col("l_quantity") * 10).cast("int"), (F.col("l_partkey") % 900).cast("int")
    return t.raw("lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("word"), F.col("l_linenumber").alias("line"), x.alias("x1"), y.alias("y1"), (x + 40).alias("x2"), (y + 20).alias("y2"))


def notes(t: Tables) -> DataFrame:
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("l_suppkey") % n + 1).cast("int"))
    dx, dy, wide, high = (pick([o[k] for o in OFFSETS], 4) for k in range(4))
    x, y = (F.col("l_quantity") * 10).cast("int") + dx, (F.col("l_partkey") % 900).cast("int") + dy
    return t.raw("lineitem").where("l_suppkey % 3 > 0").select(
        F.col("l_orderkey").alias("page"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("note"), pick(LABELS, 8).alias("label"), x.alias("ax1"), y.alias("ay1"), (x + wide).alias("ax2"), (y + high).alias("ay2")
    )


@query("J14b_annotation_join", f"SELECT page, word, line, x1, note, label, tier FROM ({_MATCHED})")
def annotation_join(t: Tables) -> DataFrame:
    """Every annotation of a page against its words, through a grid."""
    return L.matched(words(t), notes(t)).select(*KEY, "note", "label", "tier")


@query("G04b_annotation_labels", f"WITH m AS (SELECT *, {_PRIORITY} AS priority, row_number() OVER (PARTITION BY page, note ORDER BY y1, x1, page, word, line) AS rn FROM ({_MATCHED}) WHERE {_PRIORITY} IS NOT NULL), b AS (SELECT page, word, line, x1, CASE WHEN rn = 1 THEN 'B-' ELSE 'I-' END || label AS tag FROM m QUALIFY row_number() OVER (PARTITION BY page, word, line, x1 ORDER BY priority DESC, note) = 1) SELECT w.page, w.word, w.line, w.x1, coalesce(tag, 'O') AS tag FROM ({_WORDS}) w LEFT JOIN b USING (page, word, line, x1)")
def annotation_labels(t: Tables) -> DataFrame:
    return L.labelled(words(t), notes(t), KEY)


# --- reading order ---
_BOXES = "SELECT l_orderkey AS page, l_partkey AS word, l_linenumber AS line, CAST(l_extendedprice % 1000 AS INTEGER) AS x, CAST(l_partkey % 97 AS INTEGER) AS y, CAST(l_quantity * 3 AS INTEGER) AS h FROM lineitem"


@query("W12b_row_clusters", f"""WITH RECURSIVE b AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y, x, word, line) AS i, CAST(y + h // 2 AS BIGINT) AS c, greatest(10, CAST(trunc(avg(h) OVER (PARTITION BY page) * 0.05) AS BIGINT)) AS tol FROM ({_BOXES})),
    f AS (SELECT page, 0::BIGINT AS i, 0::BIGINT AS tol, []::STRUCT(r INTEGER, c BIGINT)[] AS done FROM b GROUP BY page
        UNION ALL SELECT f.page, b.i, b.tol, list_append(f.done, {{'r': coalesce(list_min(list_transform(list_filter(f.done, lambda d: abs(d.c - b.c) <= b.tol), lambda d: d.r)), list_max(list_transform(f.done, lambda d: d.r)) + 1, 0), 'c': b.c}}) FROM f JOIN b ON b.page = f.page AND b.i = f.i + 1),
    z AS (SELECT page, i, list_last(done).r AS r FROM f WHERE i > 0)
    SELECT b.page, b.word, b.line, z.r AS row, CAST(row_number() OVER (PARTITION BY b.page ORDER BY z.r, y, CASE WHEN b.page % 2 = 0 THEN -x ELSE x END, y, x, word, line) - 1 AS INTEGER) AS pos FROM b JOIN z USING (page, i)""")
def row_clusters(t: Tables) -> DataFrame:
    """Rows of boxes by nearness of centres; pages of even number are read from the right.

    Numbers become whole as SQL casts them, half to even.
    """
    box = t.raw("lineitem").select(
        F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("word"), F.col("l_linenumber").alias("line"), F.rint(F.col("l_extendedprice") % 1000).cast("int").alias("x"), (F.col("l_partkey") % 97).cast("int").alias("y"), F.rint(F.col("l_quantity") * 3).cast("int").alias("h"), F.lit(40).alias("w")
    )
    return L.in_reading_order(box, ["y", "x", "word", "line"], F.col("page") % 2 == 0).select("page", "word", "line", "row", "pos")


# --- dates in text ---
_URDU = "[" + ", ".join(f"'{m}'" for m in D.URDU_MONTHS) + "]"
_FULL = [m for m in D.ENGLISH_MONTHS if len(m) > 3 or m == "may"]
_ENGLISH = "[" + ", ".join(f"'{m}'" for m in _FULL) + "]"
_NOTE = f"""(SELECT o_orderkey, 'Deed ' || strftime(t, '%Y-%m-%d') || chr(10) || 'paid ' || day(t) || '.' || month(t) || '.' || year(t) || ' or ' || day(t) || '/' || month(t) || '/' || year(t)
    || CASE WHEN o_orderkey % 3 = 0 THEN chr(10) || chr(10) || 'on ' || day(t) || '-' || (month(t) + 12) || '-' || year(t) || ', again ' || day(t) || '.' || month(t) || '.' || year(t) ELSE '' END
    || CASE WHEN o_orderkey % 4 = 0 THEN chr(10) || 'seen ' || (day(t) % 28 + 1) || ' ' || ({_ENGLISH})[month(t)] || ' ' || year(t) || ' and ' || day(t) || '-' || upper(substr(({_ENGLISH})[month(t)], 1, 3)) || '. ' || year(t) ELSE '' END
    || CASE WHEN o_orderkey % 5 = 0 THEN chr(10) || '~ ' || (day(t) % 27 + 1) || ' ' || ({_URDU})[month(t)] || chr(10) || year(t) || ' ~' ELSE '' END
    || CASE WHEN o_orderkey % 7 = 0 THEN ' no 2020-13-01, 99.1.2020, 45 May 2021, 1234-12-123' ELSE '' END AS x FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS t FROM orders))"""


def _found(pattern: str) -> str:
    """(raw, line) of each match, as SQL: the text is cut before each match, which ends at a mark."""
    parts = f"string_split(regexp_replace(x, '(?i){pattern}', chr(63742) || '\\0' || chr(63743), 'g'), chr(63742))"
    return f"list_transform(list_filter(list_transform({parts}, lambda p, i: {{'raw': split_part(p, chr(63743), 1), 'line': len(string_split(array_to_string(({parts})[1 : i - 1], ''), chr(10))) - 1, 'i': i}}), lambda s: s.i > 1), lambda s: {{'raw': s.raw, 'line': s.line}})"


_MDY = "lpad(string_split_regex(h.raw, '[./-]')[2], 2, '0') || '-' || lpad(string_split_regex(h.raw, '[./-]')[1], 2, '0')"
_DAY, _MONTH = "CAST(string_split_regex(h.raw, '[./-]')[1] AS INTEGER)", "CAST(string_split_regex(h.raw, '[./-]')[2] AS INTEGER)"


def _month_case(months: dict[str, int]) -> str:
    return "CASE regexp_replace(lower(h.raw), '[0-9\\s.-]', '', 'g') " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in months.items()) + " END"


def _named(months: dict[str, int], branch: int) -> str:
    day = "CAST(regexp_extract(h.raw, '^[0-9]+') AS INTEGER)"
    return f"SELECT o_orderkey, {branch} AS b, n, CASE WHEN {day} BETWEEN 1 AND 31 THEN right(h.raw, 4) || '-' || lpad(CAST({_month_case(months)} AS VARCHAR), 2, '0') || '-' || lpad(CAST({day} AS VARCHAR), 2, '0') END AS value, h.raw AS raw, h.line AS line, 'high' AS confidence, {day} BETWEEN 1 AND 31 AS ok FROM f{branch}"


_DATES = f"""{', '.join(f"f{i} AS (SELECT o_orderkey, unnest(hits) AS h, unnest(range(len(hits))) AS n FROM (SELECT o_orderkey, {_found(p)} AS hits FROM t))" for i, p in enumerate((D.ISO, D.NUMERIC, D.named(D.URDU_MONTHS), D.named(D.ENGLISH_MONTHS))))},
    a AS (SELECT o_orderkey, 0 AS b, n, h.raw AS value, h.raw AS raw, h.line AS line, 'high' AS confidence, CAST(h.raw[6:7] AS INTEGER) BETWEEN 1 AND 12 AND CAST(h.raw[9:10] AS INTEGER) BETWEEN 1 AND 31 AS ok FROM f0
        UNION ALL SELECT o_orderkey, 1, n, CASE WHEN {_DAY} > 12 OR {_MONTH} > 12 THEN right(h.raw, 4) || '-' || {_MDY} END, h.raw, h.line, CASE WHEN {_DAY} > 12 OR {_MONTH} > 12 THEN 'high' ELSE 'low' END, CASE WHEN {_DAY} > 12 THEN {_MONTH} BETWEEN 1 AND 12 AND {_DAY} <= 31 WHEN {_MONTH} > 12 THEN {_DAY} >= 1 ELSE TRUE END FROM f1
        UNION ALL {_named(D.URDU_MONTHS, 2)} UNION ALL {_named(D.ENGLISH_MONTHS, 3)})"""
_HINTS = f"""WITH t AS (SELECT * FROM {_NOTE} q), {_DATES}
    SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY b, n) - 1 AS INTEGER) AS hint, value, raw, CAST(line AS INTEGER) AS line, confidence FROM (SELECT * FROM a WHERE ok QUALIFY row_number() OVER (PARTITION BY o_orderkey, coalesce(value, raw) ORDER BY b, n) = 1)"""


@query("D04b_date_hint_rows", _HINTS)
def date_hint_rows(t: Tables) -> DataFrame:
    """A row for each date hint in notes written from the orders' dates."""
    d, key = F.col("t"), F.col("o_orderkey")
    s = lambda c: c.cast("string")
    nth = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.month(d))
    dated = lambda sep, month=None: F.concat(s(F.dayofmonth(d)), F.lit(sep), s(F.month(d) if month is None else month), F.lit(sep), s(F.year(d)))
    when = lambda n, *parts: F.when(key % n == 0, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])).otherwise("")
    note = F.concat(
        F.lit("Deed "), F.date_format(d, "yyyy-MM-dd"), F.lit("\npaid "), dated("."), F.lit(" or "), dated("/"),
        when(3, "\n\non ", dated("-", F.month(d) + 12), ", again ", dated(".")),
        when(4, "\nseen ", s(F.dayofmonth(d) % 28 + 1), " ", nth(_FULL), " ", s(F.year(d)), " and ", s(F.dayofmonth(d)), "-", F.upper(F.substring(nth(_FULL), 1, 3)), ". ", s(F.year(d))),
        when(5, "\n~ ", s(F.dayofmonth(d) % 27 + 1), " ", nth(list(D.URDU_MONTHS)), "\n", s(F.year(d)), " ~"),
        when(7, " no 2020-13-01, 99.1.2020, 45 May 2021, 1234-12-123"),
    )
    notes = t.raw("orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("t")).select("o_orderkey", note.alias("note"))
    return notes.select("o_orderkey", F.posexplode(D.date_hints(F.col("note"))).alias("hint", "h")).select("o_orderkey", "hint", "h.*")


_DEED_TEXT = "(SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'plain ' || o_custkey ELSE 'فرد ' || o_orderkey || chr(10) || 'کھاتہ نمبر ' || o_custkey END AS x FROM orders)"


def _deed_text(t: Tables):
    n, who = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    return F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("plain "), who)).otherwise(F.concat(F.lit("فرد "), n, F.lit("\nکھاتہ نمبر "), who))


@query("T06b_repaired_notes", f"SELECT o_orderkey, x AS v FROM {_DEED_TEXT} q")
def repaired_notes(t: Tables) -> DataFrame:
    """Notes with Urdu words, read as Latin-1 by mistake, are as they were."""
    broken = F.decode(F.encode(_deed_text(t), "UTF-8"), "ISO-8859-1")
    return t.raw("orders").select("o_orderkey", repair(broken).alias("v"))


# --- hints in deeds ---
#: A deed's sentences: {a} is the order's number, {b} its customer's; each stands in the deeds whose number its divisor divides.
SENTENCES = [
    (1, "Khewat No. {b}\n"), (2, "{a} khewat, Khatoni: {b}\n\n"), (3, "{b} to {a} Khatoni of khasra 12/{b}\n"), (4, "\u06a9\u06be\u0627\u062a\u06c1 {a} \u062e\u0633\u0631\u06c1 {b}/7 \u0627\u0646\u062a\u0642\u0627\u0644 {b}\n"), (5, "Mutation-{b} and 77 intiqal\n"), (6, "4 kanal {b} marla, 5 KANAL 6 Marla\n"),
    (7, "{b} sq. ft. or 900 sqft\n"), (8, "35202-1234567-{d} again 352021234567{d}\n"), (9, "id 9876543210123 on 2020-05-17, 3.4.2021 4/5/2021\n"), (10, "31 dec 2019 11 \u06a9\u0646\u0627\u0644 3 \u0645\u0631\u0644\u06c1 "), (11, "no 123456789012345 and Khewat No. {b}"),
]
_DEED_SQL = "(SELECT o_orderkey, " + " || ".join(f"CASE WHEN o_orderkey % {n} = 0 THEN replace(replace(replace('{x}', '{{a}}', CAST(o_orderkey AS VARCHAR)), '{{b}}', CAST(o_custkey AS VARCHAR)), '{{d}}', CAST(o_custkey % 10 AS VARCHAR)) ELSE '' END" for n, x in SENTENCES) + " AS x FROM orders)"


def _value(pattern: str, groups: str) -> str:
    return " || '-' || ".join(f"regexp_extract(h.raw, '(?i){pattern}', {g})" for g in groups.split("-")) if groups else "CAST(NULL AS VARCHAR)"


_FAMILIES = [*((i, *f) for i, f in enumerate(H.NUMBERS)), *((i + 10, *f) for i, f in enumerate(H.REFERENCES))]
_DOMAIN = f"""WITH t AS (SELECT * FROM {_DEED_SQL} q), {_DATES}, {', '.join(f"g{i} AS (SELECT o_orderkey, unnest(hits) AS h, unnest(range(len(hits))) AS n FROM (SELECT o_orderkey, {_found(p)} AS hits FROM t))" for i, _, p, _, _ in _FAMILIES)},
    e AS (SELECT o_orderkey, 5 AS f, b * 1000 + n AS n, 'date' AS type, value, raw, line, confidence FROM (SELECT * FROM a WHERE ok QUALIFY row_number() OVER (PARTITION BY o_orderkey, coalesce(value, raw) ORDER BY b, n) = 1)
        {' '.join(f"UNION ALL SELECT o_orderkey, {i}, n, '{kind}', {_value(p, g)}, h.raw, h.line, '{c}' FROM g{i}" for i, kind, p, g, c in _FAMILIES)}),
    u AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY o_orderkey, type, coalesce(value, '') ORDER BY f, n) = 1)
    SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY f, n) - 1 AS INTEGER) AS hint, type, value, raw, CAST(line AS INTEGER) AS line, confidence FROM u QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY f, n) <= 100"""


@query("X10b_domain_hint_rows", _DOMAIN)
def domain_hint_rows(t: Tables) -> DataFrame:
    """A row for each hint of all types, in deeds written from the orders' numbers."""
    key, who = F.col("o_orderkey"), F.col("o_custkey")
    fill = lambda x: F.replace(F.replace(F.replace(F.lit(x), F.lit("{a}"), key.cast("string")), F.lit("{b}"), who.cast("string")), F.lit("{d}"), (who % 10).cast("string"))
    deed = F.concat(*[F.when(key % n == 0, fill(x)).otherwise("") for n, x in SENTENCES])
    deeds = spread(t.raw("orders").select("o_orderkey", "o_custkey")).select("o_orderkey", deed.alias("deed"))
    found = deeds.select("o_orderkey", F.posexplode(H.domain_hints(F.col("deed"))).alias("hint", "h"))
    return found.select("o_orderkey", "hint", "h.*")


#: Words of pages: documents' first words meet these, which announce entities.
ANNOUNCED = ["Plot No 14 A of", "commercial plot Com-14 Street", "registry 5/199 and", "deed no Book 77/2", "Rs. 15,600,000 only", "consideration of about PKR 5,000.50,", "dated 12/01/2022 or 2022-1-5", "35202-1234567-1", "Green Valley Housing Scheme", "Al-Noor Cooperative Society Lahore", "پلاٹ نمبر 9", "rupees ten", "Model Town. City"]


@query("X07b_token_entities")
def token_entities(t: Tables) -> DataFrame:
    """Entities of the documents' pages, whose lines are followed by announcing words; tests/test_anchors.py holds the plan against a plain scanner."""
    said = F.element_at(F.array(*[F.lit(x) for x in ANNOUNCED]), (F.length("line") % len(ANNOUNCED) + 1).cast("int"))
    page = t.lines.select("doc_id", "line_no", F.concat_ws(" ", F.col("line"), said).alias("text"))
    return page.select("doc_id", "line_no", F.explode(token_found(F.col("text"))).alias("e")).select("doc_id", "line_no", "e.*")


# --- fields of a dossier ---
PAGE_SENTENCES = [
    (1, "Deed of {a}\n"), (2, "Plot No. {b} Block {d}e, "), (3, "plot {a} block - F phase {d}\n"), (4, "Phase-{d} of DHA Lahore, No. {d}\n"), (5, "mouza Kot Lakhpat tehsil: Model\nDistrict Lahore City and {d}"), (6, " phase VIII in bahria town khasra no: {b}/4 Khasra {a}-2 khasra {b}/4 "),
    (7, "Registry No: {a} registry date 1/2/199{d}\n"), (8, "Registration no. {b}, registration date: 3-4-2001 "), (9, "E-Stamp ID: PB-LHR-{a} estamp AB{b}\n"), (10, "stamp paper no XY-{b}{a} block q"), (11, "in Model Town near Gulberg"), (13, "plot no 123456 plot # 77"),
]
_PAGE_SQL = "(SELECT o_orderkey, " + " || ".join(f"CASE WHEN o_orderkey % {n} = 0 THEN replace(replace(replace('{x}', '{{a}}', CAST(o_orderkey AS VARCHAR)), '{{b}}', CAST(o_custkey AS VARCHAR)), '{{d}}', CAST(o_custkey % 10 AS VARCHAR)) ELSE '' END" for n, x in PAGE_SENTENCES) + " AS own FROM orders)"
_VALID = {"property.plot_number": "TRY_CAST(v.value AS INTEGER) BETWEEN 1 AND 9999", "stamp.estamp_id_or_number": "length(v.value) >= 5"}


def _field_sql(i: int, field: str) -> str:
    """A field's matches in the order of its patterns, as SQL over t (o_orderkey, own, x)."""
    value = lambda p: f"trim(regexp_extract(h.raw, '(?i){p}', 1))"
    up = (lambda e: f"upper({e})") if field == "property.block" else (lambda e: e)
    lists = [f"list_transform({_found(p)}, lambda h: {{'value': {up(value(p))}, 'raw': h.raw, 'line': h.line, 'confidence': {c}::DOUBLE}})" for p, c in FD.PATTERNS[field]]
    joined = lists[0]
    for x in lists[1:]:
        joined = f"list_concat({joined}, {x})"
    if field in _VALID:
        joined = f"list_filter({joined}, lambda v: {_VALID[field]})"
    most = "" if field == "property.khasra_numbers" else "[1:1]"
    return f"SELECT o_orderkey, {i} AS f, '{field}' AS field, unnest(({joined}){most}) AS v, unnest(range(len(({joined}){most}))) AS n FROM t"


_SCHEME_SQL = " ".join(f"WHEN regexp_matches(x, '\\b{name}\\b') THEN '{name}'" for name in FD.SCHEMES)
_FIELDS = f"""WITH t AS (SELECT o_orderkey, own, lower(own) AS x FROM {_PAGE_SQL} q), e AS ({' UNION ALL '.join(_field_sql(i, f) for i, f in enumerate(FD.PATTERNS))}),
    s AS (SELECT *, length(string_split_regex(x, '\\b' || k || '\\b')[1]) AS a FROM (SELECT *, CASE {_SCHEME_SQL} END AS k FROM t) WHERE k IS NOT NULL),
    c AS (SELECT *, regexp_extract(substr(own, greatest(0, a - 20) + 1, a + length(k) + 20 - greatest(0, a - 20)), '{FD._NAME}', 1) AS cap FROM s)
    SELECT o_orderkey, field, v.value AS value, v.raw AS raw, CAST(v.line AS INTEGER) AS line, v.confidence AS confidence FROM e QUALIFY row_number() OVER (PARTITION BY o_orderkey, field, v.value ORDER BY n) = 1
    UNION ALL SELECT o_orderkey, 'property.scheme_name', CASE WHEN cap <> '' THEN cap ELSE array_to_string(list_transform(string_split(k, ' '), lambda w: upper(w[1]) || w[2:]), ' ') END, k, CAST(len(string_split(substr(x, 1, a), chr(10))) - 1 AS INTEGER), 0.85 FROM c"""


@query("X06b_page_fields", _FIELDS)
def page_fields(t: Tables) -> DataFrame:
    """The dossier's fields in pages written from the orders' numbers."""
    key, who = F.col("o_orderkey"), F.col("o_custkey")
    fill = lambda x: F.replace(F.replace(F.replace(F.lit(x), F.lit("{a}"), key.cast("string")), F.lit("{b}"), who.cast("string")), F.lit("{d}"), (who % 10).cast("string"))
    page = F.concat(*[F.when(key % n == 0, fill(x)).otherwise("") for n, x in PAGE_SENTENCES])
    return t.raw("orders").select("o_orderkey", F.explode(FD.page_fields(page)).alias("h")).select("o_orderkey", "h.*")
