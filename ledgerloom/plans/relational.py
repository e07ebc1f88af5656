"""Queries of projections, joins, windows, sorts, set operations, sources and sinks (P, J, W, O, U, S)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import AS_OF, Tables
from ..operators import keywords as K10
from ..operators import kpis as K
from ..operators import windows as W
from ..registry import query
from ..session import shared_folder
from ..sources import files

S = lambda c: F.col(c).cast("string").alias(c)  # noqa: E731  dates are shown as strings


# --- scans, sources and sinks ---
@query("S01_tenant_scan", "SELECT case_id, status, amount FROM cases WHERE org_id = 2")
def tenant_scan(t: Tables) -> DataFrame:
    return Tables(t.spark, t.dir, org_id=2).cases.select("case_id", "status", "amount")


@query("S02_point_lookup", "SELECT case_id, title FROM cases WHERE case_id = 7 LIMIT 1")
def point_lookup(t: Tables) -> DataFrame:
    return t.cases.where("case_id = 7").select("case_id", "title").limit(1)


_TEXT = "CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN '' ELSE 'corrected ' || doc_id END"


@query("S14_effective_text", f"SELECT doc_id, coalesce(nullif({_TEXT}, ''), nullif(text, '')) AS text FROM documents WHERE coalesce(nullif({_TEXT}, ''), nullif(text, '')) IS NOT NULL")
def effective_text(t: Tables) -> DataFrame:
    fixed = F.expr(_TEXT)
    return t.documents.select("doc_id", F.coalesce(F.nullif(fixed, F.lit("")), F.nullif(F.col("text"), F.lit(""))).alias("text")).where("text IS NOT NULL")


@query("S15_effective_text_with_override", f"SELECT doc_id, CASE WHEN coalesce({_TEXT}, '') <> '' THEN 'override' ELSE 'ocr' END AS origin, length(coalesce(nullif({_TEXT}, ''), text)) AS chars FROM documents")
def effective_text_with_override(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.nullif(F.expr(_TEXT), F.lit("")).alias("fixed"), "text")
    return d.select("doc_id", F.when(F.col("fixed").isNotNull(), "override").otherwise("ocr").alias("origin"), F.length(F.coalesce("fixed", "text")).cast("long").alias("chars"))


@query("S16_corrections_join", "SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'corrected' ELSE 'ocr' END AS origin FROM documents d LEFT JOIN labels l USING (doc_id)")
def corrections_join(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.raw("labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", F.when(F.col("quality") == 1, "corrected").otherwise("ocr").alias("origin"))


@query("S17_csv_rows", "SELECT case_id, title, status, CAST(created AS VARCHAR) AS created, substr(md5(concat_ws('|', case_id, title, status)), 1, 8) AS content_hash FROM cases ORDER BY created DESC, case_id LIMIT 500")
def csv_rows(t: Tables) -> DataFrame:
    top = t.cases.orderBy(F.desc("created"), "case_id").limit(500)
    return top.select("case_id", "title", "status", S("created"), F.substring(F.md5(F.concat_ws("|", F.col("case_id").cast("string"), "title", "status").cast("binary")), 1, 8).alias("content_hash"))


@query("S21_upsert", "SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 'new' ELSE role END AS role FROM users UNION ALL SELECT user_id + 1000000, 'new' FROM users WHERE user_id % 50 = 0")
def upsert(t: Tables) -> DataFrame:
    old = t.users.select("user_id", "role")
    new = old.where("user_id % 3 = 0").select("user_id", F.lit("new").alias("role")).unionByName(old.where("user_id % 50 = 0").select((F.col("user_id") + 1000000).alias("user_id"), F.lit("new").alias("role")))
    return W.upsert(old, new, ["user_id"])


@query("S22_bulk_update", "SELECT case_id, CASE WHEN status = 'Processing' AND assigned_to IS NULL THEN 'Queued' ELSE status END AS status FROM cases")
def bulk_update(t: Tables) -> DataFrame:
    return t.cases.select("case_id", F.when((F.col("status") == "Processing") & F.col("assigned_to").isNull(), "Queued").otherwise(F.col("status")).alias("status"))


@query("S23_delete_in_subquery", "SELECT case_id, line FROM exceptions WHERE case_id NOT IN (SELECT case_id FROM cases WHERE status = 'Closed')")
def delete_in_subquery(t: Tables) -> DataFrame:
    return t.exceptions.select("case_id", "line").join(t.cases.where("status = 'Closed'").select("case_id"), "case_id", "left_anti")


@query("S24_cascaded_delete", "WITH gone AS (SELECT case_id FROM cases WHERE status = 'Closed' AND created < DATE '1997-01-01') SELECT 'exceptions' AS relation, count(*) AS kept FROM exceptions WHERE case_id NOT IN (SELECT case_id FROM gone) UNION ALL SELECT 'cps', count(*) FROM cps WHERE case_id NOT IN (SELECT case_id FROM gone)".replace("'exceptions' AS relation", "'exception' AS relation").replace("SELECT 'cps'", "SELECT 'cp'"))
def cascaded_delete(t: Tables) -> DataFrame:
    gone = t.cases.where((F.col("status") == "Closed") & (F.col("created") < F.lit(dt.date(1997, 1, 1)))).select("case_id")
    count = lambda name, df: df.join(gone, "case_id", "left_anti").agg(F.lit(name).alias("relation"), F.count("*").alias("kept"))
    return count("exception", t.exceptions).unionByName(count("cp", t.cps)).select("relation", "kept")


@query("S25_train_split", "SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN 'val' ELSE 'train' END AS part FROM documents")
def train_split(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.when(F.col("doc_id") % 10 == 9, "val").otherwise("train").alias("part"))


# --- projections, filters and predicates ---
@query("P01_projection", "SELECT case_id AS id, title AS name, amount * 2 AS doubled FROM cases")
def projection(t: Tables) -> DataFrame:
    return t.cases.select(F.col("case_id").alias("id"), F.col("title").alias("name"), (F.col("amount") * 2).alias("doubled"))


def _cases(name: str, where: str, spark_where=None):
    """A filter over cases that returns the ids: the same condition for both engines unless one needs its own."""

    @query(name, f"SELECT case_id FROM cases WHERE {where}")
    def run(t: Tables) -> DataFrame:
        return t.cases.where(spark_where() if spark_where else where).select("case_id")

    return run


_cases("P02_conjunction", "status = 'Closed' AND org_id <> 3 AND amount > 1000")
_cases("P03_lookback", "created >= DATE '2001-05-03'", lambda: K.since("created", AS_OF, 90))
_cases("P04_in_list", "status IN ('Processing', 'Review')", lambda: F.col("status").isin("Processing", "Review"))
_cases("P06_nulls", "assigned_to IS NULL AND decision IS NOT NULL", lambda: F.col("assigned_to").isNull() & F.col("decision").isNotNull())
_cases("P07_disjunction", "status = 'Review' OR amount > 100000")
_cases("P08_contains", "title ILIKE '%high%'", lambda: F.col("title").ilike("%high%"))
_cases("P09_prefix", "title LIKE '1%'", lambda: F.col("title").startswith("1"))
_cases("P10_date_equality", "updated = DATE '1999-03-04'", lambda: F.col("updated") == F.to_date(F.lit("1999-03-04")))
_cases("P11_owner_preset", "assigned_to = 42")
_cases("P17_role_filter", "assigned_to = 42 AND org_id = 2")


@query("P05_in_subquery", "SELECT case_id, line FROM exceptions WHERE case_id IN (SELECT case_id FROM cases WHERE status = 'Review')")
def in_subquery(t: Tables) -> DataFrame:
    return t.exceptions.select("case_id", "line").join(t.cases.where("status = 'Review'").select("case_id"), "case_id", "left_semi")


@query("P12_stale_unassigned", "SELECT c.case_id FROM cases c WHERE assigned_to IS NULL AND updated <= DATE '2001-07-29' AND (EXISTS (SELECT 1 FROM exceptions e WHERE e.case_id = c.case_id AND e.status = 'Open' AND e.severity = 'High') OR EXISTS (SELECT 1 FROM verifications v WHERE v.case_id = c.case_id AND v.status = 'Pending'))")
def stale_unassigned(t: Tables) -> DataFrame:
    return K.cohort(t.cases, t.exceptions, t.verifications, preset="stale_unassigned", as_of=AS_OF, limit=1 << 30).select("case_id")


@query("P13_severity_drill_down", "SELECT DISTINCT c.case_id FROM cases c JOIN exceptions e USING (case_id) WHERE e.status = 'Open' AND e.severity = 'Medium'")
def severity_drill_down(t: Tables) -> DataFrame:
    e = t.exceptions.where("status = 'Open'").groupBy("case_id").agg(K.n(F.col("severity") == "Medium", "medium"))
    return t.cases.select("case_id").join(e, "case_id", "left").where("medium > 0").select("case_id")


@query("P14_three_valued", "SELECT event_id FROM audit a LEFT JOIN cases c ON a.entity_id = c.case_id WHERE entity_type <> 'case' OR c.status = 'Closed'")
def three_valued(t: Tables) -> DataFrame:
    return t.audit.join(t.cases.select("case_id", "status"), F.col("entity_id") == F.col("case_id"), "left").where("entity_type <> 'case' OR status = 'Closed'").select("event_id")


@query("P15_array_membership", "SELECT event_id FROM audit WHERE list_contains(['click', 'error'], action)")
def array_membership(t: Tables) -> DataFrame:
    return t.audit.where(F.array_contains(F.array(F.lit("click"), F.lit("error")), F.col("action"))).select("event_id")


@query("P16_view_visibility", "SELECT user_id FROM users WHERE user_id % 7 = 1 OR (user_id % 3 <> 0 AND (user_id % 2 = 0 OR role = 'BUILDING'))")
def view_visibility(t: Tables) -> DataFrame:
    owner, org = F.col("user_id") % 7 == 1, F.col("user_id") % 3 != 0
    roles = F.when(F.col("user_id") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("BUILDING")))
    return t.users.where(owner | (org & ((F.size(roles) == 0) | F.array_contains(roles, F.col("role"))))).select("user_id")


@query("P18_key_contains", "SELECT case_id, line FROM exceptions WHERE contains(rule_id, '-3')")
def key_contains(t: Tables) -> DataFrame:
    return t.exceptions.where(F.col("rule_id").contains("-3")).select("case_id", "line")


@query("P19_aliases", "SELECT case_id, CASE status WHEN 'Closed' THEN 'done' WHEN 'Processing' THEN 'in progress' ELSE status END AS status FROM cases")
def aliases(t: Tables) -> DataFrame:
    names = t.spark.createDataFrame([("Closed", "done"), ("Processing", "in progress")], "status string, name string")
    return t.cases.join(F.broadcast(names), "status", "left").select("case_id", F.coalesce("name", "status").alias("status"))


@query("P20_first_non_empty", "SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE lang END), ''), nullif(trim(source), ''), 'none') AS value FROM documents")
def first_non_empty(t: Tables) -> DataFrame:
    full = lambda c: F.nullif(F.trim(c), F.lit(""))
    return t.documents.select("doc_id", F.coalesce(full(F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("lang"))), full(F.col("source")), F.lit("none")).alias("value"))


@query("P21_needs_review", "SELECT event_id, (value IS NULL OR value / 100 < 0.8 OR event_id % 10 = 0) AS needs_review FROM audit")
def needs_review(t: Tables) -> DataFrame:
    return t.audit.select("event_id", (F.col("value").isNull() | (F.col("value") / 100 < 0.8) | (F.col("event_id") % 10 == 0)).alias("needs_review"))


@query("P22_truncation", "SELECT doc_id, CASE WHEN length(text) > 40 THEN substr(text, 1, 40) || '...' ELSE text END AS short FROM documents")
def truncation(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.when(F.length("text") > 40, F.concat(F.substring("text", 1, 40), F.lit("..."))).otherwise(F.col("text")).alias("short"))


_MOVES = [("New", "Processing"), ("Processing", "Review"), ("Review", "Approved"), ("Review", "Rejected"), ("Approved", "Closed"), ("Rejected", "Closed"), ("Processing", "Pending Docs"), ("Pending Docs", "Processing")]
_NEXT = "CASE case_id % 3 WHEN 0 THEN 'Closed' WHEN 1 THEN 'Review' ELSE 'Approved' END"


@query("P23_transition_check", f"SELECT case_id, status, {_NEXT} AS target FROM cases WHERE (status, {_NEXT}) NOT IN ({', '.join(map(str, _MOVES))})")
def transition_check(t: Tables) -> DataFrame:
    moves = t.spark.createDataFrame(_MOVES, "status string, target string")
    return t.cases.select("case_id", "status", F.expr(_NEXT).alias("target")).join(F.broadcast(moves), ["status", "target"], "left_anti")


# --- joins ---
@query("J01_left_join_aggregate", "SELECT c.case_id, coalesce(e.n, 0) AS open FROM cases c LEFT JOIN (SELECT case_id, count(*) AS n FROM exceptions WHERE status = 'Open' GROUP BY case_id) e USING (case_id)")
def left_join_aggregate(t: Tables) -> DataFrame:
    e = t.exceptions.where("status = 'Open'").groupBy("case_id").agg(F.count("*").alias("n"))
    return t.cases.select("case_id").join(e, "case_id", "left").select("case_id", F.coalesce("n", F.lit(0)).alias("open"))


@query("J02_left_join_dimension", "SELECT case_id, full_name FROM cases LEFT JOIN users ON assigned_to = user_id")
def left_join_dimension(t: Tables) -> DataFrame:
    return t.cases.join(t.users, F.col("assigned_to") == F.col("user_id"), "left").select("case_id", "full_name")


@query("J03_left_join_literal_in_on", "SELECT event_id, c.title FROM audit LEFT JOIN cases c ON entity_type = 'case' AND entity_id = c.case_id")
def left_join_literal(t: Tables) -> DataFrame:
    c = t.cases.select("case_id", "title")
    return t.audit.join(c, (F.col("entity_type") == "case") & (F.col("entity_id") == c.case_id), "left").select("event_id", "title")


@query("J04_bridge_join", "SELECT user_id, n_name AS nation, r_name AS org FROM users u JOIN customer ON c_custkey = user_id JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey = 1")
def bridge_join(t: Tables) -> DataFrame:
    org = t.raw("nation").join(t.raw("region").where("r_regionkey = 1"), F.col("n_regionkey") == F.col("r_regionkey"))
    return t.raw("customer").join(F.broadcast(org), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("user_id"), F.col("n_name").alias("nation"), F.col("r_name").alias("org"))  # 25 nations


@query("J05_semi_join", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def semi_join(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.raw("labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi")


@query("J06_anti_join", "SELECT user_id FROM users WHERE user_id NOT IN (SELECT assigned_to FROM cases WHERE assigned_to IS NOT NULL AND created >= DATE '2001-01-01')")
def anti_join(t: Tables) -> DataFrame:
    return t.users.select("user_id").join(t.cases.where(F.col("created") >= F.lit(dt.date(2001, 1, 1))).select(F.col("assigned_to").alias("user_id")), "user_id", "left_anti")


@query("J07_lookup_or_unknown", "SELECT event_id, coalesce(full_name, 'Unknown') AS full_name FROM audit LEFT JOIN users USING (user_id)")
def lookup_or_unknown(t: Tables) -> DataFrame:
    return t.audit.select("event_id", "user_id").join(t.users.select("user_id", "full_name"), "user_id", "left").select("event_id", F.coalesce("full_name", F.lit("Unknown")).alias("full_name"))


@query("J08_latest_row_lookup", "SELECT user_id, arg_max(action, event_id) AS last_action, max(event_id) AS event_id FROM audit GROUP BY user_id")
def latest_row_lookup(t: Tables) -> DataFrame:
    return t.audit.groupBy("user_id").agg(F.max_by("action", "event_id").alias("last_action"), F.max("event_id").alias("event_id"))


_TERMS = ["STEEL", "econom", "promo brushed", "n"]


@query("J09_bidirectional_substring", f"SELECT p_partkey, q AS required FROM part, (VALUES {', '.join(f"('{x}')" for x in _TERMS)}) r(q) WHERE contains(lower(p_type), lower(q)) OR contains(lower(q), lower(p_type))")
def bidirectional_substring(t: Tables) -> DataFrame:
    """The terms of a rule are a few constants: they are exploded inside each row, so nothing is joined."""
    terms = F.array(*[F.lit(x) for x in _TERMS])
    kind = F.lower("p_type")
    hits = F.filter(terms, lambda q: kind.contains(F.lower(q)) | F.lower(q).contains(kind))
    return t.raw("part").select("p_partkey", F.explode(hits).alias("required"))


_WORDS = ["license", "password", "token", "idiot"]


@query("J10_keyword_in_text", f"SELECT doc_id, w AS keyword FROM documents, (VALUES {', '.join(f"('{x}')" for x in _WORDS)}) k(w) WHERE contains(lower(text), w)")
def keyword_in_text(t: Tables) -> DataFrame:
    low = F.lower("text")
    return t.documents.select("doc_id", F.explode(F.filter(F.array(*[F.lit(w) for w in _WORDS]), lambda w: low.contains(w))).alias("keyword"))


_SAID = "SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS keyword FROM conversations"


@query("J10b_keyword_relation", f"WITH k AS ({_SAID}) SELECT doc_id, keyword FROM documents JOIN k ON contains(lower(text), keyword)")
def keyword_relation(t: Tables) -> DataFrame:
    """Every word of five letters or more that was said in a conversation, wherever documents contain it: thousands of keywords, one pass a text."""
    said = t.raw("conversations").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), 0)).alias("keyword"))
    return K10.contained(t.documents.select("doc_id", "text"), said)


@query("J11_checklist", "SELECT k AS item, CASE WHEN count(p_partkey) > 0 THEN 'Provided' ELSE 'Missing' END AS status FROM (VALUES ('economy brushed', 'ECONOMY BRUSHED STEEL'), ('economy brushed', 'economy brushed tin'), ('none', 'no such type')) c(k, a) LEFT JOIN part ON lower(p_type) = lower(a) GROUP BY k")
def checklist(t: Tables) -> DataFrame:
    items = t.spark.createDataFrame([("economy brushed", ["ECONOMY BRUSHED STEEL", "economy brushed tin"]), ("none", ["no such type"])], "item string, accepted array<string>")
    wanted = items.select("item", F.explode("accepted").alias("a"))
    return wanted.join(t.raw("part"), F.lower("a") == F.lower("p_type"), "left").groupBy("item").agg(F.when(F.count("p_partkey") > 0, "Provided").otherwise("Missing").alias("status"))


@query("J12_as_of", "SELECT l.doc_id, l.line_no, (SELECT m.line FROM lines m WHERE m.doc_id = l.doc_id AND m.line_no < l.line_no AND l.line_no - m.line_no < 25 AND length(m.line) < 60 ORDER BY m.line_no DESC LIMIT 1) AS marker FROM lines l WHERE length(l.line) >= 60")
def as_of(t: Tables) -> DataFrame:
    blocks = t.lines.where(F.length("line") >= 60).select("doc_id", "line_no")
    markers = t.lines.where(F.length("line") < 60).select("doc_id", "line_no", F.col("line").alias("marker"))
    return W.as_of(blocks, markers, "doc_id", "line_no", "marker", 25)


@query("J13_interval_join", "SELECT a.doc_id, a.line_no, count(b.line_no) AS around FROM lines a LEFT JOIN lines b ON a.doc_id = b.doc_id AND b.line_no BETWEEN a.line_no - 6 AND a.line_no + 2 AND contains(b.line, 'the') GROUP BY 1, 2")
def interval_join(t: Tables) -> DataFrame:
    """A fixed reach in line numbers is a window frame: no join at all."""
    w = Window.partitionBy("doc_id").orderBy("line_no").rangeBetween(-6, 2)
    return t.lines.select("doc_id", "line_no", F.count(F.when(F.col("line").contains("the"), 1)).over(w).alias("around"))


@query("J16_conditional_existence", "SELECT a.approval_id FROM approvals a WHERE request_type = 'export_release' AND EXISTS (SELECT 1 FROM exports x WHERE x.case_id = a.case_id AND x.status = 'Pending')")
def conditional_existence(t: Tables) -> DataFrame:
    return t.approvals.where("request_type = 'export_release'").join(t.exports.where("status = 'Pending'").select("case_id"), "case_id", "left_semi").select("approval_id")


@query("J17_playbook_by_regime", "SELECT p AS playbook, count(c.case_id) AS cases FROM (VALUES ('a', 'Closed'), ('a', 'Review'), ('b', 'Processing')) x(p, s) JOIN cases c ON upper(c.status) = upper(s) GROUP BY p".replace("AS cases", "AS n_cases"))
def playbook_by_regime(t: Tables) -> DataFrame:
    books = t.spark.createDataFrame([("a", ["Closed", "Review"]), ("b", ["Processing"])], "playbook string, regimes array<string>").select("playbook", F.explode("regimes").alias("r"))
    return t.cases.join(F.broadcast(books), F.upper("status") == F.upper("r")).groupBy("playbook").agg(F.count("*").alias("n_cases"))


# --- window logic ---
@query("W01_latest_per_key", "SELECT user_id, event_id, action FROM audit QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(t: Tables) -> DataFrame:
    return W.first_by(t.audit, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "action")


@query("W02_latest_note", "SELECT user_id, event_id FROM audit WHERE value > 50 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_note(t: Tables) -> DataFrame:
    return W.first_by(t.audit.where("value > 50"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id")


@query("W03_highest_confidence", "SELECT action, user_id, event_id FROM audit QUALIFY row_number() OVER (PARTITION BY action, user_id ORDER BY value DESC, event_id) = 1")
def highest_confidence(t: Tables) -> DataFrame:
    return W.first_by(t.audit, ["action", "user_id"], [F.desc("value"), "event_id"]).select("action", "user_id", "event_id")


@query("W04_best_per_field", "SELECT action, arg_max(event_id, value * 1000000 - event_id) AS event_id FROM audit GROUP BY action")
def best_per_field(t: Tables) -> DataFrame:
    return t.audit.groupBy("action").agg(F.max_by("event_id", F.col("value") * 1000000 - F.col("event_id")).alias("event_id"))


@query("W05_best_per_value", "SELECT user_id, event_id FROM audit QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1")
def best_per_value(t: Tables) -> DataFrame:
    return W.first_by(t.audit, ["user_id"], [F.desc("value"), "event_id"]).select("user_id", "event_id")


@query("W06_ordered_distinct", "SELECT doc_id, line_no FROM lines WHERE trim(line) <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, lower(trim(line)) ORDER BY line_no) = 1")
def ordered_distinct(t: Tables) -> DataFrame:
    return W.first_by(t.lines.where("trim(line) <> ''"), ["doc_id", F.lower(F.trim("line"))], ["line_no"]).select("doc_id", "line_no")


@query("W07_top_three", "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS rn FROM audit QUALIFY rn <= 3")
def top_three(t: Tables) -> DataFrame:
    return W.first_by(t.audit, ["user_id"], ["event_id"], 3, "rn").select("user_id", "event_id", "rn")


@query("W08_margin", "WITH x AS (SELECT user_id, action, sum(value) AS s FROM audit GROUP BY 1, 2), y AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, action) AS rn FROM x) SELECT user_id, round(max(CASE WHEN rn = 1 THEN s END), 4) AS best, round(coalesce(max(CASE WHEN rn = 2 THEN s END), 0), 4) AS second FROM y GROUP BY user_id")
def margin(t: Tables) -> DataFrame:
    scores = t.audit.groupBy("user_id", "action").agg(F.sum("value").alias("s")).groupBy("user_id").agg(F.sort_array(F.collect_list("s"), False).alias("s"))  # one score for each of a few actions
    return scores.select("user_id", F.round(F.col("s")[0], 4).alias("best"), F.round(F.coalesce(F.try_element_at("s", F.lit(2)), F.lit(0.0)), 4).alias("second"))


@query("W09_top_by_area", "SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size * p_retailprice DESC, p_partkey) <= 2")
def top_by_area(t: Tables) -> DataFrame:
    return W.first_by(t.raw("part"), ["p_brand"], [F.desc(F.col("p_size") * F.col("p_retailprice")), "p_partkey"], 2).select("p_brand", "p_partkey")


@query("W10_label_runs", "WITH x AS (SELECT *, CASE WHEN lag(action) OVER (PARTITION BY user_id ORDER BY event_id) IS NOT DISTINCT FROM action THEN 0 ELSE 1 END AS ch FROM audit), y AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM x) SELECT user_id, CAST(run AS BIGINT) AS run, min(action) AS action, count(*) AS size, min(event_id) AS first_id FROM y GROUP BY 1, 2")
def label_runs(t: Tables) -> DataFrame:
    return W.islands(t.audit, ["user_id"], ["event_id"], F.col("action")).groupBy("user_id", "run").agg(F.min("action").alias("action"), F.count("*").alias("size"), F.min("event_id").alias("first_id"))


@query("W11_box_merge", "WITH x AS (SELECT doc_id, line_no, line_no * 12 AS y1, line_no * 12 + length(line) % 40 AS y2 FROM lines), m AS (SELECT *, max(y2) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM x), g AS (SELECT *, sum(CASE WHEN seen IS NULL OR y1 - seen > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS grp FROM m) SELECT doc_id, CAST(grp AS BIGINT) AS grp, min(y1) AS top, max(y2) AS bottom, count(*) AS boxes FROM g GROUP BY 1, 2")
def box_merge(t: Tables) -> DataFrame:
    """Boxes join the open group while their gap to its lower edge is at most 5."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    x = t.lines.select("doc_id", "line_no", (F.col("line_no") * 12).cast("long").alias("y1"), (F.col("line_no") * 12 + F.length("line") % 40).cast("long").alias("y2"))
    seen = F.max("y2").over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("_new", F.when(seen.isNull() | (F.col("y1") - seen > 5), 1).otherwise(0)).withColumn("grp", F.sum("_new").over(w))
    return x.groupBy("doc_id", "grp").agg(F.min("y1").alias("top"), F.max("y2").alias("bottom"), F.count("*").alias("boxes"))


@query("W12_reading_order", "SELECT l_orderkey, l_partkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY floor(l_quantity / 10), l_partkey DESC, l_linenumber, l_extendedprice) AS INTEGER) AS pos FROM lineitem")
def reading_order(t: Tables) -> DataFrame:
    """Rows of tokens (by tens of the vertical place), right to left within a row."""
    w = Window.partitionBy("l_orderkey").orderBy(F.floor(F.col("l_quantity") / 10), F.desc("l_partkey"), "l_linenumber", "l_extendedprice")
    return t.raw("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.row_number().over(w).alias("pos"))


@query("W13_section_state", "WITH x AS (SELECT doc_id, line_no, CASE WHEN length(line) < 40 THEN line_no END AS mark FROM lines), y AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS sec FROM x) SELECT doc_id, line_no, CASE WHEN line_no - sec <= 30 THEN sec END AS section FROM y")
def section_state(t: Tables) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("line_no")
    x = t.lines.withColumn("at", F.last(F.when(F.length("line") < 40, F.col("line_no")), True).over(w))
    return x.select("doc_id", "line_no", F.when(F.col("line_no") - F.col("at") <= 30, F.col("at")).alias("section"))


@query("W14_first_seen", "SELECT user_id, action, event_id FROM audit QUALIFY row_number() OVER (PARTITION BY user_id, action ORDER BY event_id) = 1")
def first_seen(t: Tables) -> DataFrame:
    return t.audit.groupBy("user_id", "action").agg(F.min("event_id").alias("event_id"))


@query("W15_revisions", "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) + 1 AS INTEGER) AS revision FROM audit")
def revisions(t: Tables) -> DataFrame:
    return t.audit.select("user_id", "event_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) + 1).alias("revision"))


# --- sorts, limits and sets ---
def _top(name: str, table: str, keys: list[str], order: str, spark_order, limit: int = 25, offset: int = 0):
    @query(name, f"SELECT {', '.join(keys)} FROM {table} ORDER BY {order} LIMIT {limit} OFFSET {offset}")
    def run(t: Tables) -> DataFrame:
        df = getattr(t, table) if hasattr(t, table) else t.raw(table)
        out = df.orderBy(*spark_order())
        return (out.offset(offset) if offset else out).limit(limit).select(*keys)

    return run


_E = ["case_id", "line", "document_id"]
_top("O01_sort_limit", "cases", ["case_id"], "status, amount DESC, case_id", lambda: ["status", F.desc("amount"), "case_id"])
_top("O02_dynamic_sort", "cases", ["case_id"], "created DESC, case_id", lambda: [{"created_at": F.desc("created"), "title": F.desc("title")}.get("unknown", F.desc("created")), "case_id"])
_top("O03_paging", "cases", ["case_id"], "case_id", lambda: ["case_id"], 20, 60)
_top("O04_lexicographic_severity", "exceptions", _E, "severity DESC, case_id, line, document_id, rule_id", lambda: [F.desc("severity"), "case_id", "line", "document_id", "rule_id"])
_top("O05_ranked_severity", "exceptions", _E, "CASE severity WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END, rule_id, case_id, line, document_id", lambda: [F.expr("CASE severity WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END"), "rule_id", "case_id", "line", "document_id"])
_top("O06_nulls_last", "cases", ["case_id"], "assigned_to ASC NULLS LAST, title, case_id", lambda: [F.asc_nulls_last("assigned_to"), "title", "case_id"])
_top("O08_cp_sort", "cps", ["case_id", "line"], "status, severity, satisfied ASC NULLS LAST, created, case_id, line", lambda: ["status", "severity", F.asc_nulls_last("satisfied"), "created", "case_id", "line"])
_top("O09_exception_page", "exceptions", _E, "CASE severity WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 ELSE 2 END, created DESC, case_id, line, document_id", lambda: [F.expr("CASE severity WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 ELSE 2 END"), F.desc("created"), "case_id", "line", "document_id"])
_top("O10_saved_views", "users", ["user_id"], "org_id = 1 DESC, role = 'BUILDING' DESC, lower(full_name), user_id", lambda: [F.desc(F.col("org_id") == 1), F.desc(F.col("role") == "BUILDING"), F.lower("full_name"), "user_id"])


@query("O07_urgency", "SELECT case_id, 1000 * high + 100 * pending + 10 * medium + low AS urgency FROM (SELECT case_id, count(CASE WHEN severity = 'High' THEN 1 END) AS high, count(CASE WHEN severity = 'Medium' THEN 1 END) AS medium, count(CASE WHEN severity = 'Low' THEN 1 END) AS low FROM exceptions WHERE status = 'Open' GROUP BY 1) e FULL JOIN (SELECT case_id, count(*) AS pending FROM verifications WHERE status = 'Pending' GROUP BY 1) v USING (case_id) ORDER BY urgency DESC, case_id LIMIT 25".replace("1000 * high + 100 * pending + 10 * medium + low", "1000 * coalesce(high, 0) + 100 * coalesce(pending, 0) + 10 * coalesce(medium, 0) + coalesce(low, 0)"))
def urgency(t: Tables) -> DataFrame:
    c = K.case_counts(t.exceptions, t.verifications)
    return c.select("case_id", (1000 * F.col("high") + 100 * F.col("pending") + 10 * F.col("medium") + F.col("low")).alias("urgency")).orderBy(F.desc("urgency"), "case_id").limit(25)


@query("O11_exists", "SELECT count(*) > 0 AS found FROM (SELECT 1 FROM exports WHERE status = 'Pending' LIMIT 1)")
def exists(t: Tables) -> DataFrame:
    return t.exports.where("status = 'Pending'").limit(1).agg((F.count("*") > 0).alias("found"))


@query("U01_union", "SELECT case_id, 'exception' AS kind FROM exceptions WHERE status = 'Open' UNION ALL SELECT case_id, 'cp' FROM cps WHERE status = 'Open'")
def union(t: Tables) -> DataFrame:
    part = lambda df, kind: df.where("status = 'Open'").select("case_id", F.lit(kind).alias("kind"))
    return part(t.exceptions, "exception").unionByName(part(t.cps, "cp"))


_TOK = "list_distinct(list_filter(string_split_regex(lower({0}), '[^a-z]+'), lambda x: length(x) > 2))"


@query("U02_token_sets", f"WITH x AS (SELECT p_partkey, {_TOK.format('p_name')} AS a, {_TOK.format('p_type')} AS b FROM part) SELECT p_partkey, CAST(len(list_intersect(a, b)) AS INTEGER) AS both_n, CAST(len(list_distinct(list_concat(a, b))) AS INTEGER) AS any_n, CAST(len(a) - len(list_intersect(a, b)) AS INTEGER) AS only_n FROM x")
def token_sets(t: Tables) -> DataFrame:
    tokens = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z]+"), lambda x: F.length(x) > 2))
    x = t.raw("part").select("p_partkey", tokens("p_name").alias("a"), tokens("p_type").alias("b"))
    return x.select("p_partkey", F.size(F.array_intersect("a", "b")).alias("both_n"), F.size(F.array_union("a", "b")).alias("any_n"), F.size(F.array_except("a", "b")).alias("only_n"))


@query("U03_distinct", "SELECT DISTINCT severity, status FROM exceptions")
def distinct(t: Tables) -> DataFrame:
    return t.exceptions.select("severity", "status").distinct()


@query("U04_first_by_code", "SELECT rule_id, min(document_id) AS document_id FROM exceptions GROUP BY rule_id")
def first_by_code(t: Tables) -> DataFrame:
    return t.exceptions.groupBy("rule_id").agg(F.min("document_id").alias("document_id"))


@query("U05_capped_hints", "WITH d AS (SELECT DISTINCT user_id, action, CAST(floor(value) AS BIGINT) AS v FROM audit) SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY action, v) <= 100")
def capped_hints(t: Tables) -> DataFrame:
    d = t.audit.select("user_id", "action", F.floor("value").alias("v")).distinct()
    return W.first_by(d, ["user_id"], ["action", "v"], 100)


@query("U06_flat_map", "SELECT doc_id, unnest(list_filter(string_split(text, ' '), lambda x: x <> '')) AS word FROM documents")
def flat_map(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.explode(F.filter(F.split("text", " "), lambda x: x != "")).alias("word"))


# --- files: tables are written to the shared folder and read by the sources ---
@query("S07_csv_reader", "SELECT 'p' || p_partkey || '.pdf' AS filename, p_brand AS actual_type, p_name || ', \"' || p_type || '\"' AS text FROM part")
def csv_reader(t: Tables) -> DataFrame:
    path = shared_folder(t.spark, "labels")
    part = t.raw("part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".pdf")).alias("filename"), F.col("p_brand").alias("actual_type"), F.concat("p_name", F.lit(', "'), "p_type", F.lit('"')).alias("text"))
    part.write.csv(path, header=True, escape='"')
    return files.csv_labels(t.spark, path)


@query("S08_folder_labels", "SELECT n_name || '.pdf' AS filename, '' AS actual_type, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'nation ' || n_name END AS text FROM nation")
def folder_labels(t: Tables) -> DataFrame:
    """A scanned file for each nation, in a folder for each region, two of three with a text beside it (25 files)."""
    root = shared_folder(t.spark, "scans")
    jvm, conf = t.spark._jvm, t.spark._jsc.hadoopConfiguration()
    for r in t.raw("nation").collect():
        for end, text in (("pdf", "%PDF"), ("txt", f"nation {r.n_name}")):
            if end == "pdf" or r.n_nationkey % 3:
                path = jvm.org.apache.hadoop.fs.Path(f"{root}/region {r.n_regionkey}/{r.n_name}.{end}")
                out = path.getFileSystem(conf).create(path)
                out.write(bytearray(text.encode()))
                out.close()
    return files.folder_labels(t.spark, root)


@query("S09_manifest_reader", "SELECT 'o' || o_orderkey AS id, p AS page, 'gt/' || o_orderkey || '_' || p AS gt_path FROM orders, (VALUES (1), (2)) x(p)")
def manifest_reader(t: Tables) -> DataFrame:
    path, key = shared_folder(t.spark, "manifests"), F.col("o_orderkey").cast("string")
    page = lambda i: F.struct(F.lit(i).alias("page"), F.concat(F.lit("gt/"), key, F.lit(f"_{i}")).alias("gt_path"))
    items = F.array(F.struct(F.concat(F.lit("o"), key).alias("id"), F.array(page(1), page(2)).alias("pages")))
    t.raw("orders").select(F.to_json(F.struct(items.alias("items"))).alias("value")).write.text(path)
    return files.manifest(t.spark, path, lines=True)


@query("S10_json_lines", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_lines(t: Tables) -> DataFrame:
    """Every other line of the file is blank, and skipped."""
    path = shared_folder(t.spark, "lines")
    t.raw("events").select(F.concat("props", F.lit("\n")).alias("value")).write.text(path)
    return files.json_lines(t.spark, path, "k long")


@query("S20_append_only", "SELECT event_id, action FROM audit UNION ALL SELECT event_id + 1000000, action FROM audit WHERE action = 'error'")
def append_only(t: Tables) -> DataFrame:
    path, row = shared_folder(t.spark, "audit"), t.audit.select("event_id", "action")
    files.append(row, path)
    files.append(row.where("action = 'error'").withColumn("event_id", F.col("event_id") + 1000000), path)
    return t.spark.read.schema(row.schema).parquet(path)


@query("S11_page_split", "SELECT doc_id, line_no + 1 AS page, length(line) AS chars FROM lines")
def page_split(t: Tables) -> DataFrame:
    return files.paged(t.documents.select("doc_id", "text"), "text", "\n").select("doc_id", "page", F.length("page_text").cast("long").alias("chars"))


@query("S19_report_rows", "SELECT lang, count(*) AS n, round(avg(n_chars), 2) AS mean_chars FROM documents GROUP BY lang")
def report_rows(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 2).alias("mean_chars"))
