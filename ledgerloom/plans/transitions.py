"""Queries of record transitions (N): old rows and a command give new rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import Tables
from ..operators import windows as W
from ..registry import query

_DAY = "DATE '2001-08-01'"


def day():
    return F.to_date(F.lit("2001-08-01"))


_TARGET = "CASE line % 3 WHEN 0 THEN 'Resolved' WHEN 1 THEN 'Waived' ELSE 'Open' END"


@query("N01_exception_status", f"SELECT case_id, line, document_id, {_TARGET} AS status, CASE WHEN {_TARGET} = 'Resolved' THEN '2001-08-01' END AS resolved_at, CASE WHEN {_TARGET} = 'Waived' THEN '2001-08-01' END AS waived_at FROM exceptions")
def exception_status(t: Tables) -> DataFrame:
    """Each target sets its own date and clears the others."""
    target = F.expr(_TARGET)
    at = lambda s: F.when(target == s, day().cast("string"))
    return t.exceptions.select("case_id", "line", "document_id", target.alias("status"), at("Resolved").alias("resolved_at"), at("Waived").alias("waived_at"))


@query("N02_cp_status", "SELECT case_id, line, CASE WHEN line % 2 = 0 THEN 'Satisfied' ELSE 'Open' END AS status, CASE WHEN line % 2 = 0 THEN '2001-08-01' END AS satisfied_at FROM cps")
def cp_status(t: Tables) -> DataFrame:
    met = F.col("line") % 2 == 0
    return t.cps.select("case_id", "line", F.when(met, "Satisfied").otherwise("Open").alias("status"), F.when(met, day().cast("string")).alias("satisfied_at"))


_VALUE = "coalesce(nullif(trim(CASE WHEN event_id % 4 = 0 THEN ' ' ELSE action END), ''), nullif(trim(props), ''))"


@query("N03_confirm_candidates", f"SELECT event_id, {_VALUE} AS final_value FROM audit WHERE {_VALUE} IS NOT NULL AND length({_VALUE}) <= 10")
def confirm_candidates(t: Tables) -> DataFrame:
    clean = lambda c: F.nullif(F.trim(c), F.lit(""))
    value = F.coalesce(clean(F.when(F.col("event_id") % 4 == 0, " ").otherwise(F.col("action"))), clean(F.col("props")))
    return t.audit.select("event_id", value.alias("final_value")).where("final_value IS NOT NULL AND length(final_value) <= 10")


@query("N04_reject_candidates", "SELECT event_id, CASE WHEN value < 10 THEN 'Rejected' WHEN value > 90 THEN 'Overridden' ELSE 'Pending' END AS status FROM audit")
def reject_candidates(t: Tables) -> DataFrame:
    return t.audit.select("event_id", F.when(F.col("value") < 10, "Rejected").when(F.col("value") > 90, "Overridden").otherwise("Pending").alias("status"))


_REVIEWED = "SELECT event_id, user_id, action AS field, CASE event_id % 5 WHEN 0 THEN 'extracted' WHEN 1 THEN 'reviewed' WHEN 2 THEN 'rejected' ELSE 'needs_review' END AS review, coalesce(CASE WHEN event_id % 3 = 0 THEN nullif(trim(props), '') END, nullif(CASE WHEN event_id % 4 = 0 THEN ' v' || event_id ELSE '' END, '')) AS value FROM audit"


def candidates(t: Tables) -> DataFrame:
    n = F.col("event_id")
    review = F.when(n % 5 == 0, "extracted").when(n % 5 == 1, "reviewed").when(n % 5 == 2, "rejected").otherwise("needs_review")
    edited, proposed = F.when(n % 3 == 0, F.nullif(F.trim("props"), F.lit(""))), F.when(n % 4 == 0, F.concat(F.lit(" v"), n.cast("string")))
    return t.audit.select("event_id", "user_id", F.col("action").alias("field"), review.alias("review"), F.coalesce(edited, proposed).alias("value"))


@query("N05_bulk_verify", f"WITH c AS ({_REVIEWED}), v AS (SELECT * FROM c WHERE review IN ('extracted', 'reviewed') AND trim(value) <> ''), n AS (SELECT user_id, field, trim(value) AS value, 'verified' AS status FROM v QUALIFY row_number() OVER (PARTITION BY user_id, field ORDER BY event_id DESC) = 1), o AS (SELECT user_id, 'click' AS field, full_name AS value, 'manual' AS status FROM users) SELECT * FROM n UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.user_id = o.user_id AND n.field = o.field)")
def bulk_verify(t: Tables) -> DataFrame:
    """The dossier after all extracted or reviewed candidates with a value are confirmed: the latest of a field replaces what is there."""
    ready = candidates(t).where(F.col("review").isin("extracted", "reviewed") & (F.trim("value") != ""))
    new = W.first_by(ready, ["user_id", "field"], [F.desc("event_id")]).select("user_id", "field", F.trim("value").alias("value"), F.lit("verified").alias("status"))
    old = t.users.select("user_id", F.lit("click").alias("field"), F.col("full_name").alias("value"), F.lit("manual").alias("status"))
    return W.upsert(old, new, ["user_id", "field"])


@query("N05b_candidate_status", f"SELECT event_id, CASE WHEN review IN ('extracted', 'reviewed') AND trim(value) <> '' THEN 'Confirmed' ELSE 'Pending' END AS status, CASE WHEN review IN ('extracted', 'reviewed') AND trim(value) <> '' THEN 'verified' ELSE review END AS review FROM ({_REVIEWED})")
def candidate_status(t: Tables) -> DataFrame:
    ok = F.col("review").isin("extracted", "reviewed") & F.coalesce(F.trim("value") != "", F.lit(False))
    return candidates(t).select("event_id", F.when(ok, "Confirmed").otherwise("Pending").alias("status"), F.when(ok, "verified").otherwise(F.col("review")).alias("review"))


@query("N06_mark_verified", "SELECT v.case_id, v.line, CASE WHEN v.status = 'Pending' AND EXISTS (SELECT 1 FROM exports x WHERE x.case_id = v.case_id) THEN 'Verified' ELSE v.status END AS status FROM verifications v")
def mark_verified(t: Tables) -> DataFrame:
    evidence = t.exports.select("case_id").distinct().withColumn("has", F.lit(True))
    return t.verifications.join(evidence, "case_id", "left").select("case_id", "line", F.when((F.col("status") == "Pending") & F.col("has"), "Verified").otherwise(F.col("status")).alias("status"))


@query("N07_decide_approvals", "SELECT approval_id, CASE WHEN status <> 'Pending' THEN status WHEN approval_id % 2 = 0 THEN 'Approved' ELSE 'Rejected' END AS status, status <> 'Pending' AS decided_before FROM approvals")
def decide_approvals(t: Tables) -> DataFrame:
    """One decision for each request: decided ones keep theirs."""
    pending = F.col("status") == "Pending"
    return t.approvals.select("approval_id", F.when(~pending, F.col("status")).when(F.col("approval_id") % 2 == 0, "Approved").otherwise("Rejected").alias("status"), (~pending).alias("decided_before"))


@query("N08_approve_cases", "SELECT case_id, CASE WHEN status = 'Review' AND NOT EXISTS (SELECT 1 FROM exceptions e WHERE e.case_id = c.case_id AND e.status = 'Open' AND e.severity = 'High') THEN 'Approved' ELSE status END AS status FROM cases c")
def approve_cases(t: Tables) -> DataFrame:
    block = t.exceptions.where("status = 'Open' AND severity = 'High'").select("case_id").distinct().withColumn("blocked", F.lit(True))
    return t.cases.join(block, "case_id", "left").select("case_id", F.when((F.col("status") == "Review") & F.col("blocked").isNull(), "Approved").otherwise(F.col("status")).alias("status"))


@query("N09_edit_history", "SELECT event_id, user_id, lag(action) OVER (PARTITION BY user_id ORDER BY event_id) AS old_value, action AS new_value FROM audit")
def edit_history(t: Tables) -> DataFrame:
    return t.audit.select("event_id", "user_id", F.lag("action").over(Window.partitionBy("user_id").orderBy("event_id")).alias("old_value"), F.col("action").alias("new_value"))


@query("N10_locked_upsert", "WITH e AS (SELECT user_id, event_id, action || event_id AS value, action = 'purchase' AS manual FROM audit), l AS (SELECT user_id, role, user_id % 4 = 0 AS locked FROM users) SELECT l.user_id, coalesce(max_by(e.value, e.event_id) FILTER (e.manual OR NOT l.locked), any_value(l.role)) AS role FROM l LEFT JOIN e ON e.user_id = l.user_id GROUP BY l.user_id")
def locked_upsert(t: Tables) -> DataFrame:
    """The last edit of each field counts; a locked field (every 4th user's) takes those from manual sources only."""
    edits = t.audit.select("user_id", "event_id", F.concat("action", F.col("event_id").cast("string")).alias("value"), (F.col("action") == "purchase").alias("manual"))
    last = edits.groupBy("user_id").agg(F.max_by("value", "event_id").alias("any"), F.max_by("value", F.when(F.col("manual"), F.col("event_id"))).alias("by_hand"))
    return t.users.join(last, "user_id", "left").select("user_id", F.coalesce(F.when(F.col("user_id") % 4 == 0, F.col("by_hand")).otherwise(F.col("any")), F.col("role")).alias("role"))


@query("N11_read_all", "SELECT event_id, (user_id = 7 OR value >= 50) AS is_read FROM audit")
def read_all(t: Tables) -> DataFrame:
    return t.audit.select("event_id", ((F.col("user_id") == 7) | (F.col("value") >= 50)).alias("is_read"))
