"""Queries of the aggregation family (A)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import AS_OF, SEVERITIES, STATUSES, Tables
from ..operators import kpis as K
from ..registry import query

DAYS = 365
HARD_STOPS = ["R-1", "R-22", "R-35"]
_CUT = "DATE '2000-08-01'"  # AS_OF - DAYS
assert AS_OF - dt.timedelta(days=DAYS) == dt.date(2000, 8, 1)


@query("A01_active_cases", f"SELECT count(*) AS active_cases FROM cases WHERE status <> 'Closed' AND created >= {_CUT}")
def active_cases(t: Tables) -> DataFrame:
    return t.cases.where((F.col("status") != "Closed") & K.since("created", AS_OF, DAYS)).agg(F.count("*").alias("active_cases"))


@query("A02_open_high_exceptions", "SELECT count(*) AS open_high FROM exceptions WHERE severity = 'High' AND status = 'Open'")
def open_high(t: Tables) -> DataFrame:
    return t.exceptions.where("severity = 'High' AND status = 'Open'").agg(F.count("*").alias("open_high"))


_SAT = "status = 'Satisfied' OR satisfied IS NOT NULL"


@query("A03_cp_completion", f"WITH x AS (SELECT count(CASE WHEN {_SAT} THEN 1 END) AS sat, count(CASE WHEN status = 'Open' THEN 1 END) AS op FROM cps) SELECT sat, op, CASE WHEN sat + op = 0 THEN 100.0 ELSE round(sat * 100.0 / (sat + op), 1) END::DOUBLE AS pct FROM x")
def cp_completion(t: Tables) -> DataFrame:
    return t.cps.agg(K.n(F.expr(_SAT), "sat"), K.n(F.col("status") == "Open", "op")).withColumn("pct", K.pct(F.col("sat"), F.col("sat") + F.col("op")))


@query("A03b_cp_completion_by_case", "SELECT case_id, round(count(satisfied) * 100.0 / count(*), 1)::DOUBLE AS pct FROM cps GROUP BY case_id")
def cp_completion_by_case(t: Tables) -> DataFrame:
    return t.cps.groupBy("case_id").agg(K.pct(F.count("satisfied"), F.count("*")).alias("pct"))


@query("A03c_cp_readiness", "WITH x AS (SELECT case_id, count(CASE WHEN status IN ('Satisfied', 'Waived') OR satisfied IS NOT NULL THEN 1 END) AS sat, count(CASE WHEN status = 'Open' THEN 1 END) AS op FROM cps GROUP BY case_id) SELECT case_id, CASE WHEN sat + op = 0 THEN 100.0 ELSE round(sat * 100.0 / (sat + op), 1) END::DOUBLE AS pct, (sat + op = 0 OR sat * 100.0 / (sat + op) >= 80) AS ready FROM x")
def cp_readiness(t: Tables) -> DataFrame:
    x = t.cps.groupBy("case_id").agg(K.n(F.col("status").isin("Satisfied", "Waived") | F.col("satisfied").isNotNull(), "sat"), K.n(F.col("status") == "Open", "op"))
    total = F.col("sat") + F.col("op")
    return x.select("case_id", K.pct(F.col("sat"), total).alias("pct"), (F.when(total == 0, True).otherwise(F.col("sat") * 100.0 / total >= 80)).alias("ready"))


@query("A04_verification_completion", "WITH x AS (SELECT count(CASE WHEN status = 'Verified' THEN 1 END) AS ok, count(CASE WHEN status = 'Pending' THEN 1 END) AS todo FROM verifications) SELECT ok, todo, CASE WHEN ok + todo = 0 THEN 100.0 ELSE round(ok * 100.0 / (ok + todo), 1) END::DOUBLE AS pct FROM x")
def verification_completion(t: Tables) -> DataFrame:
    x = t.verifications.agg(K.n(F.col("status") == "Verified", "ok"), K.n(F.col("status") == "Pending", "todo"))
    return x.withColumn("pct", K.pct(F.col("ok"), F.col("ok") + F.col("todo")))


@query("A05_backlog", "SELECT count(*) AS backlog, CAST(min(updated) AS VARCHAR) AS oldest FROM cases WHERE status = 'Processing'")
def backlog(t: Tables) -> DataFrame:
    return t.cases.where("status = 'Processing'").agg(F.count("*").alias("backlog"), F.min("updated").cast("string").alias("oldest"))


@query("A06_cases_by_status", f"SELECT s AS status, count(c.case_id) AS cases FROM (VALUES {', '.join(f"('{s}')" for s in STATUSES)}) d(s) LEFT JOIN cases c ON c.status = s GROUP BY s")
def cases_by_status(t: Tables) -> DataFrame:
    return K.zero_filled(t.cases, "status", STATUSES, "cases")


@query("A07_exceptions_by_severity", "SELECT s AS severity, count(e.case_id) AS open FROM (VALUES ('High'), ('Medium'), ('Low')) d(s) LEFT JOIN exceptions e ON e.severity = s AND e.status = 'Open' GROUP BY s")
def exceptions_by_severity(t: Tables) -> DataFrame:
    return K.zero_filled(t.exceptions.where("status = 'Open'"), "severity", SEVERITIES, "open")


def _daily_sql(days: int, metrics: dict[str, str]) -> str:
    cols = ", ".join(f"(SELECT count(*) FROM {q} = d.day) AS {k}" for k, q in metrics.items())
    first = AS_OF - dt.timedelta(days=days - 1)
    return f"SELECT CAST(d.day AS VARCHAR) AS day, {cols} FROM (SELECT CAST(r AS DATE) AS day FROM range(DATE '{first}', DATE '{AS_OF + dt.timedelta(days=1)}', INTERVAL 1 DAY) x(r)) d"


@query("A08_daily_series", _daily_sql(30, {"cases": "cases WHERE created", "exports": "exports WHERE created", "high": "exceptions WHERE severity = 'High' AND created"}))
def daily_series(t: Tables) -> DataFrame:
    return K.daily({"cases": (t.cases, "created"), "exports": (t.exports, "created"), "high": (t.exceptions.where("severity = 'High'"), "created")}, AS_OF, 30)


@query("A09_case_daily_series", _daily_sql(90, {"opened": "exceptions WHERE created", "resolved": "exceptions WHERE resolved", "cps": "cps WHERE satisfied", "verified": "verifications WHERE status = 'Verified' AND verified", "exports": "exports WHERE created", "updates": "cases WHERE updated", "approvals": "approvals WHERE created"}))
def case_daily_series(t: Tables) -> DataFrame:
    return K.daily(
        {
            "opened": (t.exceptions, "created"), "resolved": (t.exceptions, "resolved"), "cps": (t.cps, "satisfied"), "verified": (t.verifications.where("status = 'Verified'"), "verified"),
            "exports": (t.exports, "created"), "updates": (t.cases, "updated"), "approvals": (t.approvals, "created"),
        }, AS_OF, 90)


_COUNTED = """SELECT c.*, coalesce(e.high, 0) AS high, coalesce(e.medium, 0) AS medium, coalesce(e.low, 0) AS low, coalesce(v.pending, 0) AS pending
  FROM cases c LEFT JOIN (SELECT case_id, count(CASE WHEN severity = 'High' THEN 1 END) AS high, count(CASE WHEN severity = 'Medium' THEN 1 END) AS medium,
    count(CASE WHEN severity = 'Low' THEN 1 END) AS low FROM exceptions WHERE status = 'Open' GROUP BY case_id) e USING (case_id)
  LEFT JOIN (SELECT case_id, count(*) AS pending FROM verifications WHERE status = 'Pending' GROUP BY case_id) v USING (case_id)"""
_SHOWN = ["case_id", "title", "status", "high", "medium", "low", "pending"]
_SHOW = f"{', '.join(_SHOWN)}, CAST(updated AS VARCHAR) AS updated"


def _shown(df: DataFrame) -> DataFrame:
    return df.select(*_SHOWN, F.col("updated").cast("string").alias("updated"))


@query("A10_needs_attention", f"WITH q AS ({_COUNTED}), r AS (SELECT q.*, u.full_name FROM q LEFT JOIN users u ON u.user_id = q.assigned_to) SELECT {_SHOW}, full_name FROM r WHERE (high > 0 OR pending > 0) AND created >= {_CUT} ORDER BY high DESC, pending DESC, r.updated DESC, case_id LIMIT 15")
def needs_attention(t: Tables) -> DataFrame:
    top = K.needs_attention(t.cases.where(K.since("created", AS_OF, DAYS)), t.exceptions, t.verifications, 15)
    # The users join the 15 rows that are left, not all cases.
    return top.join(t.users.select("user_id", "full_name"), F.col("assigned_to") == F.col("user_id"), "left").select(*_SHOWN, F.col("updated").cast("string").alias("updated"), "full_name")


@query("A11_ready_for_approval", f"WITH q AS ({_COUNTED}) SELECT {_SHOW} FROM q WHERE status IN ('Review', 'Ready for Approval') AND decision IS NULL AND high = 0 AND pending = 0 ORDER BY q.updated DESC, case_id LIMIT 10")
def ready_for_approval(t: Tables) -> DataFrame:
    q = K.counted_cases(t.cases.where(F.col("status").isin("Review", "Ready for Approval") & F.col("decision").isNull()), t.exceptions, t.verifications)
    return _shown(q.where("high = 0 AND pending = 0").orderBy(F.desc("updated"), "case_id").limit(10))


_LABELS = {"exception_waive": "Waive exception", "case_decision": "Case decision", "export_release": "Release export"}


@query("A12_approvals_pending", "SELECT approval_id, CASE request_type WHEN 'exception_waive' THEN 'Waive exception' WHEN 'case_decision' THEN 'Case decision' WHEN 'export_release' THEN 'Release export' ELSE request_type END AS label, coalesce(c.title, 'Unknown') AS title, (SELECT count(*) FROM approvals WHERE status = 'Pending') AS pending FROM approvals a LEFT JOIN cases c USING (case_id) WHERE a.status = 'Pending' ORDER BY a.created DESC, approval_id LIMIT 5")
def approvals_pending(t: Tables) -> DataFrame:
    todo = t.approvals.where("status = 'Pending'")
    top = todo.orderBy(F.desc("created"), "approval_id").limit(5)
    label = F.when(F.col("request_type").isin(*_LABELS), F.element_at(F.create_map(*[F.lit(x) for kv in _LABELS.items() for x in kv]), F.col("request_type"))).otherwise(F.col("request_type"))
    total = todo.agg(F.count("*").alias("pending"))
    return top.join(t.cases.select("case_id", "title"), "case_id", "left").crossJoin(F.broadcast(total)).select("approval_id", label.alias("label"), F.coalesce("title", F.lit("Unknown")).alias("title"), "pending")


@query("A13_cohort", f"WITH q AS ({_COUNTED}) SELECT {_SHOW} FROM q WHERE status = 'Processing' AND high > 0 AND assigned_to IS NULL AND q.updated <= DATE '2001-07-29' AND (high > 0 OR pending > 0) ORDER BY high DESC, q.updated DESC, case_id LIMIT 50")
def cohort(t: Tables) -> DataFrame:
    return _shown(K.cohort(t.cases, t.exceptions, t.verifications, status="Processing", severity="High", owner="unassigned", preset="stale_unassigned", as_of=AS_OF, updated_on="not a date"))


@query("A14_cohort_export", f"WITH q AS ({_COUNTED}) SELECT {_SHOW} FROM q WHERE medium > 0 ORDER BY high DESC, q.updated DESC, case_id LIMIT 500")
def cohort_export(t: Tables) -> DataFrame:
    return _shown(K.cohort(t.cases, t.exceptions, t.verifications, severity="Medium", limit=500))


@query("A15_case_insights", "SELECT count(CASE WHEN severity = 'High' AND status = 'Open' THEN 1 END) AS high, count(CASE WHEN severity = 'Medium' AND status = 'Open' THEN 1 END) AS medium, count(CASE WHEN severity = 'Low' AND status = 'Open' THEN 1 END) AS low, CAST(max(resolved) AS VARCHAR) AS last_resolved, (SELECT count(*) FROM exports) AS exports FROM exceptions")
def case_insights(t: Tables) -> DataFrame:
    e = t.exceptions.agg(*[K.n((F.col("severity") == s) & (F.col("status") == "Open"), s.lower()) for s in SEVERITIES], F.max("resolved").cast("string").alias("last_resolved"))
    return e.crossJoin(F.broadcast(t.exports.agg(F.count("*").alias("exports"))))  # one row each


_STOP = "(severity = 'High' AND (contains(rule_id, 'R-1') OR contains(rule_id, 'R-22') OR contains(rule_id, 'R-35')))"


@query("A16_risk_score", f"WITH x AS (SELECT case_id, CAST(sum(CASE severity WHEN 'High' THEN 10 WHEN 'Medium' THEN 3 WHEN 'Low' THEN 1 ELSE 0 END + CASE WHEN {_STOP} THEN 25 ELSE 0 END) AS BIGINT) AS score, count(CASE WHEN {_STOP} THEN 1 END) AS hard_stops FROM exceptions WHERE status IN ('Open', 'Pending') GROUP BY case_id) SELECT *, CASE WHEN score = 0 THEN 'Green' WHEN score < 25 THEN 'Amber' ELSE 'Red' END AS label FROM x")
def risk_score(t: Tables) -> DataFrame:
    return K.risk_scores(t.exceptions, HARD_STOPS)


@query("A17_readiness", "WITH e AS (SELECT case_id, count(CASE WHEN severity = 'High' AND status = 'Open' THEN 1 END) AS high FROM exceptions GROUP BY case_id), v AS (SELECT case_id, count(CASE WHEN status = 'Pending' THEN 1 END) AS pending, count(CASE WHEN status = 'Failed' THEN 1 END) AS failed FROM verifications GROUP BY case_id) SELECT c.case_id, concat_ws('; ', CASE WHEN e.high > 0 THEN 'open high exceptions: ' || e.high END, CASE WHEN v.pending > 0 THEN 'pending verifications: ' || v.pending END, CASE WHEN v.failed > 0 THEN 'failed verifications: ' || v.failed END, CASE WHEN c.assigned_to IS NULL THEN 'unassigned' END, CASE WHEN c.status = 'Closed' THEN 'closed' END) AS reasons, (coalesce(e.high, 0) = 0 AND coalesce(v.pending, 0) = 0 AND coalesce(v.failed, 0) = 0 AND c.assigned_to IS NOT NULL AND c.status <> 'Closed') AS ready FROM cases c LEFT JOIN e USING (case_id) LEFT JOIN v USING (case_id)")
def readiness(t: Tables) -> DataFrame:
    e = t.exceptions.groupBy("case_id").agg(K.n((F.col("severity") == "High") & (F.col("status") == "Open"), "high"))
    v = t.verifications.groupBy("case_id").agg(K.n(F.col("status") == "Pending", "pending"), K.n(F.col("status") == "Failed", "failed"))
    said = lambda text, c: F.when(F.col(c) > 0, F.concat(F.lit(text), F.col(c).cast("string")))
    checks = F.array_compact(F.array(said("open high exceptions: ", "high"), said("pending verifications: ", "pending"), said("failed verifications: ", "failed"), F.when(F.col("assigned_to").isNull(), "unassigned"), F.when(F.col("status") == "Closed", "closed")))
    return t.cases.join(e, "case_id", "left").join(v, "case_id", "left").select("case_id", F.array_join(checks, "; ").alias("reasons"), (F.size(checks) == 0).alias("ready"))


@query("A18_severity_status_matrix", "SELECT coalesce(severity, 'Medium') AS severity, count(CASE WHEN status = 'Open' THEN 1 END) AS open, count(CASE WHEN status = 'Resolved' THEN 1 END) AS resolved, count(CASE WHEN status = 'Waived' THEN 1 END) AS waived FROM exceptions GROUP BY 1")
def severity_status_matrix(t: Tables) -> DataFrame:
    e = t.exceptions.select(F.coalesce("severity", F.lit("Medium")).alias("severity"), F.lower(F.coalesce("status", F.lit("Open"))).alias("status"))
    return e.groupBy("severity").pivot("status", ["open", "resolved", "waived"]).agg(F.count(F.lit(1))).na.fill(0)


@query("A19_decision_label", "WITH e AS (SELECT case_id, count(CASE WHEN severity = 'High' THEN 1 END) AS high, count(CASE WHEN severity IN ('Medium', 'Low') THEN 1 END) AS rest FROM exceptions WHERE status = 'Open' GROUP BY case_id), c AS (SELECT case_id, count(*) AS open_cps FROM cps WHERE status = 'Open' GROUP BY case_id) SELECT case_id, coalesce(high, 0) AS high, coalesce(rest, 0) AS rest, coalesce(open_cps, 0) AS open_cps, CASE WHEN high >= 2 THEN 'Review Required' WHEN high >= 1 THEN 'Hold' WHEN coalesce(open_cps, 0) > 0 OR coalesce(rest, 0) > 0 THEN 'Proceed with Conditions' ELSE 'Ready' END AS decision FROM e FULL JOIN c USING (case_id)")
def decision_label(t: Tables) -> DataFrame:
    return K.decision_labels(t.exceptions, t.cps).drop("critical")


_RANK = "CASE severity WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 3 ELSE 4 END"


@query("A20_key_issues", f"WITH x AS (SELECT case_id, rule_id, severity, line, row_number() OVER (PARTITION BY case_id ORDER BY {_RANK}, rule_id, line, document_id) AS rn FROM exceptions WHERE status = 'Open') SELECT case_id, rule_id, severity, CAST(rn AS INTEGER) AS rn FROM x WHERE rn <= 5")
def key_issues(t: Tables) -> DataFrame:
    w = Window.partitionBy("case_id").orderBy(F.expr(_RANK), "rule_id", "line", "document_id")
    return t.exceptions.where("status = 'Open'").withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("case_id", "rule_id", "severity", "rn")


@query("A21_exception_rollup", "SELECT case_id, count(CASE WHEN severity = 'High' THEN 1 END) AS high, count(CASE WHEN severity = 'Medium' THEN 1 END) AS medium, count(CASE WHEN severity = 'Low' THEN 1 END) AS low, count(CASE WHEN status = 'Open' THEN 1 END) AS open, count(CASE WHEN status = 'Resolved' THEN 1 END) AS resolved, count(CASE WHEN status = 'Waived' THEN 1 END) AS waived FROM exceptions GROUP BY case_id")
def exception_rollup(t: Tables) -> DataFrame:
    return t.exceptions.groupBy("case_id").agg(*[K.n(F.col("severity") == s, s.lower()) for s in SEVERITIES], *[K.n(F.col("status") == s, s.lower()) for s in ("Open", "Resolved", "Waived")])


@query("A22_cp_rollup", "SELECT CASE WHEN status = 'Satisfied' THEN 'Met' ELSE status END AS status, count(*) AS cps FROM cps GROUP BY 1")
def cp_rollup(t: Tables) -> DataFrame:
    return t.cps.groupBy(F.when(F.col("status") == "Satisfied", "Met").otherwise(F.col("status")).alias("status")).agg(F.count("*").alias("cps"))


@query("A23_ocr_status", "WITH p AS (SELECT source, length(text) AS chars, CASE WHEN n_chars % 13 = 0 THEN 'Failed' ELSE 'Done' END AS status, doc_id % 60 AS seconds FROM documents), x AS (SELECT source, count(*) AS pages, count(CASE WHEN status = 'Failed' THEN 1 END) AS failed, round(avg(CASE WHEN status = 'Done' THEN chars END), 2) AS avg_chars, max(seconds) AS max_seconds FROM p GROUP BY source) SELECT *, CASE WHEN failed > 0.2 * pages THEN 'Critical' WHEN failed > 0 OR avg_chars < 80 THEN 'Low' ELSE 'Good' END AS quality FROM x")
def ocr_status(t: Tables) -> DataFrame:
    p = t.documents.select("source", F.length("text").alias("chars"), F.when(F.col("n_chars") % 13 == 0, "Failed").otherwise("Done").alias("status"), (F.col("doc_id") % 60).alias("seconds"))
    x = p.groupBy("source").agg(F.count("*").alias("pages"), K.n(F.col("status") == "Failed", "failed"), F.round(F.avg(F.when(F.col("status") == "Done", F.col("chars"))), 2).alias("avg_chars"), F.max("seconds").alias("max_seconds"))
    return x.withColumn("quality", F.when(F.col("failed") > 0.2 * F.col("pages"), "Critical").when((F.col("failed") > 0) | (F.col("avg_chars") < 80), "Low").otherwise("Good"))


@query("A24_dossier_stats", "SELECT doc_id % 10 AS case_id, count(CASE WHEN quality = 1 THEN 1 END) AS confirmed, count(CASE WHEN quality IS DISTINCT FROM 1 THEN 1 END) AS pending FROM labels GROUP BY 1")
def dossier_stats(t: Tables) -> DataFrame:
    return t.raw("labels").groupBy((F.col("doc_id") % 10).alias("case_id")).agg(K.n(F.col("quality") == 1, "confirmed"), K.n(~F.col("quality").eqNullSafe(F.lit(1)), "pending"))


_PAGES = "SELECT doc_id, (length(line) % 101) / 100.0 AS score, (length(line) % 7 = 0) AS failed FROM lines"
_LEVEL = "CASE WHEN {0} >= 0.7 THEN 'good' WHEN {0} >= 0.45 THEN 'fair' WHEN {0} >= 0.3 THEN 'poor' ELSE 'unusable' END"
_DOWN = "CASE {0} WHEN 'good' THEN 'fair' WHEN 'fair' THEN 'poor' ELSE 'unusable' END"


@query("A25_document_quality", f"WITH pg AS ({_PAGES}), a AS (SELECT doc_id, avg(score) AS mean, count(*) AS pages, count(CASE WHEN failed THEN 1 END) AS failed, count(CASE WHEN score < 0.45 THEN 1 END) AS poor FROM pg GROUP BY doc_id), b AS (SELECT *, {_LEVEL.format('mean')} AS l0 FROM a), c AS (SELECT *, CASE WHEN failed > 0.2 * pages THEN {_DOWN.format('l0')} ELSE l0 END AS l1 FROM b), d AS (SELECT *, CASE WHEN poor > 0 AND l1 = 'good' THEN 'fair' ELSE l1 END AS l2 FROM c) SELECT doc_id, pages, failed, poor, CASE WHEN poor > greatest(1, floor(pages / 2)) THEN {_DOWN.format('l2')} ELSE l2 END AS quality FROM d")
def document_quality(t: Tables) -> DataFrame:
    score = (F.length("line") % 101) / F.lit(100.0)
    pages = t.lines.select("doc_id", score.alias("score"), (F.length("line") % 7 == 0).alias("failed"), K.quality_level(score).alias("level"))
    return K.document_quality(pages).drop("mean")


@query("A26_pipeline_quality", f"WITH pg AS ({_PAGES}), a AS (SELECT doc_id, avg(score) AS mean, count(*) AS pages, count(CASE WHEN score < 0.45 THEN 1 END) AS poor FROM pg GROUP BY doc_id), b AS (SELECT *, {_LEVEL.format('mean')} AS l0 FROM a), d AS (SELECT *, CASE WHEN poor > 0 AND l0 = 'good' THEN 'fair' ELSE l0 END AS l2 FROM b) SELECT doc_id, CASE WHEN poor > greatest(1, floor(pages / 2)) THEN {_DOWN.format('l2')} ELSE l2 END AS quality FROM d")
def pipeline_quality(t: Tables) -> DataFrame:
    score = (F.length("line") % 101) / F.lit(100.0)
    pages = t.lines.select("doc_id", score.alias("score"), F.lit(False).alias("failed"), K.quality_level(score).alias("level"))
    return K.document_quality(pages).select("doc_id", "quality")


@query("A27_digest", f"WITH q AS ({_COUNTED}) SELECT {_SHOW}, (SELECT count(*) FROM cases WHERE status <> 'Closed' AND created >= {_CUT}) AS active_cases FROM q WHERE high > 0 OR pending > 0 ORDER BY high DESC, case_id LIMIT 10")
def digest(t: Tables) -> DataFrame:
    top = K.counted_cases(t.cases, t.exceptions, t.verifications).where("high > 0 OR pending > 0").orderBy(F.desc("high"), "case_id").limit(10)
    return _shown(top).crossJoin(F.broadcast(active_cases(t)))


@query("A28_notifications", "SELECT user_id, count(*) AS total, count(CASE WHEN value < 50 THEN 1 END) AS unread FROM audit GROUP BY user_id")
def notifications(t: Tables) -> DataFrame:
    return t.audit.groupBy("user_id").agg(F.count("*").alias("total"), K.n(F.col("value") < 50, "unread"))


@query("A29_paginated_cases", "SELECT case_id, title, (SELECT count(*) FROM cases WHERE title ILIKE '%high%') AS total, greatest(1, CAST(ceil((SELECT count(*) FROM cases WHERE title ILIKE '%high%') / 20.0) AS BIGINT)) AS pages FROM cases WHERE title ILIKE '%high%' ORDER BY created DESC, case_id LIMIT 20 OFFSET 40")
def paginated_cases(t: Tables) -> DataFrame:
    found = t.cases.where(F.col("title").ilike("%high%"))
    total = found.agg(F.count("*").alias("total"), F.greatest(F.lit(1).cast("long"), F.ceil(F.count("*") / 20.0)).alias("pages"))
    return found.orderBy(F.desc("created"), "case_id").offset(40).limit(20).select("case_id", "title").crossJoin(F.broadcast(total))


@query("A30_retention_dry_run", "WITH old AS (SELECT case_id FROM cases WHERE status = 'Closed' AND created < DATE '1996-01-01'), e AS (SELECT case_id, count(*) AS n FROM exceptions GROUP BY 1), c AS (SELECT case_id, count(*) AS n FROM cps GROUP BY 1), v AS (SELECT case_id, count(*) AS n FROM verifications GROUP BY 1) SELECT case_id, coalesce(e.n, 0) AS exceptions, coalesce(c.n, 0) AS cps, coalesce(v.n, 0) AS verifications FROM old LEFT JOIN e USING (case_id) LEFT JOIN c USING (case_id) LEFT JOIN v USING (case_id)".replace("AS exceptions", "AS n_exceptions").replace("AS cps", "AS n_cps").replace("AS verifications", "AS n_verifications"))
def retention_dry_run(t: Tables) -> DataFrame:
    out = t.cases.where((F.col("status") == "Closed") & (F.col("created") < F.lit(dt.date(1996, 1, 1)))).select("case_id")
    for name, df in (("n_exceptions", t.exceptions), ("n_cps", t.cps), ("n_verifications", t.verifications)):
        out = out.join(df.groupBy("case_id").agg(F.count("*").alias(name)), "case_id", "left")
    return out.na.fill(0)


@query("A31_evaluation_dashboard", "SELECT count(*) AS runs, round(avg(coalesce(CASE WHEN quality = 1 THEN toxic END, 0)), 6) AS mean_recall, CAST(sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS BIGINT) AS missed FROM labels")
def evaluation_dashboard(t: Tables) -> DataFrame:
    recall = F.when(F.col("quality") == 1, F.col("toxic"))
    return t.raw("labels").agg(F.count("*").alias("runs"), F.round(F.avg(F.coalesce(recall, F.lit(0))), 6).alias("mean_recall"), F.sum(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("missed"))


@query("A32_trend_totals", f"SELECT CAST(sum(cases) AS BIGINT) AS cases_total, CAST(sum(exports) AS BIGINT) AS exports_total, CAST(sum(high) AS BIGINT) AS high_total FROM ({_daily_sql(30, {'cases': 'cases WHERE created', 'exports': 'exports WHERE created', 'high': 'exceptions WHERE severity = ' + chr(39) + 'High' + chr(39) + ' AND created'})})")
def trend_totals(t: Tables) -> DataFrame:
    return daily_series(t).agg(*[F.sum(c).alias(f"{c}_total") for c in ("cases", "exports", "high")])


@query("A33_cp_command_centre", "SELECT count(*) AS all_cps, count(CASE WHEN status = 'Open' THEN 1 END) AS open, count(CASE WHEN status = 'Open' AND created + CASE severity WHEN 'High' THEN 7 WHEN 'Medium' THEN 14 ELSE 21 END < DATE '2001-08-01' THEN 1 END) AS overdue, count(CASE WHEN status = 'Satisfied' THEN 1 END) AS fulfilled, count(CASE WHEN status = 'Waived' THEN 1 END) AS waived, count(DISTINCT CASE WHEN status = 'Open' THEN case_id END) AS open_cases FROM cps")
def cp_command_centre(t: Tables) -> DataFrame:
    due = F.date_add("created", F.when(F.col("severity") == "High", 7).when(F.col("severity") == "Medium", 14).otherwise(21))
    is_open = F.col("status") == "Open"
    return t.cps.agg(F.count("*").alias("all_cps"), K.n(is_open, "open"), K.n(is_open & (due < F.lit(AS_OF)), "overdue"), K.n(F.col("status") == "Satisfied", "fulfilled"), K.n(F.col("status") == "Waived", "waived"), F.countDistinct(F.when(is_open, F.col("case_id"))).alias("open_cases"))


@query("A34_conflicting_values", "SELECT case_id, count(DISTINCT rule_id) AS distinct_values FROM exceptions GROUP BY case_id HAVING count(DISTINCT rule_id) > 1")
def conflicting_values(t: Tables) -> DataFrame:
    return t.exceptions.groupBy("case_id").agg(F.countDistinct("rule_id").alias("distinct_values")).where("distinct_values > 1")


@query("A35_first_and_list", "SELECT case_id, arg_min(rule_id, line * 100000000 + document_id) AS first_rule, string_agg(DISTINCT severity, ',' ORDER BY severity) AS severities FROM exceptions GROUP BY case_id")
def first_and_list(t: Tables) -> DataFrame:
    return t.exceptions.groupBy("case_id").agg(F.min_by("rule_id", F.col("line") * 100000000 + F.col("document_id")).alias("first_rule"), F.array_join(F.sort_array(F.collect_set("severity")), ",").alias("severities"))
