"""Queries of partitioned tables and of binary files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Tables
from ..registry import query
from ..session import shared_folder
from ..sources import partitioned as P
from ..sources import pdf

_USER = "user_id long, role string"


@query("S21b_partitioned_upsert", "SELECT user_id, CASE WHEN user_id % 50 = 7 THEN 'new' ELSE role END AS role FROM users UNION ALL SELECT user_id + 1000000, 'new' FROM users WHERE user_id % 50 = 0")
def partitioned_upsert(t: Tables) -> DataFrame:
    """Changed and added users; partitions without one aren't rewritten."""
    path, old = shared_folder(t.spark, "users"), t.users.select(F.col("user_id").cast("long").alias("user_id"), "role")
    P.create(old, path, ["user_id"])
    changed = old.where("user_id % 50 = 7").unionByName(old.where("user_id % 50 = 0").withColumn("user_id", F.col("user_id") + 1000000)).withColumn("role", F.lit("new"))
    P.upsert(t.spark, path, _USER, changed, ["user_id"])
    return P.read(t.spark, path, _USER).select("user_id", "role")


_CASE = "case_id long, status string, assigned_to long, created date"


def _cases(t: Tables) -> str:
    path = shared_folder(t.spark, "cases")
    P.create(t.cases.select(F.col("case_id").cast("long").alias("case_id"), "status", F.col("assigned_to").cast("long").alias("assigned_to"), "created"), path, ["case_id"])
    return path


@query("S22b_partitioned_update", "SELECT case_id, CASE WHEN status = 'Processing' AND assigned_to IS NULL THEN 'Queued' ELSE status END AS status FROM cases")
def partitioned_update(t: Tables) -> DataFrame:
    path = _cases(t)
    P.update(t.spark, path, _CASE, (F.col("status") == "Processing") & F.col("assigned_to").isNull(), {"status": F.lit("Queued")})
    return P.read(t.spark, path, _CASE).select("case_id", "status")


_LINE = "case_id long, line int"


def _lines(t: Tables, df: DataFrame, name: str) -> str:
    path = shared_folder(t.spark, name)
    P.create(df.select(F.col("case_id").cast("long").alias("case_id"), F.col("line").cast("int").alias("line")), path, ["case_id"])
    return path


@query("S23b_partitioned_delete", "SELECT case_id, CAST(line AS INTEGER) AS line FROM exceptions WHERE case_id NOT IN (SELECT case_id FROM cases WHERE status = 'Closed')")
def partitioned_delete(t: Tables) -> DataFrame:
    path = _lines(t, t.exceptions, "exceptions")
    P.delete(t.spark, path, _LINE, t.cases.where("status = 'Closed'").select(F.col("case_id").cast("long").alias("case_id")), ["case_id"])
    return P.read(t.spark, path, _LINE).select("case_id", "line")


_GONE = "(SELECT case_id FROM cases WHERE status = 'Closed' AND created < DATE '1995-01-01')"


@query("S24b_partitioned_cascade", f"SELECT 'exception' AS relation, count(*) AS before, count(CASE WHEN case_id NOT IN {_GONE} THEN 1 END) AS kept FROM exceptions UNION ALL SELECT 'cp', count(*), count(CASE WHEN case_id NOT IN {_GONE} THEN 1 END) FROM cps UNION ALL SELECT 'case', count(*), count(CASE WHEN case_id NOT IN {_GONE} THEN 1 END) FROM cases")
def partitioned_cascade(t: Tables) -> DataFrame:
    """Old closed cases go, first what hangs on them, then they; with the rows of each relation before and after."""
    gone = t.cases.where((F.col("status") == "Closed") & (F.col("created") < F.lit(dt.date(1995, 1, 1)))).select(F.col("case_id").cast("long").alias("case_id"))
    out = None
    for name, path, schema in (("exception", _lines(t, t.exceptions, "exceptions"), _LINE), ("cp", _lines(t, t.cps, "cps"), _LINE), ("case", _cases(t), _CASE)):
        count = lambda c, p=path, s=schema: P.read(t.spark, p, s).agg(F.count("*").alias(c))
        before = count("before").first()[0]
        P.delete(t.spark, path, schema, gone, ["case_id"])
        row = count("kept").select(F.lit(name).alias("relation"), F.lit(before).alias("before"), "kept")
        out = row if out is None else out.unionByName(row)
    return out


@query("S11b_pdf_pages", "SELECT CAST(doc_id // 50 AS BIGINT) AS bundle, CAST(row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id, n_chars) AS INTEGER) AS page, CAST(count(*) OVER (PARTITION BY doc_id // 50) AS INTEGER) AS pages, length(text) AS chars, md5(text) AS content FROM documents")
def pdf_pages(t: Tables) -> DataFrame:
    """Documents as PDF files of fifty pages each, written by the executors, and their pages read back."""
    home = shared_folder(t.spark, "scans")
    doc = F.struct("doc_id", "n_chars", "text")
    bundles = t.documents.groupBy(F.floor(F.col("doc_id") / 50).alias("bundle")).agg(F.sort_array(F.collect_list(doc)).alias("d"))  # fifty documents
    bundles.select("bundle", pdf.bundled(F.transform("d", lambda d: d["text"])).alias("value")).repartition("bundle").write.partitionBy("bundle").text(home)
    found = pdf.read(t.spark, home, "*.txt")
    return found.select(F.regexp_extract("path", "bundle=(-?[0-9]+)", 1).cast("long").alias("bundle"), "page", "pages", F.length("text").cast("long").alias("chars"), F.md5(F.col("text").cast("binary")).alias("content"))
