"""Tables of the case domain over the given Parquet files.

Every relation is a projection of one physical table, so filters and column
pruning reach the scan.  VIEWS has the same projections as SQL for DuckDB.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The day all look-back windows end on: never the wall clock, so results repeat.
AS_OF = dt.date(2001, 8, 1)
AS_OF_EVENTS = dt.date(2024, 1, 30)

STATUSES = ["New", "Processing", "Review", "Pending Docs", "Ready for Approval", "Approved", "Rejected", "Closed"]
SEVERITIES = ["High", "Medium", "Low"]


def pick(column: Column, values: dict[str, str], other: str | None = None) -> Column:
    out = F
    for k, v in values.items():
        out = out.when(column == k, v)
    return out.otherwise(other)


class Tables:
    """Lazily loaded relations of one data folder; org_id narrows cases to one tenant."""

    def __init__(self, spark: SparkSession, sf_dir: str, org_id: int | None = None):
        self.spark, self.dir, self.org_id = spark, sf_dir, org_id

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def cases(self) -> DataFrame:
        day = F.col("o_orderdate").cast("date")
        out = self.raw("orders").select(
            F.col("o_orderkey").alias("case_id"),
            F.col("o_orderpriority").alias("title"),
            pick(F.col("o_orderstatus"), {"F": "Closed", "O": "Processing", "P": "Review"}).alias("status"),
            day.alias("created"),
            F.date_add(day, (F.col("o_orderkey") % 30).cast("int")).alias("updated"),
            F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")).alias("assigned_to"),
            F.when(F.col("o_orderkey") % 3 == 0, "Approved").alias("decision"),
            (F.col("o_custkey") % 5).cast("int").alias("org_id"),
            F.col("o_totalprice").alias("amount"),
        )
        return out if self.org_id is None else out.where(F.col("org_id") == self.org_id)

    @cached_property
    def exceptions(self) -> DataFrame:
        day = F.col("l_shipdate").cast("date")
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("case_id"),
            F.col("l_linenumber").alias("line"),
            F.concat(F.lit("R-"), (F.col("l_partkey") % 40).cast("string")).alias("rule_id"),
            pick(F.col("l_returnflag"), {"A": "High", "R": "Medium", "N": "Low"}).alias("severity"),
            F.when(F.col("l_linestatus") == "O", "Open").when(F.col("l_quantity") > 40, "Waived").otherwise("Resolved").alias("status"),
            day.alias("created"),
            F.when(F.col("l_linestatus") == "F", F.date_add(day, 5)).alias("resolved"),
            F.col("l_quantity").alias("quantity"),
            F.col("l_partkey").alias("document_id"),
        )

    @cached_property
    def cps(self) -> DataFrame:
        day = F.col("l_shipdate").cast("date")
        return self.raw("lineitem").where("l_quantity <= 25").select(
            F.col("l_orderkey").alias("case_id"),
            F.col("l_linenumber").alias("line"),
            pick(F.col("l_returnflag"), {"A": "High", "R": "Medium", "N": "Low"}).alias("severity"),
            F.when(F.col("l_linestatus") == "O", "Open").when(F.col("l_discount") < 0.05, "Satisfied").otherwise("Waived").alias("status"),
            day.alias("created"),
            F.when(F.col("l_tax") > 0.05, F.date_add(day, 3)).alias("satisfied"),
        )

    @cached_property
    def verifications(self) -> DataFrame:
        kind = F.col("l_suppkey") % 3
        return self.raw("lineitem").where("l_suppkey % 4 = 0").select(
            F.col("l_orderkey").alias("case_id"),
            F.col("l_linenumber").alias("line"),
            F.when(kind == 0, "registry").when(kind == 1, "e_stamp").otherwise("registry_rod").alias("verification_type"),
            F.when(F.col("l_linestatus") == "F", "Verified").when(F.col("l_tax") < 0.02, "Failed").otherwise("Pending").alias("status"),
            F.col("l_shipdate").cast("date").alias("verified"),
        )

    @cached_property
    def exports(self) -> DataFrame:
        return self.raw("lineitem").where("l_linenumber = 1").select(
            F.col("l_orderkey").alias("case_id"),
            F.when(F.col("l_returnflag") == "A", "bank_pack").otherwise("drafts").alias("export_type"),
            F.when(F.col("l_linestatus") == "F", "Done").otherwise("Pending").alias("status"),
            F.col("l_shipdate").cast("date").alias("created"),
        )

    @cached_property
    def users(self) -> DataFrame:
        return self.raw("customer").select(
            F.col("c_custkey").alias("user_id"), F.col("c_name").alias("full_name"), F.col("c_mktsegment").alias("role"), (F.col("c_nationkey") % 5).cast("int").alias("org_id"), F.col("c_acctbal").alias("balance")
        )

    @cached_property
    def approvals(self) -> DataFrame:
        kind = F.col("o_orderkey") % 4
        return self.raw("orders").where("o_orderkey % 7 = 0").select(
            F.col("o_orderkey").alias("approval_id"),
            F.col("o_orderkey").alias("case_id"),
            F.when(kind == 0, "exception_waive").when(kind == 1, "case_decision").when(kind == 2, "export_release").otherwise("cp_waive").alias("request_type"),
            F.when(F.col("o_orderstatus") == "F", "Approved").otherwise("Pending").alias("status"),
            F.col("o_orderdate").cast("date").alias("created"),
        )

    @cached_property
    def audit(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id"),
            F.col("ts"),
            F.col("ts").cast("date").alias("day"),
            F.col("user_id"),
            F.col("event_type").alias("action"),
            F.when(F.col("event_type").isin("purchase", "error"), "case").when(F.col("event_type") != "signup", "user").alias("entity_type"),
            (F.col("event_id") * 4).alias("entity_id"),
            F.col("value"),
            F.col("props"),
        )

    @cached_property
    def documents(self) -> DataFrame:
        return self.raw("documents").select("doc_id", "text", "lang", "source", "n_chars")

    @cached_property
    def lines(self) -> DataFrame:
        """Non-empty lines of documents, numbered from 0 within each."""
        return self.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))

    @cached_property
    def outbox(self) -> DataFrame:
        """Events as an outbox: attempts and next attempt (days) derived from the row."""
        return self.raw("events").select(
            F.col("event_id"),
            F.col("event_type"),
            F.col("ts"),
            (F.col("event_id") % 6).cast("int").alias("attempts"),
            F.when(F.col("event_id") % 3 != 0, F.date_add(F.col("ts").cast("date"), (F.col("event_id") % 20).cast("int"))).alias("next_attempt"),
            F.when(F.col("event_id") % 5 == 0, "Done").otherwise("Pending").alias("status"),
        )


_SEV = "CASE l_returnflag WHEN 'A' THEN 'High' WHEN 'R' THEN 'Medium' WHEN 'N' THEN 'Low' END"
VIEWS: dict[str, str] = {
    "cases": """SELECT o_orderkey AS case_id, o_orderpriority AS title,
        CASE o_orderstatus WHEN 'F' THEN 'Closed' WHEN 'O' THEN 'Processing' WHEN 'P' THEN 'Review' END AS status,
        CAST(o_orderdate AS DATE) AS created, CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 AS INTEGER) AS DATE) AS updated,
        CASE WHEN o_custkey % 5 <> 0 THEN o_custkey END AS assigned_to, CASE WHEN o_orderkey % 3 = 0 THEN 'Approved' END AS decision,
        CAST(o_custkey % 5 AS INTEGER) AS org_id, o_totalprice AS amount FROM orders""",
    "exceptions": f"""SELECT l_orderkey AS case_id, l_linenumber AS line, 'R-' || CAST(l_partkey % 40 AS VARCHAR) AS rule_id, {_SEV} AS severity,
        CASE WHEN l_linestatus = 'O' THEN 'Open' WHEN l_quantity > 40 THEN 'Waived' ELSE 'Resolved' END AS status,
        CAST(l_shipdate AS DATE) AS created, CASE WHEN l_linestatus = 'F' THEN CAST(l_shipdate AS DATE) + 5 END AS resolved,
        l_quantity AS quantity, l_partkey AS document_id FROM lineitem""",
    "cps": f"""SELECT l_orderkey AS case_id, l_linenumber AS line, {_SEV} AS severity,
        CASE WHEN l_linestatus = 'O' THEN 'Open' WHEN l_discount < 0.05 THEN 'Satisfied' ELSE 'Waived' END AS status,
        CAST(l_shipdate AS DATE) AS created, CASE WHEN l_tax > 0.05 THEN CAST(l_shipdate AS DATE) + 3 END AS satisfied
        FROM lineitem WHERE l_quantity <= 25""",
    "verifications": """SELECT l_orderkey AS case_id, l_linenumber AS line,
        CASE l_suppkey % 3 WHEN 0 THEN 'registry' WHEN 1 THEN 'e_stamp' ELSE 'registry_rod' END AS verification_type,
        CASE WHEN l_linestatus = 'F' THEN 'Verified' WHEN l_tax < 0.02 THEN 'Failed' ELSE 'Pending' END AS status,
        CAST(l_shipdate AS DATE) AS verified FROM lineitem WHERE l_suppkey % 4 = 0""",
    "exports": """SELECT l_orderkey AS case_id, CASE WHEN l_returnflag = 'A' THEN 'bank_pack' ELSE 'drafts' END AS export_type,
        CASE WHEN l_linestatus = 'F' THEN 'Done' ELSE 'Pending' END AS status, CAST(l_shipdate AS DATE) AS created FROM lineitem WHERE l_linenumber = 1""",
    "users": "SELECT c_custkey AS user_id, c_name AS full_name, c_mktsegment AS role, CAST(c_nationkey % 5 AS INTEGER) AS org_id, c_acctbal AS balance FROM customer",
    "approvals": """SELECT o_orderkey AS approval_id, o_orderkey AS case_id,
        CASE o_orderkey % 4 WHEN 0 THEN 'exception_waive' WHEN 1 THEN 'case_decision' WHEN 2 THEN 'export_release' ELSE 'cp_waive' END AS request_type,
        CASE WHEN o_orderstatus = 'F' THEN 'Approved' ELSE 'Pending' END AS status, CAST(o_orderdate AS DATE) AS created FROM orders WHERE o_orderkey % 7 = 0""",
    "audit": """SELECT event_id, ts, CAST(ts AS DATE) AS day, user_id, event_type AS action,
        CASE WHEN event_type IN ('purchase', 'error') THEN 'case' WHEN event_type <> 'signup' THEN 'user' END AS entity_type,
        event_id * 4 AS entity_id, value, props FROM events""",
    "lines": """SELECT doc_id, CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents""",
    "outbox": """SELECT event_id, event_type, ts, CAST(event_id % 6 AS INTEGER) AS attempts,
        CASE WHEN event_id % 3 <> 0 THEN CAST(CAST(ts AS DATE) + CAST(event_id % 20 AS INTEGER) AS DATE) END AS next_attempt,
        CASE WHEN event_id % 5 = 0 THEN 'Done' ELSE 'Pending' END AS status FROM events""",
}
