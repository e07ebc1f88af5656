"""Queries of events (K): the batch forms; ledgerloom.streaming has the same plans over streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import AS_OF_EVENTS, Tables
from ..operators import kpis as K
from ..registry import query
from ..session import shared_folder
from ..streaming import outbox as O

_NOW = "DATE '2024-01-20'"


def now():
    return F.lit(dt.date(2024, 1, 20))


@query("K01_emit", "SELECT event_id + 1000000 AS event_id, event_type, 'Pending' AS status, 0 AS attempts FROM outbox WHERE event_type = 'signup'")
def emit(t: Tables) -> DataFrame:
    return t.outbox.where("event_type = 'signup'").select((F.col("event_id") + 1000000).alias("event_id"), "event_type", F.lit("Pending").alias("status"), F.lit(0).alias("attempts"))


@query("K02_claim", f"SELECT event_id FROM outbox WHERE status = 'Pending' AND (next_attempt IS NULL OR next_attempt <= {_NOW}) ORDER BY event_id LIMIT 50")
def claim(t: Tables) -> DataFrame:
    return O.claimable(t.outbox, now()).orderBy("event_id").limit(50).select("event_id")


_FAILED = "(event_id % 4 = 0)"


@query("K03_retry", f"WITH c AS (SELECT *, {_FAILED} AS failed FROM outbox WHERE status = 'Pending' AND (next_attempt IS NULL OR next_attempt <= {_NOW})) SELECT event_id, CASE WHEN NOT failed THEN 'Done' WHEN attempts + 1 >= 5 THEN 'Failed' ELSE 'Pending' END AS status, CASE WHEN failed THEN attempts + 1 ELSE attempts END AS attempts, CASE WHEN failed AND attempts + 1 < 5 THEN CASE attempts + 1 WHEN 1 THEN 60 WHEN 2 THEN 300 WHEN 3 THEN 900 ELSE 3600 END END AS wait FROM c")
def retry(t: Tables) -> DataFrame:
    return O.after_attempt(O.claimable(t.outbox, now()), F.col("event_id") % 4 == 0)


@query("K02b_claim_stream", f"SELECT event_id FROM outbox WHERE status = 'Pending' AND (next_attempt IS NULL OR next_attempt <= {_NOW})")
def claim_stream(t: Tables) -> DataFrame:
    """The outbox as a stream of files, claimed batch by batch: what all batches have claimed."""
    home = shared_folder(t.spark, "claims")
    t.outbox.repartition(3).write.parquet(f"{home}/in")
    source = t.spark.readStream.schema(t.outbox.schema).option("maxFilesPerTrigger", 1).parquet(f"{home}/in")
    run = source.writeStream.foreachBatch(O.claim_into(f"{home}/claims", now())).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return t.spark.read.schema(t.outbox.schema).parquet(f"{home}/claims").select("event_id")


_FAILS = "CAST(event_id % 7 AS INTEGER)"


@query("K03b_timed_retries", f"SELECT event_id, CAST(k AS INTEGER) AS attempt, strftime(ts + to_seconds(([0, 60, 360, 1260, 4860])[k]), '%Y-%m-%d %H:%M:%S') AS at, CASE WHEN k > {_FAILS} THEN 'Done' WHEN k = 5 THEN 'Failed' ELSE 'Pending' END AS status FROM events, LATERAL (SELECT unnest(range(1, least({_FAILS} + 1, 5) + 1)) AS k)")
def timed_retries(t: Tables) -> DataFrame:
    """Every delivery attempt of the events as a stream in three runs from one checkpoint, timers and all; the first event_id % 7 attempts fail.

    The last run has one event of the far future, which brings the watermark past every timer.
    """
    home = shared_folder(t.spark, "retries")
    events = t.raw("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 7).cast("int").alias("fails"))
    middle = events.agg(F.timestamp_micros(F.percentile_approx(F.unix_micros("ts"), 0.5)).alias("m"), (F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("late")).first()
    parts = [events.where(F.col("ts") < F.lit(middle.m)), events.where(F.col("ts") >= F.lit(middle.m)), t.spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit(middle.late).alias("ts"), F.lit(0).alias("fails"))]
    with O.rocksdb(t.spark):
        for part in parts:
            part.write.mode("append").parquet(f"{home}/in")
            source = t.spark.readStream.schema(events.schema).parquet(f"{home}/in")
            made = O.timed_retries(source, lambda event, fails, attempt: attempt > fails)
            run = made.writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/state").outputMode("append").trigger(availableNow=True).start()
            run.awaitTermination()
    out = t.spark.read.schema(O.ATTEMPT).parquet(f"{home}/out").where("event_id >= 0")
    return out.select("event_id", "attempt", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), "status")


@query("K04_fan_out", "SELECT event_id, e AS endpoint_id FROM outbox JOIN (VALUES (1, 'click'), (1, 'error'), (2, 'signup')) x(e, s) ON event_type = s")
def fan_out(t: Tables) -> DataFrame:
    ends = t.spark.createDataFrame([(1, True, ["click", "error"]), (2, True, ["signup"]), (3, False, ["view"])], "endpoint_id int, enabled boolean, subscribed array<string>")
    return O.fan_out(t.outbox, ends)


@query("K05_due_schedules", "SELECT n_nationkey AS schedule_id FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey NOT IN (SELECT user_id % 25 FROM audit WHERE day = DATE '2024-01-30' AND action = 'signup')")
def due_schedules(t: Tables) -> DataFrame:
    ran = t.audit.where((F.col("day") == F.lit(AS_OF_EVENTS)) & (F.col("action") == "signup")).select((F.col("user_id") % 25).alias("schedule_id"))
    return t.raw("nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("schedule_id")).join(ran, "schedule_id", "left_anti")


@query("K06_retention", "SELECT case_id, status = 'Closed' AS by_service FROM cases WHERE created < DATE '1996-01-01'")
def retention(t: Tables) -> DataFrame:
    """The service takes closed cases only, the admin run all old ones."""
    return t.cases.where(F.col("created") < F.lit(dt.date(1996, 1, 1))).select("case_id", (F.col("status") == "Closed").alias("by_service"))


@query("K07_document_state", "SELECT doc_id, CASE WHEN count(CASE WHEN length(line) % 11 = 0 THEN 1 END) = count(*) THEN 'Failed' WHEN count(CASE WHEN length(line) % 11 = 0 THEN 1 END) > 0 THEN 'NeedsReview' ELSE 'Complete' END AS status FROM lines GROUP BY doc_id")
def document_state(t: Tables) -> DataFrame:
    x = t.lines.groupBy("doc_id").agg(K.n(F.length("line") % 11 == 0, "failed"), F.count("*").alias("pages"))
    return x.select("doc_id", F.when(F.col("failed") == F.col("pages"), "Failed").when(F.col("failed") > 0, "NeedsReview").otherwise("Complete").alias("status"))


@query("K08_activity", "SELECT event_id, action FROM audit ORDER BY ts DESC, event_id DESC LIMIT 50")
def activity(t: Tables) -> DataFrame:
    return t.audit.orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "action")


@query("K09_idempotent", "SELECT DISTINCT user_id, action, day, count(*) OVER (PARTITION BY user_id, action, day) > 1 AS repeated FROM (SELECT user_id, action, CAST(day AS VARCHAR) AS day FROM audit)")
def idempotent(t: Tables) -> DataFrame:
    return t.audit.groupBy("user_id", "action", F.col("day").cast("string").alias("day")).agg((F.count("*") > 1).alias("repeated"))


@query("K10_daily_tumbling", "SELECT CAST(day AS VARCHAR) AS day, action AS event_type, count(*) AS n FROM audit GROUP BY 1, 2")
def daily_tumbling(t: Tables) -> DataFrame:
    return O.daily_counts(t.raw("events").withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("day", F.col("day").cast("string"))


@query("K11_sliding_and_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM audit) SELECT user_id, CAST(sum(fresh) AS BIGINT) AS sessions, count(*) AS n_events FROM g GROUP BY user_id")
def sliding_and_sessions(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(w)
    g = t.audit.withColumn("fresh", F.when(gap <= 6 * 3600 * 1_000_000, 0).otherwise(1))
    return g.groupBy("user_id").agg(F.sum("fresh").alias("sessions"), F.count("*").alias("n_events"))


@query("K11b_sliding_window", "SELECT CAST(CAST(day AS DATE) - k AS VARCHAR) AS first_day, action, count(*) AS n FROM audit, (VALUES (0), (1), (2)) x(k) GROUP BY 1, 2")
def sliding_window(t: Tables) -> DataFrame:
    """Counts over the three days from each day on: windows of three days that start daily."""
    w = F.window(F.col("ts").cast("timestamp"), "3 days", "1 day")
    return t.audit.groupBy(w.alias("w"), "action").agg(F.count("*").alias("n")).select(F.col("w.start").cast("date").cast("string").alias("first_day"), "action", "n")
