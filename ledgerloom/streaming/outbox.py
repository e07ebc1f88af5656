"""Outbox events: retry state machine as batch plans and as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Seconds to wait after the n-th failed attempt.
WAITS = (60, 300, 900, 3600, 3600)
MAX_ATTEMPTS = 5


def backoff_seconds(attempts: Column) -> Column:
    """60 s before the first attempt's retry, then as WAITS says."""
    return F.element_at(F.array(*[F.lit(w) for w in WAITS]), F.greatest(F.lit(1), F.least(attempts, F.lit(len(WAITS)))).cast("int"))


def claimable(events: DataFrame, now: Column) -> DataFrame:
    return events.where((F.col("status") == "Pending") & (F.col("next_attempt").isNull() | (F.col("next_attempt") <= now)))


def after_attempt(events: DataFrame, failed: Column) -> DataFrame:
    """The claimed events after one attempt: Done, or Pending with a wait, or Failed after the last."""
    n = F.col("attempts") + 1
    status = F.when(~failed, "Done").when(n >= MAX_ATTEMPTS, "Failed").otherwise("Pending")
    return events.select("event_id", status.alias("status"), F.when(failed, n).otherwise(F.col("attempts")).alias("attempts"), F.when(failed & (n < MAX_ATTEMPTS), backoff_seconds(n)).alias("wait"))


def fan_out(events: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(event_id, endpoint_id) for every enabled endpoint that subscribes to the event's type; static side may be small."""
    return events.join(endpoints.where("enabled").select("endpoint_id", F.explode("subscribed").alias("event_type")), "event_type").select("event_id", "endpoint_id")


def stream(spark, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of an outbox folder as a stream; ts becomes a timestamp, as watermarks need one."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Tumbling daily counts by type; appended once the watermark has passed a day."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").cast("date").alias("day"), "event_type", "n")


def deduplicated(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event once, however often it is sent within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Bursts of a user's events, closed by a gap."""
    return events.withWatermark("ts", gap).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def retries(events: DataFrame) -> DataFrame:
    """Attempts per event as arbitrary state: (event_id, attempts, status) after each failed or successful delivery.

    events: (event_id, failed boolean).  The transition is next_state(), which tests run without a stream.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key, batches, state):
        attempts, status = state.get if state.exists else (0, "Pending")
        for pdf in batches:
            for failed in pdf["failed"]:
                attempts, status = next_state(attempts, status, bool(failed))
        state.update((attempts, status))
        yield pd.DataFrame([(key[0], attempts, status)], columns=["event_id", "attempts", "status"])

    return events.groupBy("event_id").applyInPandasWithState(run, "event_id long, attempts int, status string", "attempts int, status string", "update", GroupStateTimeout.NoTimeout)


def next_state(attempts: int, status: str, failed: bool) -> tuple[int, str]:
    if status != "Pending":
        return attempts, status
    if not failed:
        return attempts, "Done"
    return attempts + 1, "Failed" if attempts + 1 >= MAX_ATTEMPTS else "Pending"


ATTEMPT = "event_id long, attempt int, at timestamp, status string"


def attempts(events: DataFrame, fails: Column) -> DataFrame:
    """(event_id, attempt, at, status) of every delivery attempt of events (event_id, ts), of which the first `fails` fail: the batch form.

    An attempt that fails waits as WAITS says; the last one allowed ends the event as Failed.
    """
    waits = F.array(*[F.lit(w) for w in WAITS])
    tries = F.transform(F.sequence(F.lit(1), F.least(fails + 1, F.lit(MAX_ATTEMPTS))), lambda k: F.struct(k.alias("attempt"), F.aggregate(F.slice(waits, F.lit(1), k - 1), F.lit(0), lambda a, w: a + w).alias("wait")))
    x = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), fails.alias("fails"), F.explode(tries).alias("t"))
    status = F.when(F.col("t.attempt") > F.col("fails"), "Done").when(F.col("t.attempt") >= MAX_ATTEMPTS, "Failed").otherwise("Pending")
    return x.select("event_id", "t.attempt", F.timestamp_micros(F.unix_micros("ts") + F.col("t.wait").cast("long") * 1_000_000).alias("at"), status.alias("status"))


@contextmanager
def rocksdb(spark) -> Iterator[None]:
    """State that outgrows memory: RocksDB on the executors, its changes in the query's checkpoint.  Timers need it."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


#: Groups of events that share one state and one timer: calls between JVM and Python are for groups, not for events. A checkpoint keeps its number.
BUCKETS = 4096


def delivered(deliver: Callable[[int, int, int], bool]) -> type:
    """A stateful processor of buckets of events, that attempts an event when it comes and again whenever it is due.

    deliver(event_id, fails, attempt) says whether the attempt succeeds.  The
    state of a bucket is its pending events with their attempts so far; an event
    goes with its last attempt.  The bucket's timer is its earliest retry.  A
    retry that is overdue when it is set (the watermark has passed it) is made
    at once, at the time it was due.  Of an event that is sent twice, the second
    is ignored while the first is pending.
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class Delivery(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.state = handle.getValueState("pending", "timer long, events binary")

        def load(self) -> tuple[int | None, dict[int, tuple[int, int, int]]]:
            """The timer, and (fails, attempts so far, due) of the pending events."""
            held = self.state.get()
            if held is None:
                return None, {}
            return held[0], {e: (fails, done, due) for e, fails, done, due in np.frombuffer(held[1], np.int64).reshape(-1, 4).tolist()}

        def save(self, pending: dict[int, tuple[int, int, int]], timer: int | None) -> None:
            """timer: the one that is still set."""
            first = min(due for _, _, due in pending.values()) if pending else None
            if first != timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                if first is not None:
                    self.handle.registerTimer(first)
            if pending:
                self.state.update((first, np.array([(e, *p) for e, p in pending.items()], np.int64).tobytes()))
            else:
                self.state.clear()

        def attempt(self, made: list[tuple], pending: dict, key: int, fails: int, done: int, at: int, watermark: int) -> None:
            while True:
                done, ok = done + 1, deliver(key, fails, done + 1)
                status = "Done" if ok else "Failed" if done >= MAX_ATTEMPTS else "Pending"
                made.append((key, done, at, status))
                if status != "Pending":
                    pending.pop(key, None)
                    return
                at += 1000 * WAITS[done - 1]
                if at > watermark:
                    pending[key] = (fails, done, at)
                    return

        def rows(self, made: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(made, columns=["event_id", "attempt", "ms", "status"])

        def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803  the interface's names
            timer, pending = self.load()
            watermark, fresh = timerValues.getCurrentWatermarkInMs(), False
            for frame in rows:
                made: list[tuple] = []
                for event, fails, ms in zip(frame["event_id"].tolist(), frame["fails"].tolist(), frame["ms"].tolist()):
                    if event not in pending:
                        self.attempt(made, pending, event, fails, 0, ms, watermark)
                fresh = fresh or bool(made)
                yield self.rows(made)
            if fresh and (pending or timer is not None):
                self.save(pending, timer)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
            _, pending = self.load()
            watermark, made = timerValues.getCurrentWatermarkInMs(), []
            for event, (fails, done, due) in list(pending.items()):
                if due <= watermark:
                    self.attempt(made, pending, event, fails, done, due, watermark)
            self.save(pending, None)  # the expired timer goes by itself
            yield self.rows(made)

        def close(self) -> None:
            pass

    return Delivery


def timed_retries(events: DataFrame, deliver: Callable[[int, int, int], bool], late: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """(event_id, attempt, at, status) of every attempt of a stream of events (event_id, ts, fails), in event time.

    Run it under rocksdb(); it continues from its checkpoint, timers included.
    """
    keyed = events.withWatermark("ts", late).select("event_id", "fails", F.unix_millis("ts").alias("ms"), "ts", F.pmod(F.xxhash64("event_id"), F.lit(buckets)).alias("bucket")).groupBy("bucket")
    made = keyed.transformWithStateInPandas(delivered(deliver)(), "event_id long, attempt int, ms long, status string", "Append", "EventTime")
    return made.select("event_id", "attempt", F.timestamp_millis("ms").alias("at"), "status")


def claim_into(path: str, now: Column) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: writes a batch's claimable events to its own part of path, and only those no earlier batch has claimed.

    The batch id is the key: a batch that runs again, after a failure or a
    restart, overwrites its own part and sees earlier parts only, so it claims
    the same events again and none twice.
    """

    def claim(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        due = claimable(batch, now).dropDuplicates(["event_id"])
        home = spark._jvm.org.apache.hadoop.fs.Path(path)
        if batch_id > 0 and home.getFileSystem(spark._jsc.hadoopConfiguration()).exists(home):
            taken = spark.read.schema(StructType([due.schema["event_id"], StructField("batch", LongType())])).parquet(path)
            due = due.join(taken.where(F.col("batch") < batch_id).select("event_id"), "event_id", "left_anti")
        due.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return claim
