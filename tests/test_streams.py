"""Streams with timers and claims: run to the end, restarted, repeated."""

import datetime as dt
import shutil

from pyspark.sql import functions as F

from ledgerloom.streaming import outbox as O

T0 = dt.datetime(2024, 1, 1, 12)
EVENTS = [(i, T0 + dt.timedelta(minutes=7 * i), i % 7) for i in range(40)]
LATER = [(-1, T0 + dt.timedelta(days=40), 0)]
SCHEMA = "event_id long, ts timestamp, fails int"


def feed(spark, home, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{home}/in")


def run(spark, home):
    with O.rocksdb(spark):
        made = O.timed_retries(spark.readStream.schema(SCHEMA).parquet(f"{home}/in"), lambda event, fails, attempt: attempt > fails)
        made.writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return sorted((r.event_id, r.attempt, str(r.at), r.status) for r in spark.read.schema(O.ATTEMPT).parquet(f"{home}/out").where("event_id >= 0").collect())


def test_timed_retries_equal_batch_after_restarts(spark, tmp_path):
    home = str(tmp_path)
    feed(spark, home, EVENTS[:20])
    part = run(spark, home)
    assert 0 < len(part) and max(r[0] for r in part) == 19
    feed(spark, home, EVENTS[20:] + [EVENTS[39]])  # sent twice
    more = run(spark, home)
    assert set(part) < set(more)  # nothing is made again
    feed(spark, home, LATER)
    got = run(spark, home)
    want = O.attempts(spark.createDataFrame(EVENTS, SCHEMA), F.col("fails"))
    assert got == sorted((r.event_id, r.attempt, str(r.at), r.status) for r in want.collect())
    by = {e: [r[3] for r in got if r[0] == e] for e, _, _ in EVENTS}
    assert all(by[e] == ["Pending"] * min(f, 4) + (["Failed"] if f >= 5 else ["Done"]) for e, _, f in EVENTS)


def test_timed_retries_keep_one_state_and_timer_for_a_bucket(spark, tmp_path):
    rows = [(i, T0 + dt.timedelta(seconds=11 * i), i % 7) for i in range(600)]
    feed(spark, tmp_path, rows)
    with O.rocksdb(spark):
        made = O.timed_retries(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), lambda event, fails, attempt: attempt > fails, buckets=3)
        q = made.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    assert max(s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]) <= 12  # a state, and its timer by key and by time
    feed(spark, tmp_path, LATER)
    with O.rocksdb(spark):
        made = O.timed_retries(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), lambda event, fails, attempt: attempt > fails, buckets=3)
        made.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.event_id, r.attempt, str(r.at), r.status) for r in spark.read.schema(O.ATTEMPT).parquet(f"{tmp_path}/out").where("event_id >= 0").collect())
    want = O.attempts(spark.createDataFrame(rows, SCHEMA), F.col("fails"))
    assert got == sorted((r.event_id, r.attempt, str(r.at), r.status) for r in want.collect())


OUTBOX = "event_id long, status string, next_attempt date"
now = lambda: F.lit(dt.date(2024, 1, 20))


def batch(spark, ids, **other):
    return spark.createDataFrame([(i, "Done" if i % 5 == 0 else "Pending", dt.date(2024, 2, 1) if i % 7 == 0 else None) for i in ids], OUTBOX)


def claimed(spark, path):
    return sorted((r.batch, r.event_id) for r in spark.read.parquet(path).select("batch", "event_id").collect())


def test_a_repeated_batch_claims_nothing_twice(spark, tmp_path):
    path = str(tmp_path / "claims")
    claim = O.claim_into(path, now())
    due = lambda ids: [i for i in ids if i % 5 and i % 7]
    claim(batch(spark, range(20)), 0)
    claim(batch(spark, range(10, 30)), 1)  # ten come again
    want = [(0, i) for i in due(range(20))] + [(1, i) for i in due(range(20, 30))]
    assert claimed(spark, path) == want
    claim(batch(spark, range(10, 30)), 1)
    assert claimed(spark, path) == want
    claim(batch(spark, [31, 31, 31]), 2)
    assert claimed(spark, path) == [*want, (2, 31)]


def test_a_batch_whose_commit_is_lost(spark, tmp_path):
    home = str(tmp_path)
    for ids in (range(20), range(15, 40)):
        batch(spark, ids).coalesce(1).write.mode("append").parquet(f"{home}/in")

    def go():
        source = spark.readStream.schema(OUTBOX).option("maxFilesPerTrigger", 1).parquet(f"{home}/in")
        source.writeStream.foreachBatch(O.claim_into(f"{home}/claims", now())).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start().awaitTermination()
        return claimed(spark, f"{home}/claims")

    first = go()
    assert [i for _, i in first] == sorted({i for i in range(40) if i % 5 and i % 7}) and {b for b, _ in first} == {0, 1}
    shutil.move(f"{home}/state/commits/1", f"{home}/lost")  # as if the driver had died after the claims were written
    for crc in (tmp_path / "state" / "commits").glob(".1*"):
        shutil.move(str(crc), f"{home}/lost.crc")
    assert go() == first
