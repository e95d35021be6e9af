"""The sign-in throttle in batch and as a stream, and the audit stream."""

import datetime as dt
import random

from sharescope.streaming.audit_log import append_audit_stream
from sharescope.streaming.throttle import Gate, throttle_batch, throttle_stream
from tests.fixtures import frame

DDL = "attempt_id bigint, username string, at timestamp_ntz, ok boolean"
START = dt.datetime(2024, 1, 1, 8)


def attempts(*rows):
    return [(i, user, START + dt.timedelta(minutes=m), ok) for i, (user, m, ok) in enumerate(rows)]


ROWS = attempts(("a", 0, False), ("a", 1, False), ("a", 2, False), ("a", 3, True), ("b", 4, True), ("a", 29, False), ("a", 31, True), ("a", 32, False),
                ("b", 33, False), ("b", 34, False), ("b", 35, True), ("b", 36, False), ("b", 37, False), ("b", 38, False), ("b", 39, False))
EXPECTED = {0: "failed", 1: "failed", 2: "failed", 3: "throttled", 4: "signed_in", 5: "throttled", 6: "signed_in", 7: "failed", 8: "failed", 9: "failed",
            10: "signed_in", 11: "failed", 12: "failed", 13: "failed", 14: "throttled"}


def test_batch(spark):
    got = {r.attempt_id: r for r in throttle_batch(frame(spark, ROWS, DDL)).collect()}
    assert {i: r.outcome for i, r in got.items()} == EXPECTED
    assert got[3].retry_seconds == 27 * 60 and got[0].retry_seconds is None


def test_batch_equals_one_pass_per_account(spark):
    rng = random.Random(7)
    rows, minute = [], {u: 0.0 for u in "xyz"}
    for i in range(600):
        user = rng.choices("xyz", [8, 1, 1])[0]
        minute[user] += rng.choice([0.1, 1, 5, 12, 29.99, 30, 45])
        rows.append((i, user, START + dt.timedelta(minutes=minute[user]), rng.random() < 0.2))
    got = {r.attempt_id: r.outcome for r in throttle_batch(frame(spark, rows, DDL)).collect()}
    gates, expected = {u: Gate() for u in "xyz"}, {}
    for i, user, at, ok in rows:
        expected[i] = gates[user].attempt(at, ok)[0]
    assert got == expected


def test_stream_in_two_steps(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))

    def step(rows):
        frame(spark, rows, DDL).withColumnRenamed("at", "t").selectExpr("attempt_id", "username", "CAST(t AS TIMESTAMP) AS at", "ok").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("attempt_id bigint, username string, at timestamp, ok boolean").parquet(source)
        query = throttle_stream(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
        query.awaitTermination(90)
        assert query.exception() is None

    step(ROWS[:3])
    step(ROWS[3:])
    got = {r.attempt_id: r.outcome for r in spark.read.parquet(out).collect()}
    assert got == EXPECTED


def test_audit_stream_partitions_by_day(spark, tmp_path):
    ddl = "event_id bigint, at timestamp_ntz, username string, action string"
    frame(spark, [(1, START, "a", "view"), (2, START + dt.timedelta(days=1), "b", "search")], ddl).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ddl).parquet(str(tmp_path / "in"))
    append_audit_stream(stream, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).filter("day = DATE '2024-01-02'").first().event_id == 2
