"""Sign-in throttling: three failures within thirty minutes close an account until the first one ages out.

Attempts made while blocked are refused and add nothing; a success clears the account. The state
is at most three instants per account, in the stream and in the batch twin alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..schema import LOGIN_MAX_FAILURES, LOGIN_WINDOW_MINUTES

OUTPUT = "attempt_id bigint, username string, at timestamp_ntz, outcome string, retry_seconds bigint"


class Gate:
    """Decides one account's attempts in time order."""

    def __init__(self, failures: list | None = None, limit: int = LOGIN_MAX_FAILURES,
                 window: timedelta = timedelta(minutes=LOGIN_WINDOW_MINUTES)):
        self.failures, self.limit, self.window = list(failures or []), limit, window

    def attempt(self, at, ok: bool) -> tuple[str, int | None]:
        self.failures = [t for t in self.failures if at - t < self.window]
        if 0 < self.limit <= len(self.failures):
            return "throttled", int((self.failures[0] + self.window - at).total_seconds())
        if ok:
            self.failures = []
            return "signed_in", None
        self.failures.append(at)
        return "failed", None


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["attempt_id", "username", "at", "outcome", "retry_seconds"])
    return out.astype({"retry_seconds": "Int64"})


def activity_segments(attempts: DataFrame, minutes: int = LOGIN_WINDOW_MINUTES) -> DataFrame:
    """Attempts with a `segment` per account that starts after a pause as long as the window.

    Nothing is remembered across such a pause, so segments are independent. They are found on
    (account, half-hour slot) aggregates, a bounded number per account and day, so an account with
    most of the attempts is reduced before the window function sees it.
    """
    seconds = minutes * 60
    slot = F.floor(F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("at")) / seconds)
    slotted = attempts.withColumn("slot", slot)
    ends = slotted.groupBy("username", "slot").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    order = Window.partitionBy("username").orderBy("slot")
    # The latest of all earlier instants: slots are ordered, so it is the previous slot's.
    pause = F.timestamp_diff("MICROSECOND", F.lag("last_at").over(order), F.col("first_at"))
    starts = ends.withColumn("new", F.coalesce((pause >= seconds * 1_000_000).cast("int"), F.lit(1)))
    numbered = starts.select("username", "slot", F.sum("new").over(order).alias("segment"))
    return slotted.join(numbered, ["username", "slot"]).drop("slot")


def throttle_batch(attempts: DataFrame, limit: int = LOGIN_MAX_FAILURES, minutes: int = LOGIN_WINDOW_MINUTES) -> DataFrame:
    """Outcome of every recorded attempt (attempt_id, username, at, ok).

    Whole segments share a partition, sorted by time, and each partition is one pass over Arrow
    batches: memory holds one batch and three instants however long a segment is.
    """
    window = timedelta(minutes=minutes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, gate = None, None
        for pdf in batches:
            rows = []
            for i, name, segment, at, ok in zip(*(pdf[c] for c in ("attempt_id", "username", "segment", "at", "ok"))):
                if (name, segment) != current:
                    current, gate = (name, segment), Gate(limit=limit, window=window)
                rows.append((i, name, at, *gate.attempt(at, ok)))
            yield _frame(rows)

    ordered = (activity_segments(attempts, minutes).select("attempt_id", "username", "segment", "at", "ok")
               .repartition("username", "segment").sortWithinPartitions("username", "segment", "at", "attempt_id"))
    return ordered.mapInPandas(run, OUTPUT)


class ThrottleProcessor(StatefulProcessor):
    """The same decision on a stream; an idle account's state is dropped by a timer."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.failures = handle.getValueState("failures", "times array<timestamp>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = self.failures.get() if self.failures.exists() else None
        gate = Gate([pd.Timestamp(t).tz_localize(None) for t in (kept[0] if kept else [])])
        pdf = pd.concat(list(rows)).sort_values(["at", "attempt_id"])
        yield _frame([(i, key[0], at, *gate.attempt(at, ok))
                      for i, at, ok in zip(pdf["attempt_id"], pdf["at"], pdf["ok"])])
        if gate.failures:
            self.failures.update((gate.failures,))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            expiry = int((gate.failures[-1] + gate.window - pd.Timestamp(0)).total_seconds() * 1000)
            self.handle.registerTimer(max(expiry, timerValues.getCurrentWatermarkInMs() + 1))
        else:
            self.failures.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.failures.clear()
        return iter([])

    def close(self) -> None:
        pass


def throttle_stream(attempts: DataFrame, minutes: int = LOGIN_WINDOW_MINUTES) -> DataFrame:
    """A streaming DataFrame of attempts with their outcome, in arrival order of micro-batches."""
    return (attempts.withWatermark("at", f"{minutes} minutes").groupBy("username")
            .transformWithStateInPandas(ThrottleProcessor(), OUTPUT.replace("timestamp_ntz", "timestamp"),
                                        outputMode="Append", timeMode="EventTime"))
