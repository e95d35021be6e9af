"""The audit log as a stream: append events, partitioned by day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_audit_stream(events: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Exactly-once append of a stream of audit events to Parquet; the checkpoint must be on shared storage."""
    return (events.withColumn("day", F.to_date("at")).writeStream.outputMode("append").format("parquet")
            .option("path", target).option("checkpointLocation", checkpoint).partitionBy("day")
            .trigger(availableNow=True).start())
