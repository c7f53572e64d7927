"""The action ledger: who did what to which resource, when (O-09).

Append-only and stateless: events are projected to ``(pid, action, rid,
datetime)`` and appended.  The streaming form reads new event files and
appends each micro-batch; the file sink's commit log makes the append
exactly-once across restarts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def actions(events: DataFrame) -> DataFrame:
    """``events(user_id, event_type, event_id, ts)`` as ledger rows."""
    return events.select(
        F.col("user_id").cast("string").alias("pid"),
        F.col("event_type").alias("action"),
        F.col("event_id").cast("string").alias("rid"),
        F.col("ts").alias("datetime"))


def start(spark: SparkSession, events_path: str, ledger_path: str, checkpoint: str,
          available_now: bool = True) -> StreamingQuery:
    """Stream new event files into the ledger table (Parquet append)."""
    schema = spark.read.parquet(events_path).schema
    src = spark.readStream.schema(schema).parquet(events_path)
    w = (actions(src).writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint).option("path", ledger_path))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
