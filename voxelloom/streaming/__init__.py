"""Structured Streaming: tailing audit logs and resumable ingestion.

These are extensions; the batch operators do not depend on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIT_SCHEMA = (
    "schema string, sequence long, timestamp_utc timestamp, level string, event_type string, execution_id string, "
    "run_id string, operation string, status string, percent double, message string"
)


def tail_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Audit events as they are appended to JSONL files."""
    return spark.readStream.schema(AUDIT_SCHEMA).json(folder)


def progress(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Events and highest percent by window and operation, late ones dropped."""
    timed = events.withWatermark("timestamp_utc", late)
    return timed.groupBy(F.window("timestamp_utc", window), "operation").agg(F.count(F.lit(1)).alias("events"), F.max("percent").alias("percent"))


def resumable_ingest(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str, files_per_batch: int = 64):
    """Copies new Parquet files once each; a restart goes on where it ended."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    return query.trigger(availableNow=True).start()
