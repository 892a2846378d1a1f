"""Rolling counts over the log of operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docweave.schemas import RUN_LOG
from docweave.sources.runlog import rollup


def log_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """``(ts, operation, status)`` of arriving log lines."""
    reader = spark.readStream.schema(RUN_LOG)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path).select(
        F.to_timestamp("timestamp").alias("ts"),
        F.col("payload.operation").alias("operation"),
        F.col("payload.status").alias("status"),
    )


def rolling_counts(
    entries: DataFrame, width: str = "1 hour", lateness: str = "10 minutes", keys: tuple[str, ...] = ("operation", "status")
) -> DataFrame:
    """Counts per window and key; rows later than ``lateness`` are dropped."""
    return rollup(entries.withWatermark("ts", lateness), "ts", width, list(keys))


def write_counts(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Closed windows appended as Parquet."""
    return (
        counts.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
