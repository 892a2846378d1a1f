"""The log of operations: JSON lines of ``{timestamp, source_ip, payload}``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.schemas import RUN_LOG


def append_log(entries: DataFrame, path: str) -> None:
    """Appends ``(timestamp, source_ip, payload)`` rows."""
    entries.select("timestamp", "source_ip", "payload").write.mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_LOG).json(path)


def metric_rows(metrics: DataFrame, keys: list[str], column: str = "metrics") -> DataFrame:
    """``(keys, name, value)`` of a string map; a list of errors is shown as its size."""
    exploded = metrics.select(*keys, F.explode(column).alias("name", "_value"))
    errors = F.from_json("_value", T.ArrayType(T.StringType()))
    return exploded.select(
        *keys,
        "name",
        F.when((F.col("name") == "errors") & errors.isNotNull(), F.size(errors).cast("string"))
        .otherwise(F.col("_value"))
        .alias("value"),
    )


def scan_log(log: DataFrame) -> DataFrame:
    """``(timestamp, operation, status, name, value)``: what each operation reports.

    An ingestion reports its metrics. A batch of questions reports its summary and the number
    of results.
    """
    entries = log.select(
        "timestamp",
        F.coalesce("payload.operation", F.lit("unknown")).alias("operation"),
        F.coalesce("payload.status", F.lit("unknown")).alias("status"),
        F.col("payload.metrics").alias("metrics"),
    )
    keys = ["timestamp", "operation", "status"]
    ingests = metric_rows(entries.where(F.col("operation") == "ingestion"), keys)
    batches = entries.where(F.col("operation") == "batch_query")
    summary = metric_rows(
        batches.withColumn(
            "metrics", F.from_json(F.col("metrics")["summary"], T.MapType(T.StringType(), T.StringType()))
        ),
        keys,
    )
    results = batches.select(
        *keys,
        F.lit("results_returned").alias("name"),
        F.size(F.from_json(F.col("metrics")["results"], T.ArrayType(T.StringType()))).cast("string").alias("value"),
    ).where(F.col("value") >= "0")
    return ingests.unionByName(summary).unionByName(results)


def rollup(events: DataFrame, ts: str, width: str, keys: list[str]) -> DataFrame:
    """Counts per tumbling window and key, batch or streaming."""
    return (
        events.groupBy(F.window(ts, width).alias("_window"), *keys)
        .agg(F.count("*").alias("n"))
        .select(F.col("_window.start").alias("window_start"), *keys, "n")
    )
