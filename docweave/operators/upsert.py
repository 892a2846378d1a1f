"""Last write wins by document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert_documents(stored: DataFrame, incoming: DataFrame, key: str = "doc_id") -> DataFrame:
    """Stored rows whose key is not incoming, and all incoming rows (unique by key)."""
    return stored.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)


def latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The row with the greatest version per key; copies are combined before the shuffle."""
    packed = F.max_by(F.struct(*rows.columns), version)
    return rows.groupBy(F.col(key).alias("_key")).agg(packed.alias("_row")).select("_row.*")


def replace_chunks(stored: DataFrame, incoming: DataFrame, documents: DataFrame) -> DataFrame:
    """Drops every stored chunk of the documents re-ingested, then adds the incoming ones."""
    keys = documents.select(F.col("doc_id").alias("document_id")).distinct()
    return stored.join(keys, "document_id", "left_anti").unionByName(incoming)
