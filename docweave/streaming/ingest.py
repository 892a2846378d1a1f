"""Incremental ingest of arriving page files."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader, StreamingQuery

from docweave.config import Settings
from docweave.functions import vectors as V
from docweave.plans.ingest import embedded_chunks, relevant_documents
from docweave.schemas import PAGES
from docweave.session import is_missing
from docweave.sources.pages import latest_pages
from docweave.sources.store import CorpusStore


def page_stream(
    spark: SparkSession, path: str, files_per_batch: int | None = None, name_filter: str | None = None
) -> DataFrame:
    reader: DataStreamReader = spark.readStream.schema(PAGES)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if name_filter is not None:
        reader = reader.option("pathGlobFilter", name_filter)
    return reader.parquet(path)


def ingest_stream(
    pages: DataFrame,
    store: CorpusStore,
    checkpoint: str,
    settings: Settings = Settings(),
    embed=V.token_hash,
) -> StreamingQuery:
    """Each micro-batch becomes one segment of the store, then the stream stops.

    A batch takes the store's next free segment and commits it under its own name, so other
    writers between two runs of the stream lose nothing, and a replayed batch that was committed
    is skipped. A document that arrives again replaces its former rows and chunks when the store
    is read. Within a batch the last page of a URL wins.
    """
    folder = checkpoint.rstrip("/")
    stream = _stream_name(store.spark, f"{folder}/name")

    def write(batch: DataFrame, batch_id: int) -> None:
        owner = f"{stream}:{batch_id}"
        if store.committed_by(owner):
            return
        documents = relevant_documents(latest_pages(batch), settings)
        store.write(documents, lambda stored: embedded_chunks(stored, settings, embed), owner=owner)

    return (
        pages.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start()
    )


def _stream_name(spark: SparkSession, marker: str) -> str:
    """This stream's name, given when it first starts."""
    try:
        kept = spark.read.schema("name string").json(marker).first()
    except AnalysisException as error:
        if not is_missing(error):
            raise
        kept = None
    if kept is not None:
        return kept["name"]
    name = uuid.uuid4().hex
    spark.range(1).select(F.lit(name).alias("name")).write.mode("overwrite").json(marker)
    return name
