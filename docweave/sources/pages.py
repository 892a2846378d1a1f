"""Page tables and seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import urls as U
from docweave.operators.upsert import latest
from docweave.schemas import PAGES
from docweave.session import bounded, spread


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A page table, with the columns on how it was fetched where it has them.

    Parsing is the costly part, so a small one is spread over the cores.
    """
    found = spark.read.parquet(path)
    fetched = [c for c in ("crawl_ts", "response_time", "error_message") if c in found.columns]
    return spread(found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in PAGES.fields], *fetched))


def fetch_log(pages: DataFrame) -> DataFrame:
    """``(url, status, error_message, response_time, content_length)`` of each page row.

    A page without HTML is a failed fetch. ``error_message`` and ``response_time`` are taken
    from the table when it has them.
    """
    has = F.coalesce(F.length("html"), F.lit(0)) > 0

    def optional(name: str, kind: str):
        return (F.col(name) if name in pages.columns else F.lit(None)).cast(kind)

    return pages.select(
        "url",
        F.when(has, "success").otherwise("failed").alias("status"),
        F.when(~has, F.coalesce(optional("error_message", "string"), F.lit("no content"))).alias("error_message"),
        optional("response_time", "double").alias("response_time"),
        F.when(has, F.length("html")).alias("content_length"),
    )


def split_seeds(urls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """http(s) seeds, and the rejected rest."""
    web = F.coalesce(F.col("url").startswith("http://") | F.col("url").startswith("https://"), F.lit(False))
    return urls.where(web), urls.where(~web)


def latest_pages(pages: DataFrame) -> DataFrame:
    """One row per URL, the one with the greatest ``page_id``.

    Only URLs that occur more than once are aggregated, and their copies are combined before
    the shuffle; the HTML of all other pages stays where it is.
    """
    repeated = pages.groupBy("url").count().where(F.col("count") > 1).select("url")
    repeated = bounded(repeated)
    single = pages.join(repeated, "url", "left_anti").select(*pages.columns)
    copies = pages.join(repeated, "url", "left_semi").select(*pages.columns)
    return single.unionByName(latest(copies, "url", "page_id"))


def write_raw_pages(pages: DataFrame, path: str) -> None:
    """Raw HTML by id, so URLs that differ only in the query do not overwrite each other.

    The host is a column, not a folder: the number of hosts grows with the data. Nothing is
    shuffled.
    """
    pages.select(
        U.document_id(F.col("url")).alias("doc_id"),
        U.host(F.col("url")).alias("host"),
        U.file_name(F.col("url")).alias("file_name"),
        "url",
        "html",
    ).write.mode("overwrite").parquet(path)
