"""Crawl, ingestion, embedding and index figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.config import CrawlSettings, Settings
from docweave.functions.text import count_terms, word_count
from docweave.functions.vectors import is_valid, norm


def crawl_metrics(fetch_log: DataFrame) -> DataFrame:
    """One row of counts, rates and totals over ``(url, status, error_message, response_time, content_length)``.

    The error texts themselves are a table (:func:`crawl_errors`), as they grow with the log.
    """
    ok = F.col("status") == "success"
    return fetch_log.agg(
        F.count_if(ok).alias("pages_scraped"),
        F.count_if(F.col("status") == "failed").alias("pages_failed"),
        F.count("*").alias("total_pages_attempted"),
        F.coalesce(F.avg(ok.cast("double")), F.lit(0.0)).alias("success_rate"),
        F.coalesce(F.avg(F.when(ok, F.col("response_time"))), F.lit(0.0)).alias("average_response_time"),
        F.coalesce(F.sum(F.when(ok, F.col("content_length"))), F.lit(0)).alias("total_content_length"),
        F.count(F.when(F.col("status") == "failed", F.col("error_message"))).alias("error_count"),
    )


def crawl_errors(fetch_log: DataFrame) -> DataFrame:
    return fetch_log.where((F.col("status") == "failed") & F.col("error_message").isNotNull()).select(
        "url", "error_message"
    )


def crawl_report(fetch_log: DataFrame, crawl: CrawlSettings = CrawlSettings()) -> DataFrame:
    """The crawl report as rows ``(section, name, value)``: totals, limits, one JSON detail per URL."""
    limits = [
        F.struct(F.lit("config").alias("section"), F.lit(name).alias("name"), F.lit(value).alias("value"))
        for name, value in (
            ("max_depth", str(crawl.max_depth)),
            ("max_pages", str(crawl.max_pages)),
            ("allowed_domains", ",".join(crawl.allowed_domains)),
        )
    ]
    config = fetch_log.sparkSession.range(1).select(F.inline(F.array(*limits)))
    totals = crawl_metrics(fetch_log).select(
        F.lit("total").alias("section"),
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(name).alias("name"), F.col(source).cast("string").alias("value"))
                    for name, source in (
                        ("total_urls_attempted", "total_pages_attempted"),
                        ("successful_crawls", "pages_scraped"),
                        ("failed_crawls", "pages_failed"),
                    )
                ]
            )
        ),
    )
    detail = fetch_log.select(
        F.col("status").alias("section"),
        F.col("url").alias("name"),
        F.to_json(F.struct("url", "status", "error_message", "response_time", "content_length")).alias("value"),
    )
    return totals.unionByName(config).unionByName(detail)


def ingest_counters(fetch_log: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pages, chunks and words of an ingest in one row."""
    pages = crawl_metrics(fetch_log).select("pages_scraped", "pages_failed", "error_count", "average_response_time")
    words = documents.agg(F.coalesce(F.sum(word_count(F.col("content"))), F.lit(0)).alias("w")).scalar()
    made = chunks.agg(F.count("*").alias("c")).scalar()
    return pages.select(
        "pages_scraped",
        "pages_failed",
        made.alias("total_chunks_created"),
        words.alias("total_tokens_processed"),
        F.col("average_response_time").alias("average_scraping_time"),
        "error_count",
    )


def embedding_stats(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    lengths = vectors.select(norm(F.col(vector)).alias("n"), F.size(vector).alias("d"))
    return lengths.agg(
        F.count("*").alias("count"),
        F.max("d").alias("dimension"),
        F.avg("n").alias("mean_norm"),
        F.stddev_pop("n").alias("std_norm"),
    )


def embedding_dim_stats(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Mean and population deviation per dimension; combined per task before the shuffle."""
    return (
        vectors.select(F.posexplode(vector).alias("dim", "value"))
        .groupBy("dim")
        .agg(
            F.avg(F.col("value").cast("double")).alias("mean"),
            F.stddev_pop(F.col("value").cast("double")).alias("std"),
        )
    )


def index_stats(chunks: DataFrame, documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    dimension = settings.embed.dimension
    vectors = chunks.where(is_valid(F.col("embedding"), dimension)).agg(F.count("*").alias("n"))
    return vectors.select(
        F.col("n").alias("num_vectors"),
        documents.agg(F.count("*").alias("n")).scalar().alias("num_documents"),
        F.lit(dimension).alias("dimension"),
        F.lit("exact").alias("index_type"),
        F.lit(settings.embed.metric).alias("similarity_metric"),
        F.col("n").alias("index_size"),
    )


def system_stats(chunks: DataFrame, documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Index figures and settings as rows ``(name, value)``."""
    figures = index_stats(chunks, documents, settings)
    pairs = [
        F.struct(F.lit(f"index.{c}").alias("name"), F.col(c).cast("string").alias("value")) for c in figures.columns
    ] + [F.struct(F.lit(k).alias("name"), F.lit(v).alias("value")) for k, v in settings.flat()]
    return figures.select(F.inline(F.array(*pairs)))


def keyword_hits(texts: DataFrame, text: str, terms: tuple[str, ...]) -> DataFrame:
    return texts.withColumn("keyword_hits", count_terms(F.lower(text), terms))
