"""Pages to a stored corpus."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from docweave.config import Settings
from docweave.functions import vectors as V
from docweave.functions.filters import relevant
from docweave.functions.text import word_count
from docweave.operators.chunk import chunk_documents
from docweave.operators.crawl import crawled_pages, link_graph, link_table, traverse
from docweave.operators.extract import build_documents
from docweave.operators.links import discover, seed_union
from docweave.operators.metrics import crawl_metrics
from docweave.operators.search import embed_chunks
from docweave.session import cut_lineage
from docweave.sources.pages import fetch_log, latest_pages
from docweave.sources.store import CorpusStore


@dataclass(frozen=True)
class IngestReport:
    total_time: float
    pages_scraped: int
    pages_failed: int
    total_chunks_created: int
    total_tokens_processed: int
    average_scraping_time: float
    error_count: int
    batch: int
    crawl_time: float = 0.0
    extraction_time: float = 0.0
    # chunking, embedding and indexing are one pass over the stored documents
    embedding_time: float = 0.0
    # True if the traversal stopped at its page budget, so that URLs may be left
    budget_hit: bool = False


def relevant_documents(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Documents of the page table that pass the relevance rule.

    The rule is applied inside a one-element array: as a plain filter it would be pushed
    below the extraction and repeat it.
    """
    documents = build_documents(pages, settings)
    rule = settings.relevance
    if not rule.content_terms:
        return documents
    row = F.array(F.struct(*documents.columns))
    kept = F.filter(row, lambda d: relevant(d["url"], d["content"], rule))
    return documents.select(F.inline_outer(kept)).where(F.col("doc_id").isNotNull())


def embedded_chunks(documents: DataFrame, settings: Settings = Settings(), embed=V.token_hash) -> DataFrame:
    return embed_chunks(chunk_documents(documents, settings.chunk), settings, embed)


def crawl(pages: DataFrame, seeds: DataFrame, settings: Settings = Settings(), discovery: bool = True) -> DataFrame:
    """``(url, depth, status, page_id)`` reached from the seeds and the pages discovered from them."""
    links = link_table(pages, settings.crawl)
    start = seeds
    if discovery:
        edges = links.select("src_url", F.inline("links"))
        start = seed_union(seeds, discover(edges, seeds, settings.crawl))
    return traverse(link_graph(links, settings.crawl), start, settings.crawl)


def reached_log(reached: DataFrame, pages: DataFrame) -> DataFrame:
    """A fetch log of a traversal."""
    sizes = pages.select(
        "url", "page_id", F.length("html").alias("content_length"),
        (F.col("response_time") if "response_time" in pages.columns else F.lit(None)).cast("double").alias("response_time"),
        (F.col("error_message") if "error_message" in pages.columns else F.lit(None)).cast("string").alias("_error"),
    )
    return reached.join(sizes, ["url", "page_id"], "left").select(
        "url",
        "status",
        F.when(F.col("status") == "failed", F.coalesce("_error", F.lit("page not available"))).alias("error_message"),
        "response_time",
        "content_length",
    )


def ingest(
    pages: DataFrame,
    store: CorpusStore,
    seeds: DataFrame | None = None,
    settings: Settings = Settings(),
    embed=V.token_hash,
    batch: int | None = None,
) -> IngestReport:
    """Crawls from the seeds (or takes every page), extracts, chunks, embeds and stores.

    Chunks are made from the stored documents, so pages are parsed once and their HTML is not
    read again; counters are observed while the tables are written.
    """
    begin = time.monotonic()
    budget_hit = False
    if seeds is None:
        chosen = latest_pages(pages)
        log = fetch_log(pages)
    else:
        reached = cut_lineage(crawl(pages, seeds, settings))
        chosen, log = crawled_pages(pages, reached), reached_log(reached, pages)
        budget_hit = reached.count() >= settings.crawl.max_pages
    words, made = Observation("words"), Observation("chunks")
    crawled = extracted = time.monotonic()

    def chunks_of(stored: DataFrame) -> DataFrame:
        nonlocal extracted
        extracted = time.monotonic()
        return embedded_chunks(stored, settings, embed).observe(made, F.count("*").alias("n"))

    documents = relevant_documents(chosen, settings).observe(words, F.sum(word_count(F.col("content"))).alias("n"))
    number = store.write(documents, chunks_of, batch)
    stored_at = time.monotonic()
    store.save_figures()
    store.write_fetch_log(log, number)
    figures = crawl_metrics(store.fetch_log(number)).first()
    return IngestReport(
        total_time=time.monotonic() - begin,
        pages_scraped=figures["pages_scraped"],
        pages_failed=figures["pages_failed"],
        total_chunks_created=made.get["n"] or 0,
        total_tokens_processed=words.get["n"] or 0,
        average_scraping_time=figures["average_response_time"],
        error_count=figures["error_count"],
        batch=number,
        crawl_time=crawled - begin,
        extraction_time=extracted - crawled,
        embedding_time=stored_at - extracted,
        budget_hit=budget_hit,
    )
