"""Bounded traversal of the link graph as joins, one round per depth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.config import CrawlSettings
from docweave.functions.urls import crawlable, replace_prefix
from docweave.operators.links import page_links
from docweave.operators.topk import first_rows
from docweave.session import cut_lineage


def link_table(pages: DataFrame, crawl: CrawlSettings = CrawlSettings()) -> DataFrame:
    """``(src_url, page_id, links)`` with one row per URL: the latest copy of a page wins.

    Materialised, so that HTML is parsed once however often the links are joined. The
    aggregation combines copies before the shuffle, so a URL that fills much of the table does
    not land in one task, and it leaves the table partitioned by URL.
    """
    return cut_lineage(
        page_links(pages, crawl)
        .groupBy("src_url")
        .agg(F.max("page_id").alias("page_id"), F.max_by("links", "page_id").alias("links"))
    )


def link_graph(links: DataFrame, crawl: CrawlSettings = CrawlSettings()) -> DataFrame:
    """``(src_url, page_id, targets)``: the links of each page that are followed."""
    followed = F.slice("links", 1, crawl.max_links_per_page)
    return links.select("src_url", "page_id", F.transform(followed, lambda x: x["dst_url"]).alias("targets"))


def seed_table(urls: DataFrame, crawl: CrawlSettings = CrawlSettings()) -> DataFrame:
    """Distinct crawlable seeds after host aliases."""
    return (
        urls.select(replace_prefix(F.col("url"), crawl.host_aliases).alias("url"))
        .where(crawlable(F.col("url"), crawl.allowed_domains, crawl.domain_suffix_match))
        .distinct()
    )


def frontier_step(frontier: DataFrame, graph: DataFrame, visited: DataFrame, crawl: CrawlSettings) -> DataFrame:
    """URLs linked from the frontier's fetched pages that were not visited yet."""
    return (
        frontier.select(F.col("url").alias("src_url"))
        .join(graph.select("src_url", "targets"), "src_url")
        .select(F.explode("targets").alias("url"))
        .where(crawlable(F.col("url"), crawl.allowed_domains, crawl.domain_suffix_match))
        .distinct()
        .join(visited.select("url"), "url", "left_anti")
    )


def traverse(graph: DataFrame, seeds: DataFrame, crawl: CrawlSettings = CrawlSettings()) -> DataFrame:
    """``(url, depth, status, page_id)`` of every URL attempted.

    Depth is the least number of links from a seed. The page budget is exact and taken in
    (depth, url) order. A URL without a page is a failed attempt and is not expanded. Each
    round ends in a reliable checkpoint, and the graph should be a materialised one.
    """
    left = crawl.max_pages
    levels: list[DataFrame] = []
    frontier = cut_lineage(seed_table(seeds, crawl))
    for depth in range(crawl.max_depth + 1):
        size = frontier.count()
        if size == 0 or left <= 0:
            break
        if size > left:
            frontier = cut_lineage(first_rows(frontier, "url", left))
            size = left
        levels.append(frontier.withColumn("depth", F.lit(depth)))
        left -= size
        if left > 0 and depth < crawl.max_depth:
            visited = reduce(DataFrame.unionByName, levels)
            frontier = cut_lineage(frontier_step(frontier, graph, visited, crawl))
    if not levels:
        levels = [frontier.withColumn("depth", F.lit(0)).limit(0)]
    reached = reduce(DataFrame.unionByName, levels)
    return reached.join(graph.select(F.col("src_url").alias("url"), "page_id"), "url", "left").select(
        "url",
        "depth",
        F.when(F.col("page_id").isNull(), "failed").otherwise("success").alias("status"),
        "page_id",
    )


def crawled_pages(pages: DataFrame, reached: DataFrame) -> DataFrame:
    """The page rows a traversal fetched, with ``crawl_depth``; HTML is read for these only."""
    fetched = reached.where(F.col("status") == "success").select(
        "url", "page_id", F.col("depth").alias("crawl_depth")
    )
    return pages.join(fetched, ["url", "page_id"])
