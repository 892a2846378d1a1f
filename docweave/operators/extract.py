"""Pages to documents: row by row, JVM-side, without a shuffle.

Each stage is its own projection, so that an expression used by several later ones is
evaluated once per row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.config import Settings
from docweave.functions import html as H
from docweave.functions import text as X
from docweave.functions.urls import document_id

SCRATCH = ("_quiet", "_tag_title", "_core", "_article", "_main", "_block", "_stripped", "_text", "_whole")


def quiet_pages(pages: DataFrame) -> DataFrame:
    """Adds ``_quiet``: the HTML without comments, scripts and styles."""
    return pages.withColumn("_quiet", H.without_noise(F.coalesce("html", F.lit(""))))


def with_main_text(pages: DataFrame, column: str = "main_text") -> DataFrame:
    """Text of the main block; empty when a page has none."""
    staged = (
        quiet_pages(pages)
        .withColumn("_core", H.without_chrome(F.col("_quiet"), H.CHROME_IN_MAIN))
        .withColumn("_article", H.element(F.col("_core"), "article"))
        .withColumn("_main", H.element(F.col("_core"), "main"))
        .withColumn(
            "_block",
            F.when(F.col("_article") != "", F.col("_article"))
            .when(F.col("_main") != "", F.col("_main"))
            .otherwise(H.main_blocks(F.regexp_replace("_core", r"(?is)^.*<body\b[^>]*>", ""))),
        )
        .withColumn("_stripped", H.without_tags(F.col("_block")))
        .withColumn("_text", H.decode_entities(F.col("_stripped")))
    )
    return staged.withColumn(column, X.collapse(F.col("_text"))).drop(
        "_core", "_article", "_main", "_block", "_stripped", "_text"
    )


def with_page_text(pages: DataFrame, column: str = "page_text") -> DataFrame:
    """Text of the whole page apart from navigation, header and footer."""
    ready = pages if "_quiet" in pages.columns else quiet_pages(pages)
    return (
        ready.withColumn("_whole", H.without_tags(H.without_chrome(F.col("_quiet"), H.CHROME_IN_PAGE)))
        .withColumn(column, X.collapse(H.decode_entities(F.col("_whole"))))
        .drop("_whole")
    )


def with_title(pages: DataFrame, column: str = "title") -> DataFrame:
    ready = pages if "_quiet" in pages.columns else quiet_pages(pages)
    return (
        ready.withColumn("_tag_title", H.raw_title(F.col("_quiet")))
        .withColumn(column, X.clean_title(H.decode_entities(F.col("_tag_title"))))
        .drop("_tag_title")
    )


def build_documents(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One document per page with HTML.

    A page whose main block has no text falls back to the whole page, described by its
    first characters instead of its first sentence. ``crawl_depth``, ``crawl_ts`` and
    ``response_time`` are taken from the pages when present.
    """
    limit = settings.chunk.description_length
    fetched = pages.where(F.col("html").isNotNull() & (F.col("html") != ""))
    whole = H.without_tags(H.without_chrome(F.col("_quiet"), H.CHROME_IN_PAGE))
    staged = (
        with_title(with_main_text(fetched))
        .withColumn(
            "content",
            # the whole-page text is only computed for pages that need it
            F.when(F.col("main_text") != "", F.col("main_text")).otherwise(
                X.collapse(H.decode_entities(whole))
            ),
        )
        .withColumn(
            "short_description",
            F.when(F.col("main_text") != "", X.short_description(F.col("content"), limit)).otherwise(
                X.clip(F.col("content"), limit)
            ),
        )
    )

    def optional(name: str, kind: str):
        return (F.col(name) if name in pages.columns else F.lit(None)).cast(kind).alias(name)

    return staged.select(
        document_id(F.col("url")).alias("doc_id"),
        "url",
        "title",
        "content",
        "short_description",
        F.col("html").alias("raw_html"),
        optional("crawl_depth", "int"),
        optional("crawl_ts", "timestamp"),
        F.length("html").alias("content_length"),
        optional("response_time", "double"),
        F.current_timestamp().alias("created_at"),
    )
