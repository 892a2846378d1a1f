"""Immutable settings passed to the operators.

``Settings()`` holds the defaults; ``Settings().override({...})`` is a deep merge, so
changing one field of a group leaves its siblings alone.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any


@dataclass(frozen=True)
class CrawlSettings:
    max_depth: int = 5
    max_pages: int = 150
    allowed_domains: tuple[str, ...] = ()
    domain_suffix_match: bool = False
    # The path parts that mark a primary page unless others are given
    primary_path_filters: tuple[str, ...] = ("/products/", "/solutions/")
    max_primary_pages: int = 10
    max_child_links: int = 5
    max_links_per_page: int = 15
    # (bare prefix, replacement prefix) pairs applied to seed URLs
    host_aliases: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class RelevanceSettings:
    """A page is kept on a URL hit, on enough content terms, or on enough brand terms."""

    url_terms: tuple[str, ...] = ()
    content_terms: tuple[str, ...] = ()
    brand_terms: tuple[str, ...] = ()
    min_content_terms: int = 2
    min_brand_terms: int = 1


@dataclass(frozen=True)
class ChunkSettings:
    size: int = 1000
    overlap: int = 200
    min_size: int = 100
    description_length: int = 200


@dataclass(frozen=True)
class EmbedSettings:
    dimension: int = 384
    batch_size: int = 32
    metric: str = "cosine"
    model_name: str = "token-hash"


@dataclass(frozen=True)
class SearchSettings:
    top_k: int = 5
    rerank_top_k: int = 5
    rerank: bool = True
    search_multiplier: int = 3
    filter_multiplier: int = 4
    search_limit: int = 10
    # True keeps the rerank cut at rerank_top_k even when more rows were asked for
    strict_rerank_cap: bool = False


@dataclass(frozen=True)
class AnswerSettings:
    context_length: int = 4000
    max_sources: int = 10
    max_sentences: int = 6
    min_length: int = 200
    extra_sentences: int = 3
    summary_length: int = 1000
    summary_sentences: int = 3
    display_sources: int = 3
    snippet_length: int = 200


@dataclass(frozen=True)
class Settings:
    crawl: CrawlSettings = field(default_factory=CrawlSettings)
    relevance: RelevanceSettings = field(default_factory=RelevanceSettings)
    chunk: ChunkSettings = field(default_factory=ChunkSettings)
    embed: EmbedSettings = field(default_factory=EmbedSettings)
    search: SearchSettings = field(default_factory=SearchSettings)
    answer: AnswerSettings = field(default_factory=AnswerSettings)

    def override(self, changes: Mapping[str, Any]) -> Settings:
        return _merge(self, changes)

    def flat(self) -> list[tuple[str, str]]:
        """``group.field`` / value pairs, for the statistics tables."""
        return [
            (f"{group.name}.{item.name}", str(getattr(getattr(self, group.name), item.name)))
            for group in fields(self)
            for item in fields(getattr(self, group.name))
        ]


def _merge(node: Any, changes: Mapping[str, Any]) -> Any:
    known = {f.name for f in fields(node)}
    unknown = set(changes) - known
    if unknown:
        raise KeyError(f"unknown setting(s): {sorted(unknown)}")
    values = {}
    for name, value in changes.items():
        current = getattr(node, name)
        if is_dataclass(current):
            values[name] = _merge(current, value)
        elif isinstance(current, tuple):
            values[name] = tuple(value)
        else:
            values[name] = value
    return replace(node, **values)
