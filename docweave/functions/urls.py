"""URL columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions.text import any_term

SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.-]*):"
ORIGIN = r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)"
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)"
PATH = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"

# File endings that are never pages.
SKIPPED_ENDINGS = (".pdf", ".jpg", ".jpeg", ".png", ".gif", ".css", ".js", ".ico")
# Anchor phrases that put a link first.
PRIORITY_PHRASES = (
    "learn more", "read more", "discover", "explore", "get started", "view details", "find out more",
)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, SCHEME, 1))


def host(url: Column) -> Column:
    return F.regexp_extract(url, HOST, 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, PATH, 1)


def document_id(url: Column) -> Column:
    return F.md5(url)


def canonical(url: Column) -> Column:
    """Scheme, host and path only: parameters, query and fragment are dropped."""
    bare = F.regexp_extract(url, "^([^?#]*)", 1)
    return F.regexp_replace(bare, ";[^/]*$", "")


def without_dot_segments(url_path: Column) -> Column:
    """``/a/./b/../c`` to ``/a/c``."""

    def step(done: Column, segment: Column) -> Column:
        return (
            F.when(segment == "..", F.regexp_replace(done, "/[^/]*$", ""))
            .when(segment == ".", done)
            .otherwise(F.concat(done, F.lit("/"), segment))
        )

    segments = F.split(F.regexp_replace(url_path, "^/", ""), "/")
    joined = F.aggregate(segments, F.lit(""), step)
    ends_open = F.element_at(segments, -1).isin(".", "..")
    resolved = F.when(ends_open, F.concat(joined, F.lit("/"))).otherwise(joined)
    return F.when(url_path.rlike(r"/\.{1,2}(/|$)"), resolved).otherwise(url_path)


def base_parts(url: Column) -> Column:
    """What link resolution needs of a page URL; stage it once per page."""
    base_path = path(url)
    folder = F.regexp_replace(base_path, "[^/]*$", "")
    return F.struct(
        F.regexp_extract(url, SCHEME, 1).alias("scheme"),
        F.regexp_extract(url, ORIGIN, 1).alias("origin"),
        base_path.alias("path"),
        F.when(folder == "", F.lit("/")).otherwise(folder).alias("folder"),
        F.regexp_extract(url, "^([^#]*)", 1).alias("page"),
    )


def resolve(base: Column, href: Column) -> Column:
    """Absolute form of a link; ``base`` comes from :func:`base_parts`."""
    link_path = F.regexp_extract(href, "^([^?#]*)", 1)
    tail = F.regexp_extract(href, "^[^?#]*(.*)$", 1)
    return (
        F.when(href == "", base["page"])
        .when(href.rlike(SCHEME), href)
        .when(href.startswith("//"), F.concat(base["scheme"], F.lit(":"), href))
        .when(href.startswith("/"), F.concat(base["origin"], without_dot_segments(link_path), tail))
        .when(href.startswith("?"), F.concat(base["origin"], base["path"], href))
        .when(href.startswith("#"), F.concat(base["page"], href))
        .otherwise(F.concat(base["origin"], without_dot_segments(F.concat(base["folder"], link_path)), tail))
    )


def domain_allowed(url: Column, domains: tuple[str, ...], suffix_match: bool = False) -> Column:
    """Host contains one of the domains (or ends with one); no domains means all pass."""
    if not domains:
        return F.lit(True)
    site = host(url)
    if not suffix_match:
        return any_term(site, domains)
    bare = F.regexp_replace(F.lower(site), r":\d+$", "")
    allowed = F.lit(False)
    for domain in domains:
        wanted = domain.lower().lstrip(".")
        allowed = allowed | (bare == wanted) | bare.endswith("." + wanted)
    return allowed


def crawlable(url: Column, domains: tuple[str, ...] = (), suffix_match: bool = False) -> Column:
    """An http(s) page on an allowed domain."""
    endings = "|".join(ending.replace(".", r"\.") for ending in SKIPPED_ENDINGS)
    return (
        scheme(url).startswith("http")
        & ~F.lower(path(url)).rlike(f"(?:{endings})$")
        & domain_allowed(url, domains, suffix_match)
    )


def is_priority(anchor: Column) -> Column:
    return any_term(anchor, PRIORITY_PHRASES)


def file_name(url: Column) -> Column:
    """Host and path with slashes as underscores, ending in ``.html``."""
    flat = F.translate(F.concat(host(url), path(url)), "/\\", "__")
    return F.when(flat.endswith(".html"), flat).otherwise(F.concat(flat, F.lit(".html")))


def replace_prefix(url: Column, aliases: tuple[tuple[str, str], ...]) -> Column:
    """First matching (old prefix, new prefix) pair applied; small fixed lists only."""
    result = url
    for old, new in reversed(aliases):
        result = F.when(
            url.startswith(old), F.concat(F.lit(new), F.substr(url, F.lit(len(old) + 1)))
        ).otherwise(result)
    return result
