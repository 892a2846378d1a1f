"""Predicates as Columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.config import RelevanceSettings
from docweave.functions.text import any_term, count_terms

RANGE_TESTS = {
    "gte": lambda c, v: c >= v,
    "lte": lambda c, v: c <= v,
    "gt": lambda c, v: c > v,
    "lt": lambda c, v: c < v,
}


def relevant(url: Column, content: Column, rule: RelevanceSettings) -> Column:
    """URL term, enough content terms, or enough brand terms; without content terms everything is kept."""
    if not rule.content_terms:
        return F.lit(True)
    text = F.lower(content)
    return (
        any_term(F.lower(url), rule.url_terms)
        | (count_terms(text, rule.content_terms) >= rule.min_content_terms)
        | (count_terms(text, rule.brand_terms) >= rule.min_brand_terms)
    )


def metadata_predicate(df: DataFrame, filters: Mapping[str, Any]) -> Column:
    """All conditions hold: equality, membership (a list) or a range (gte, lte, gt, lt).

    Keys name columns of ``df``; a null fails. An unknown key is an error when the plan is
    built.
    """
    keep = F.lit(True)
    for key, wanted in filters.items():
        if key not in df.columns:
            raise KeyError(f"no column {key!r} to filter on")
        column = df[key]
        if isinstance(wanted, Mapping):
            unknown = set(wanted) - set(RANGE_TESTS)
            if unknown:
                raise KeyError(f"unknown range test(s) {sorted(unknown)}")
            for name, bound in wanted.items():
                keep = keep & F.coalesce(RANGE_TESTS[name](column, bound), F.lit(False))
        elif isinstance(wanted, (list, tuple, set)):
            keep = keep & F.coalesce(column.isin(list(wanted)), F.lit(False))
        else:
            keep = keep & F.coalesce(column == F.lit(wanted), F.lit(False))
    return keep


def id_predicate(column: Column, ids: Sequence[str] | None) -> Column:
    """Membership; an empty list means no filter."""
    return column.isin(list(ids)) if ids else F.lit(True)


def path_match(url: Column, path_filters: tuple[str, ...]) -> Column:
    return any_term(F.lower(url), path_filters) if path_filters else F.lit(True)


def same_section(child: Column, parent: Column, path_filters: tuple[str, ...]) -> Column:
    """Child and parent contain the same path filter."""
    if not path_filters:
        return F.lit(True)
    both = F.lit(False)
    for piece in path_filters:
        both = both | (
            F.contains(F.lower(child), F.lit(piece)) & F.contains(F.lower(parent), F.lit(piece))
        )
    return both
