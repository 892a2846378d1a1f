"""Evaluating a value once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A projected column that is used once, inside a lambda, is merged into that lambda by the
    optimizer and would be evaluated for every element; a lambda variable is not.
    """
    return F.transform(F.array(value), body)[0]


def apart(value: Column) -> Column:
    """``value`` as a generated column, for a ``select``: the optimizer does not merge it into what uses it.

    Spark leaves a Python function unplanned if a lambda within a lambda is merged into its input, and
    the job then fails with "Cannot evaluate expression".
    """
    return F.explode_outer(F.array(value))
