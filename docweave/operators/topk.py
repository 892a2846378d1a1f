"""Exact top rows per group and over a whole table, without one task seeing everything."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.session import cut_lineage


def top_k(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    rank: str = "rank",
    salt_on: str | None = None,
    salts: int = 32,
) -> DataFrame:
    """Rank rows within ``keys`` and keep the first ``k``.

    Every map task passes on at most ``k`` rows per group. With ``salt_on`` (a column that
    is unique within the group) a first round ranks slices of each group in parallel, so a
    group that holds a large part of the table is never sorted by one task.
    """
    if salt_on is not None:
        df = df.withColumn("_salt", F.pmod(F.xxhash64(salt_on), F.lit(salts)))
        part = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = df.withColumn(rank, F.row_number().over(part)).where(F.col(rank) <= k).drop("_salt", rank)
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(
        F.col(rank) <= k
    )


def first_rows(df: DataFrame, order: str, n: int, sort_limit: int = 10_000) -> DataFrame:
    """The first ``n`` rows of the whole table by a unique column.

    Small ``n`` is a sort with a limit. Beyond ``sort_limit`` rows the table is range
    partitioned and each partition is numbered from the row counts of those before it, so
    the rows never meet in one task.
    """
    if n <= sort_limit:
        return df.orderBy(order).limit(n)
    ranged = cut_lineage(
        df.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id())
    )
    # one row per partition: bounded by the number of partitions, not by the data
    before = (
        ranged.groupBy("_part")
        .count()
        .withColumn(
            "_before",
            F.coalesce(
                F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
        .select("_part", "_before")
    )
    whole = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return (
        ranged.join(F.broadcast(before), "_part")
        .where(F.col("_before") < n)
        .withColumn("_row", whole)
        .where(F.col("_row") <= n)
        .drop("_part", "_before", "_row")
    )
