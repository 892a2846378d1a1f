"""Mixing sources to target weights by systematic sampling.

Every source gets a target in words. Within a source each document expects the same number of
copies, target over size; the expectations are summed in order of document size, one random
offset is added, and a document is emitted once for each integer boundary that its stretch of the
sum crosses. As neighbours in that order have like sizes, the words taken come near the target.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docweave.llm.common import BLANKS
from docweave.session import bounded, cut_lineage

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
SEED = 20


def offset_of(seed: int) -> float:
    """The one random offset in [0, 1) of a seed."""
    return random.Random(seed).random()


def size_of(text: Column) -> Column:
    """Words of a text; null has none."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.translate(squeezed, " \t\n\x0b\x0c\r", "")).cast("long")


def indexed(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` sorted by ``order`` with a global 0-based ``__at``, without a task that sees all rows.

    Rows are range-partitioned; a row's index is its index within its partition plus the rows of
    all partitions before it (one number per partition). The sorted rows are checkpointed, so a
    lost executor cannot change them between the two uses. Rows that tie in ``order`` keep an
    arbitrary but fixed order.
    """
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    dealt = cut_lineage(dealt.withColumn("__id", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("__part", F.shiftright("__id", 33)).withColumn("__in", F.col("__id").bitwiseAND((1 << 33) - 1))
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))
    # one row per partition of the exchange above: its size is known
    return dealt.join(F.broadcast(before), "__part").withColumn("__at", F.col("__before") + F.col("__in")).drop("__id", "__part", "__in", "__before")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``source, source_size`` with a ``target``: ``share`` of all sizes by weight, at most ``cap`` sizes each.

    What a capped source leaves is shared anew by weight among the others until none is above.
    Weights repeat along the sources in order, null last. Only totals come to the driver.
    """
    order = (F.col("source").isNull(), F.col("source"))
    table = ",".join(f"cast({w} as double)" for w in weights)
    ranked = indexed(sources.withColumn("__null", order[0]), F.col("__null"), F.col("source")).withColumn(
        "weight", F.expr(f"element_at(array({table}), cast(__at % {len(weights)} as int) + 1)")
    )
    ranked = cut_lineage(ranked.select("source", "source_size", "weight"))
    limit = cap * F.col("source_size")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    rest, over, level = share * total, None, None
    while True:
        # level: words per unit of weight for the sources below their cap
        capped = F.lit(False) if level is None else limit * F.lit(level[1]) < F.lit(level[0]) * F.col("weight")
        sums = ranked.agg(
            F.sum(F.when(capped, limit).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))), F.sum(capped.cast("long"))
        ).first()
        if over == sums[2] or not sums[1]:
            break
        over, level = sums[2], (rest - sums[0], sums[1])
    if level is None:
        return ranked.withColumn("target", F.lit(0.0))
    return ranked.withColumn("target", F.least(limit.cast("double"), F.lit(level[0]) * F.col("weight") / F.lit(level[1])))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    seed: int = SEED,
) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` per input row.

    Null texts have size 0; a null source is one source, last in order; null ids sort first; rows
    that tie keep any fixed order, which matters to equal rows only; an empty table gives an empty
    one; other columns are not read. Only ids, sources and sizes are shuffled, never texts, and a
    large source spreads over many partitions.
    """
    sized = docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"), size_of(docs[text_col]).alias("size"))
    placed = indexed(sized.withColumn("__null", F.col("source").isNull()), F.col("__null"), F.col("source"), F.col("size"), F.col("doc_id"))
    sources = placed.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("__at").alias("__first"))
    targets = source_targets(sources.select("source", "source_size"), weights, share, cap)
    known = targets.join(sources.select(F.col("source").alias("__s"), "__first"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s", "weight")
    known = known.withColumnRenamed("source", "__s")
    joined = placed.join(bounded(known), placed["source"].eqNullSafe(known["__s"]))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rank = F.col("__at") - F.col("__first")
    u = F.lit(offset_of(seed))
    copies = F.floor((rank + 1) * rate + u) - F.floor(rank * rate + u)
    return joined.select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )
