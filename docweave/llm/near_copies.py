"""Groups of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

The join is exact. Put in one order, two sets of that similarity share a shingle among their first
``n - ceil(0.8 n) + 1`` (prefix filter), so only those are dealt out. The order takes shingles that
a sample of the texts has often last; it decides what the search costs, never what it finds.
Texts that meet are compared by their whole sets. First each text meets one text of each of its
shingles and groups are formed of what is similar; then all pairs of different groups meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import slices, texts_of
from docweave.llm.components import components
from docweave.llm.simhash import _Groups
from docweave.session import BROADCAST_ROWS, bounded, cut_lineage

SHINGLE = 5
#: Similarity as a fraction, so that bounds are whole numbers.
NUMERATOR, DENOMINATOR = 4, 5
#: Texts of the sample for the order, the least count there, and the shingles kept of it.
SAMPLE, OFTEN, KNOWN = 20_000, 4, 200_000
#: Rounds of one text per shingle go on while one pair in so many turns out similar.
WORTH = 10
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def shingles(text: str) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; under five words all of them are one, no words give none."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, "u8")
    hashed = np.array(list(map(xxhash.xxh64_intdigest, words)), "u8")
    size = min(SHINGLE, len(words))
    n = len(words) - size + 1
    mixed = np.full(n, size, "u8")
    for k in range(size):
        mixed += hashed[k : k + n] * np.uint64(_FACTORS[k])
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def _lists(found: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, found)]).astype("i4")
    values = np.concatenate([*found, np.empty(0, "u8")]).view("i8")
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))


def _sets(texts: DataFrame, often: np.ndarray | None = None) -> DataFrame:
    """``node, n, part`` per text: the size of its set, and the set or, given ``often``, its prefix. A task answers a node once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        order = None if often is None else np.argsort(often)
        for batch in slices(batches):
            nodes, sizes, parts = [], [], []
            for node, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                if node in seen:
                    continue
                seen.add(node)
                part = shingles(text)
                n = len(part)
                if often is not None and n:
                    rank = np.full(n, -1)
                    if len(often):
                        at = np.minimum(np.searchsorted(often, part, sorter=order), len(often) - 1)
                        known = often[order[at]] == part
                        rank[known] = order[at[known]]
                    part = part[np.argsort(rank, kind="stable")[: n - -(-NUMERATOR * n // DENOMINATOR) + 1]]
                nodes.append(node)
                sizes.append(n)
                parts.append(part)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), _lists(parts)], names=["node", "n", "part"])

    return texts.select("node", "text").mapInArrow(run, "node long, n int, part array<long>")


def _often(texts: DataFrame) -> np.ndarray:
    """Shingles that a sample of the texts has often, the most frequent last."""
    every = max(1, texts.count() // SAMPLE)
    sample = _sets(texts.filter(F.pmod("node", F.lit(every)) == 0))
    counts = sample.select(F.explode("part").alias("shingle")).groupBy("shingle").count().filter(F.col("count") >= OFTEN)
    rows = counts.orderBy(F.desc("count"), "shingle").limit(KNOWN).toArrow()
    return rows.column("shingle").to_numpy()[::-1].view("u8").copy()


def _similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose whole sets are similar enough."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = cut_lineage(_sets(texts.join(bounded(nodes), "node")).dropDuplicates(["node"]))
    left, right = (sets.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("part").alias(f"set_{c}")) for c in "ab")
    both = F.size(F.array_intersect("set_a", "set_b"))
    met = pairs.join(left, "a").join(right, "b").withColumn("both", both)
    return met.filter(F.col("both") * DENOMINATOR >= NUMERATOR * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b")


def _roots(links: DataFrame) -> DataFrame:
    """``node, root`` of checkpointed links: worked out on the driver while they are few (counted first), else by rounds of joins."""
    if links.count() > BROADCAST_ROWS:
        return components(links)
    ends = links.toArrow()
    a, b = (ends.column(i).to_numpy() for i in range(2))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    sets = _Groups(len(nodes))
    sets.join(at[: len(a)], at[len(a) :])
    found = pa.table({"node": nodes, "root": nodes[sets.settle()]}, schema=pa.schema([("node", pa.int64()), ("root", pa.int64())]))
    return links.sparkSession.createDataFrame(found)


def groups(texts: DataFrame) -> DataFrame:
    """``node, root`` of the texts (``node``, ``text``; a node names one text) that are similar to another, over any number of links.

    Texts without words are equal sets and form one group.
    """
    prefixes = cut_lineage(_sets(texts, _often(texts)))
    blank = prefixes.filter("n = 0").select("node").distinct()
    links = blank.crossJoin(blank.agg(F.min("node").alias("least"))).filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    dealt = prefixes.select("node", "n", F.explode("part").alias("shingle"))
    shared = dealt.groupBy("shingle").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("shingle")
    live = cut_lineage(dealt.join(shared, "shingle").distinct().withColumn("root", F.col("node")))
    links = cut_lineage(links)
    fits = (F.col("n") * DENOMINATOR >= F.col("n2") * NUMERATOR) & (F.col("n2") * DENOMINATOR >= F.col("n") * NUMERATOR)
    turn, star = 0, True
    while True:
        # shingles whose texts are all of one group have nothing left to find
        ends = live.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("shingle")
        live = cut_lineage(live.join(ends, "shingle"))
        if live.isEmpty():
            break
        if star:
            by = F.xxhash64(F.col("node"), F.lit(turn))
            other = live.groupBy("shingle").agg(F.min(F.struct(by.alias("by"), "node", "n", "root")).alias("m"))
            other = other.select("shingle", F.col("m.node").alias("node2"), F.col("m.n").alias("n2"), F.col("m.root").alias("root2"))
        else:
            other = live.select("shingle", F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("root").alias("root2"))
        met = live.join(other, "shingle").filter((F.col("root") != F.col("root2")) & fits)
        pairs = cut_lineage(met.select(F.greatest("node", "node2").alias("a"), F.least("node", "node2").alias("b")).distinct())
        similar = cut_lineage(_similar(pairs, texts))
        links = cut_lineage(links.union(similar))
        if not star:
            break
        turn, star = turn + 1, similar.count() * WORTH > pairs.count()
        live = live.drop("root").join(_roots(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    return _roots(links)
