"""SimHash near-duplicates, found through a Gray-order hierarchical index.

Fingerprints that differ in at most 3 of 64 bits agree on one of four 16-bit blocks, and on one of
four 12-bit blocks of the rest, so each distinct fingerprint is dealt to 16 buckets of 28 agreed
bits. Within a bucket the fingerprints are sorted by their rank in the reflected Gray code, where
neighbours share long bit patterns; runs of them form nodes, each with the mask of the bits that
all its members share. A search goes down the nodes, adding up differences on shared bits, and
drops a node with all its members once the sum passes 3. A bucket's links are written as a
forest (each fingerprint to the least of its group), never as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import slices, texts_of
from docweave.llm.components import components
from docweave.session import cut_lineage

SEED = 42
SHINGLE = 3
DISTANCE = 3
FAN = 8
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str, words_per_shingle: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half of the shingles' hashes; no words give zero."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    hashed, ends = xxhash.xxh64_intdigest, np.cumsum([len(w) + 1 for w in words]).tolist()
    line, n = b" ".join(words), words_per_shingle
    starts = [0, *ends[: max(0, len(words) - n)]]
    hashes = np.array([hashed(line[a : b - 1], SEED) for a, b in zip(starts, ends[min(n, len(words)) - 1 :], strict=True)], "<u8")
    votes = np.zeros(64, "i8")
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        votes += np.unpackbits(part.view("u1").reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) per row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(t) for t in texts_of(batch)], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(bits: np.ndarray) -> np.ndarray:
    """The place of each 64-bit pattern in the reflected Gray code."""
    rank = bits.copy()
    for step in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(step)
    return rank


class _Groups:
    """Disjoint sets over 0..n-1 whose root is the least member."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def settle(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return self.parent
            self.parent = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            root = self.settle()
            a, b = root[a], root[b]
            apart = a != b
            a, b = np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart])
            np.minimum.at(self.parent, a, b)


def link_sorted(bucket: np.ndarray, bits: np.ndarray, distance: int = DISTANCE, fan: int = FAN, most_pairs: int = 1 << 20) -> np.ndarray:
    """The group (index of its first member) of each fingerprint, by links within its bucket.

    ``bucket`` and ``bits`` are sorted by bucket and then Gray rank. Fingerprints are searched a
    block at a time, of as many as could meet ``most_pairs`` others at worst; a node whose members
    are all in the searcher's group already is dropped too, which keeps dense groups from being
    compared pair by pair.
    """
    n, groups = len(bits), _Groups(len(bits))
    if n < 2:
        return groups.parent
    near = (np.bitwise_count(bits[1:] ^ bits[:-1]) <= distance) & (bucket[1:] == bucket[:-1])
    at = np.flatnonzero(near)
    groups.join(at + 1, at)
    # levels: nodes of up to `fan` children of one bucket; first child, end, bits seen in any member, bits seen in all
    owner, low, high = bucket, bits, bits
    levels = []
    while True:
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        within = np.arange(len(owner)) - np.repeat(starts, np.diff(np.r_[starts, len(owner)]))
        first = np.flatnonzero(within % fan == 0)
        if len(first) == len(owner):
            break
        low, high = np.bitwise_and.reduceat(low, first), np.bitwise_or.reduceat(high, first)
        owner = owner[first]
        levels.append((first, np.r_[first[1:], len(within)], low, ~(low ^ high), owner))
    if not levels:
        return groups.settle()
    top = levels[-1][4]
    wide = np.flatnonzero(np.diff(np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), n]) > 1)
    runs = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    sizes = np.diff(np.r_[runs, n])
    askers = np.concatenate([np.arange(runs[w], runs[w] + sizes[w]) for w in wide]) if len(wide) else np.empty(0, int)
    root_of = np.searchsorted(runs, np.arange(n), "right") - 1  # a bucket's node on the top level
    assert len(top) == len(runs)
    reach = np.cumsum(sizes[root_of[askers]])
    cuts = np.searchsorted(reach, np.arange(0, int(reach[-1]) if len(reach) else 0, most_pairs), "right")
    cuts = np.unique(np.r_[0, cuts, len(askers)])
    for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
        root = groups.settle()
        # members' least and greatest group, per level: equal if a node is of one group
        spans, lo, hi = [], root, root
        for first, _, _, _, _ in levels:
            lo, hi = np.minimum.reduceat(lo, first), np.maximum.reduceat(hi, first)
            spans.append((lo, hi))
        who = askers[start:stop]
        node = root_of[who]
        for depth in range(len(levels) - 1, -1, -1):
            first, end, low, mask, _ = levels[depth]
            lo, hi = spans[depth]
            keep = (np.bitwise_count((bits[who] ^ low[node]) & mask[node]) <= distance) & ~((lo[node] == hi[node]) & (lo[node] == root[who]))
            who, node = who[keep], node[keep]
            counts = end[node] - first[node]
            who = np.repeat(who, counts)
            node = np.repeat(first[node] - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(len(who))
        hit = (node < who) & (np.bitwise_count(bits[who] ^ bits[node]) <= distance)
        groups.join(who[hit], node[hit])
    return groups.settle()


def _cut(value, start: int, width: int):
    return F.shiftrightunsigned(value, start).bitwiseAND((1 << width) - 1)


def _rest(value, block: int):
    """The 48 bits outside a 16-bit block."""
    low = value.bitwiseAND((1 << (16 * block)) - 1)
    return low.bitwiseOR(F.shiftleft(F.shiftrightunsigned(value, 16 * (block + 1)), 16 * block)) if block < 3 else low


def links_of(distinct: DataFrame) -> DataFrame:
    """``a, b`` links among distinct fingerprints ``fp`` with the groups that distance 3 or less makes."""
    fp = F.col("fp")
    keys = [
        _cut(fp, 16 * i, 16).bitwiseOR(F.shiftleft(_cut(_rest(fp, i), 12 * j, 12), 16)).bitwiseOR(F.lit((4 * i + j) << 28).cast("long"))
        for i in range(4)
        for j in range(4)
    ]
    n = max(1, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = distinct.select("fp", F.explode(F.array(*keys)).alias("bucket")).repartition(n, "bucket").sortWithinPartitions("bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def solved(bucket: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
            order = np.lexsort((gray_rank(bits), bucket))
            bucket, bits = bucket[order], bits[order]
            root = link_sorted(bucket, bits)
            moved = np.flatnonzero(root != np.arange(len(root)))
            ends = [bits[moved].view("i8"), bits[root[moved]].view("i8")]
            return pa.RecordBatch.from_arrays([pa.array(e, pa.int64()) for e in ends], names=["a", "b"])

        for batch in batches:
            fp, bucket = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            held.append((bucket, fp.view("u8")))
            if sum(len(b) for b, _ in held) > 1 << 17:
                bucket, bits = (np.concatenate(x) for x in zip(*held, strict=True))
                whole = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on
                if whole:
                    yield solved(bucket[:whole], bits[:whole])
                held = [(bucket[whole:], bits[whole:])]
        if held:
            yield solved(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` per row: the least doc_id reachable over links of 3 bits or fewer.

    Null and empty texts have fingerprint zero and link like any other; null ids are members of
    their group but name it only if it has no other id; repeated rows are answered each; an empty
    table gives an empty one; other columns are not read. After the fingerprints, only they and ids
    are shuffled, and equal fingerprints are one row before any comparison.
    """
    marked = cut_lineage(fingerprints(docs, id_col, text_col))
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    distinct = cut_lineage(distinct)
    roots = components(links_of(distinct.select("fp")))
    grouped = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = grouped.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")
