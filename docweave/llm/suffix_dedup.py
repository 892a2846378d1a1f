"""Exact substring dedup of bytes over a distributed, sparse suffix array sorted deep-shallow.

Suffixes start at content-defined anchors (see ``anchors``). Those of one anchor are ordered by
multikey quicksort, eight bytes at a time, down to a shallow depth; groups that still agree have
long common prefixes and are ordered by blind tries, which look at branching bytes only and
compare each suffix with one other in full. Common prefixes of neighbours, to the right and to
the left of the anchor, then tell which windows are repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docweave.llm.anchors import Spec, keyed, repeats, same_text, united
from docweave.llm.common import slices

LENGTH = 400
CORE = 128
SHALLOW_WORDS = 20
_VALUES = np.random.default_rng(3).integers(1, 1 << 63, 256, dtype="u8") | np.uint64(1)


def byte_symbols(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), "u1")


def byte_values(symbols: np.ndarray) -> np.ndarray:
    return _VALUES[symbols]


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    low, high = 0, n
    if a[:n] == b[:n]:
        return n
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class BlindTrie:
    """Orders byte strings; inner nodes know only their depth and the byte after it of each child."""

    def __init__(self):
        self.root: list | None = None  # inner: [depth, {byte: node}], leaf: [string, members]

    def add(self, string: bytes, member: int) -> None:
        if self.root is None:
            self.root = [string, [member]]
            return
        node = self.root
        while isinstance(node[1], dict):  # blind: only the branching bytes are looked at
            byte = string[node[0]] if node[0] < len(string) else -1
            node = node[1].get(byte) or next(iter(node[1].values()))
        same = common_prefix(string, node[0])
        if same == len(string) == len(node[0]):
            node[1].append(member)
            return
        ours = string[same] if same < len(string) else -1
        theirs = node[0][same] if same < len(node[0]) else -1
        parent, branch, node = None, None, self.root
        while isinstance(node[1], dict) and node[0] < same:
            parent, branch = node, string[node[0]]
            node = node[1][branch]
        if isinstance(node[1], dict) and node[0] == same:
            node[1][ours] = [string, [member]]
            return
        fork = [same, {theirs: node, ours: [string, [member]]}]
        if parent is None:
            self.root = fork
        else:
            parent[1][branch] = fork

    def sorted(self) -> Iterator[tuple[int, int]]:
        """(member, common prefix with the one before), in order; the first has -1."""
        stack: list[tuple[list, int]] = [(self.root, -1)] if self.root else []
        while stack:
            node, common = stack.pop()
            if isinstance(node[1], dict):
                children = sorted(node[1].items(), reverse=True)
                stack.extend((child, node[0] if i + 1 < len(children) else common) for i, (_, child) in enumerate(children))
            else:
                for i, member in enumerate(node[1]):
                    yield member, len(node[0]) if i else common


def deep_shallow(strings: list[bytes], groups: np.ndarray, shallow: int = SHALLOW_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Order of ``strings`` within ``groups`` and each one's common prefix with the one before (-1: first of a group)."""
    n = len(strings)
    words = max(1, shallow)
    head = np.zeros((n, words), ">u8")
    for i, s in enumerate(strings):
        part = s[: 8 * words]
        part += bytes(-len(part) % 8)
        head[i, : len(part) // 8] = np.frombuffer(part, ">u8")
    ends = np.array([len(s) for s in strings])
    head = head.astype("u8")
    # multikey quicksort, a word at a time: only groups that still agree are sorted on
    order = np.argsort(groups, kind="stable")
    rank = np.cumsum(np.r_[True, groups[order][1:] != groups[order][:-1]]) - 1
    common = np.where(np.r_[True, rank[1:] != rank[:-1]], -1, 0)
    open_rows = np.arange(n)
    for depth in range(words):
        sizes = np.bincount(rank)
        open_rows = np.flatnonzero((sizes[rank] > 1))
        if not len(open_rows):
            break
        member = order[open_rows]
        present = np.minimum(ends[member] - 8 * depth, 8)
        resort = np.lexsort((present, head[member, depth], rank[open_rows]))
        member, present = member[resort], present[resort]
        order[open_rows] = member
        value, inside = head[member, depth], rank[open_rows]
        differs = np.r_[True, (inside[1:] != inside[:-1]) | (value[1:] != value[:-1]) | (present[1:] != present[:-1])]
        fresh = differs & np.r_[False, inside[1:] == inside[:-1]]
        apart, agreed = value ^ np.r_[value[:1], value[:-1]], np.zeros(len(value), "i8")
        for byte in range(1, 8):
            agreed += (apart >> np.uint64(64 - 8 * byte)) == 0
        agreed = np.minimum(agreed, np.minimum(present, np.r_[present[:1], present[:-1]]).clip(0))
        common[open_rows[fresh]] = 8 * depth + agreed[fresh]
        common[open_rows[~differs]] = 8 * (depth + 1)
        starts = np.zeros(n, bool)
        starts[np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]])] = True
        starts[open_rows[fresh]] = True
        rank = np.cumsum(starts) - 1
        if (present[~differs] < 8).all():
            break
    # blind tries for the groups left
    bounds = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]])
    for start, end in zip(bounds, np.r_[bounds[1:], n], strict=True):
        if end - start > 1:
            trie = BlindTrie()
            for member in order[start:end].tolist():
                trie.add(strings[member], member)
            for i, (member, same) in enumerate(trie.sorted()):
                order[start + i] = member
                if i:
                    common[start + i] = same
    return order, common


def remove_repeats(docs: DataFrame, length: int = LENGTH, core: int = CORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` per row: removed byte spans (end exclusive) and the remaining bytes.

    A byte goes if a string of ``length`` bytes over it also starts anywhere else. Null texts count
    as empty; null ids are rows like others; a repeated row repeats its text, so long texts go from
    both; an empty table gives an empty one; other columns are not read.
    """
    spec = Spec(length, core, byte_symbols, byte_values, 1, smaller_only=False)
    marked = same_text(keyed(docs, id_col, text_col), repeats(docs, spec, deep_shallow, id_col, text_col), "left")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, spans, kept = [], [], []
            for text, found in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                data, at, parts = (text or "").encode("utf-8", "surrogatepass"), 0, []
                merged = united(found or [])
                for s, e in merged:
                    parts.append(data[at:s])
                    at = e
                sizes.append(len(data))
                spans.append([{"start": s, "end": e} for s, e in merged])
                kept.append(b"".join([*parts, data[at:]]))
            arrays = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "spans", "kept"])

    return marked.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
