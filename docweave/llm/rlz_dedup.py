"""Substring dedup of words against blocks of documents with smaller ids.

Every stretch of every document is a reference block for the documents with larger ids, indexed by
content-defined anchors (see ``anchors``). The blocks around one anchor are sorted, and from the
common prefixes of neighbours, to the right and to the left, follows which windows of ``length`` words
also start in a smaller id. The result is exact; it takes the place of a greedy parse into factors.
Very long texts are read whole, in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docweave.llm.anchors import Spec, keyed, repeats, same_text, united
from docweave.llm.common import slices

LENGTH = 50
CORE = 16


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def word_symbols(text: str) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(w) for w in words_of(text)], "u8")


def factor_order(strings: list[bytes], groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The blocks of each group in sorted order, and how many bytes each shares with the one before (-1: first).

    The longest factor of a block against any other is that with a neighbour in this order.
    """
    order = np.array(sorted(range(len(strings)), key=lambda i: (groups[i], strings[i])), "i8")
    common = np.full(len(strings), -1, "i8")
    for k in range(1, len(order)):
        i, j = order[k - 1], order[k]
        if groups[i] == groups[j]:
            a, b = (np.frombuffer(strings[x], "u8") for x in (i, j))
            n = min(len(a), len(b))
            apart = np.flatnonzero(a[:n] != b[:n])
            common[k] = 8 * (int(apart[0]) if len(apart) else n)
    return order, common


def remove_repeats(docs: DataFrame, length: int = LENGTH, core: int = CORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, spans, kept`` per row: removed word spans (end exclusive) and the rest, joined by blanks.

    A word goes if ``length`` words in a row over it also start in a row with a smaller id. A null
    id is larger than all others, and null texts have no words; rows that share an id do not count
    against each other; an empty table gives an empty one; other columns are not read.
    """
    spec = Spec(length, core, word_symbols, lambda values: values, 8, smaller_only=True)
    marked = same_text(keyed(docs, id_col, text_col), repeats(docs, spec, factor_order, id_col, text_col), "left")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, spans, kept = [], [], []
            for text, found in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words, at, parts = words_of(text or ""), 0, []
                merged = united(found or [])
                for s, e in merged:
                    parts += words[at:s]
                    at = e
                sizes.append(len(words))
                spans.append([{"start": s, "end": e} for s, e in merged])
                kept.append(b" ".join(parts + words[at:]))
            arrays = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "spans", "kept"])

    return marked.mapInArrow(run, "doc_id long, n_words long, spans array<struct<start: long, end: long>>, kept binary")
