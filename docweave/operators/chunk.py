"""Documents to overlapping chunks; everything stays within the document's row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.config import ChunkSettings
from docweave.functions.binding import apart
from docweave.functions.text import collapse

PIECES = T.ArrayType(
    T.StructType(
        [
            T.StructField("chunk_index", T.IntegerType()),
            T.StructField("total_chunks", T.IntegerType()),
            T.StructField("content", T.StringType()),
            T.StructField("start_char", T.IntegerType()),
            T.StructField("true_start", T.IntegerType()),
        ]
    )
)


def pack_words(text: str, size: int, overlap: int) -> tuple[list[int], list[int]]:
    """Start and end offsets of greedily packed chunks of a text with single spaces.

    A chunk takes words while it stays within ``size``. The next one starts at the earliest
    word from which the chunk just closed has at most ``overlap`` characters left and the
    next word still fits. A word longer than ``size`` is cut into windows first.
    """
    if not text:
        return [], []
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    gaps = np.flatnonzero(points == 32)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(points)]))
    long = np.flatnonzero(ends - starts > size)
    if len(long):
        pieces_s, pieces_e, done = [], [], 0
        for at in long:
            cuts = np.arange(starts[at], ends[at] - overlap, size - overlap)
            pieces_s += [starts[done:at], cuts]
            pieces_e += [ends[done:at], np.minimum(cuts + size, ends[at])]
            done = at + 1
        starts = np.concatenate([*pieces_s, starts[done:]])
        ends = np.concatenate([*pieces_e, ends[done:]])
    firsts, lasts, a = [], [], 0
    while True:
        b = int(np.searchsorted(ends, starts[a] + size, side="right")) - 1
        firsts.append(int(starts[a]))
        lasts.append(int(ends[b]))
        if b == len(ends) - 1:
            return firsts, lasts
        by_overlap = np.searchsorted(starts, ends[b] - overlap)
        by_fit = np.searchsorted(starts, ends[b + 1] - size)
        a = int(min(max(by_overlap, by_fit), b + 1))


def word_pieces(text: Column, chunk: ChunkSettings) -> Column:
    """Packed chunks of a collapsed text, numbered first and filtered by length after."""

    @F.arrow_udf(PIECES)
    def pieces(texts: pa.Array) -> pa.Array:
        numbers, totals, contents, befores, firsts = [], [], [], [], []
        offsets = [0]
        for value in texts:
            content = value.as_py() or ""
            starts, ends = pack_words(content, chunk.size, chunk.overlap)
            before = 0
            for number, (first, last) in enumerate(zip(starts, ends)):
                if last - first < chunk.min_size:
                    continue
                numbers.append(number)
                totals.append(len(starts))
                contents.append(content[first:last])
                befores.append(before)
                firsts.append(first)
                before += last - first
            offsets.append(len(numbers))
        columns = [
            pa.array(numbers, pa.int32()),
            pa.array(totals, pa.int32()),
            pa.array(contents, pa.string()),
            pa.array(befores, pa.int32()),
            pa.array(firsts, pa.int32()),
        ]
        rows = pa.StructArray.from_arrays(columns, names=[f.name for f in PIECES.elementType.fields])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)

    return pieces(text)


def window_pieces(text: Column, chunk: ChunkSettings) -> Column:
    """Fixed character windows; the last one ends with the text.

    All windows but the last have full size, so running lengths are multiples of it.
    """
    stride = chunk.size - chunk.overlap
    n = F.length(text)
    last = F.greatest(F.lit(0), F.ceil((n - F.lit(chunk.size)) / F.lit(float(stride)))).cast("int")

    def piece(i: Column) -> Column:
        return F.struct(
            i.alias("chunk_index"),
            (last + 1).alias("total_chunks"),
            F.substr(text, i * stride + 1, F.lit(chunk.size)).alias("content"),
            (i * chunk.size).alias("start_char"),
            (i * stride).alias("true_start"),
        )

    cut = F.transform(F.sequence(F.lit(0), last), piece)
    return F.filter(cut, lambda x: F.length(F.trim(x["content"])) >= chunk.min_size)


def chunk_documents(
    documents: DataFrame, chunk: ChunkSettings = ChunkSettings(), pieces=word_pieces
) -> DataFrame:
    """``documents(doc_id, url, title, content)`` to chunks.

    Chunks are numbered and counted before those under ``min_size`` are dropped.
    ``start_char``/``end_char`` run over the lengths of the kept chunks; ``true_start`` is
    the position in the collapsed content.
    """
    title = F.col("title") if "title" in documents.columns else F.lit(None).cast("string")
    url = F.col("url") if "url" in documents.columns else F.lit(None).cast("string")
    return (
        documents.select(
            F.col("doc_id").cast("string").alias("document_id"),
            title.alias("document_title"),
            url.alias("document_url"),
            apart(collapse(F.col("content"))).alias("_content"),
        )
        .withColumn("_pieces", pieces(F.col("_content"), chunk))
        # an inner inline would add a filter on the pieces that is pushed down to the scan and
        # repeats the packing and the extraction before it
        .select("document_id", "document_title", "document_url", F.inline_outer("_pieces"))
        .where(F.col("chunk_index").isNotNull())
        .select(
            F.concat_ws("_chunk_", "document_id", F.col("chunk_index").cast("string")).alias("chunk_id"),
            "document_id",
            "content",
            "start_char",
            (F.col("start_char") + F.length("content")).alias("end_char"),
            "true_start",
            "chunk_index",
            "total_chunks",
            "document_title",
            "document_url",
        )
    )
