"""Token ids of documents in files that can be read document by document.

A file is a run of independent zstandard frames, each holding ``FRAME_IDS`` ids (little-endian
unsigned 32-bit, the last frame fewer) of one continuous id stream; then a skippable frame with the
document index (ids and id counts, compressed); then the seek table of the public zstandard
seekable format, a skippable frame with each frame's sizes and a checksum of its content (low 32
bits of XXH64). A reader takes the seek table and the index from the end of the file, and
decompresses only the frames that the requested documents lie in. Any zstandard tool reads the id
stream from the front.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain, islice, pairwise
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docweave.llm.common import hand_back, slices, texts_of
from docweave.session import cut_lineage, fresh_path

FRAME_IDS = 1 << 16
END_ID = 0
CACHE_PIECES = 300_000
#: Longer pieces are not remembered: a count of pieces bounds no bytes else.
CACHED_LETTERS = 256

# Fixed values of the zstandard skippable frame and seekable formats.
INDEX_MAGIC = 0x184D2A50
SEEK_MAGIC = 0x184D2A5E
SEEK_FOOTER_MAGIC = 0x8F92EAB1
CHECKSUMS = 0x80

#: A blank before a non-blank always starts a new piece of a byte-level tokenizer's split.
_CUT = re.compile(r"(?= \S)")
_NOT_PLAIN = re.compile(r" (?:\s|\Z)")
#: Letters, a mark or none, and perhaps a line break and the same again.
_MARKED = re.compile(r"([^\W\d_]+)([.,]?)(?:\n([^\W\d_]+)([.,]?))?")
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: Byte-level vocabularies write a byte that is not printable as the next letter from 256 on.
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_BLANK = chr(_BYTE_LETTERS[0x20])


class Encoder:
    """Ids of texts through a ``tokenizers`` vocabulary whose split is byte-level.

    Such a vocabulary never merges across the start of a blank-led word, nor between letters and the
    full stop, comma or single line break after them, so a text's ids are those of its pieces in
    order. Ids of pieces are remembered in two generations of ``most`` pieces, and what a single
    call adds; only new ones go through the tokenizer.
    """

    def __init__(self, vocabulary: str, most: int = CACHE_PIECES):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.most = most
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}  # by what follows the blank
        self.older: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}  # without a blank

    @staticmethod
    def of(vocabulary: str, most: int) -> Encoder:
        """The encoder of this process: Python workers serve many tasks."""
        import tokenizers

        kept = vars(tokenizers).setdefault("docweave_encoders", {})
        if (vocabulary, most) not in kept:
            kept.clear()
            kept[vocabulary, most] = Encoder(vocabulary, most)
        return kept[vocabulary, most]

    def forget(self) -> None:
        """Drops the remembered pieces, and hands free memory back to the system.

        The tokenizer stays: one that is read anew for every task leaves some 6 MB behind each time.
        """
        import gc

        self.known, self.older, self.bare = {}, {}, {}
        gc.collect()
        hand_back()

    def pieces(self, text: str) -> list[str]:
        """The first piece, then the blank-led ones without their blank."""
        if _NOT_PLAIN.search(text):
            first, *rest = _CUT.split(text)
            return [first, *(p[1:] for p in rest)]
        return text.split(" ")

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(f.ids, "<u4").tobytes() for f in found]

    def _units(self, units: list[str]) -> list[bytes]:
        """Ids of units of the split (letters with or without a blank, one mark), straight from the merges."""
        tokenize, found = self.model.tokenize, []
        for unit in units:
            if not unit.isascii() or unit[0] == "\n":
                unit = unit.encode().decode("latin-1").translate(_BYTE_LETTERS)
            elif unit[0] == " ":
                unit = _BLANK + unit[1:]
            found.append([token.id for token in tokenize(unit)])
        flat = np.fromiter(chain.from_iterable(found), "<u4").tobytes()
        ends = list(accumulate((4 * len(ids) for ids in found), initial=0))
        return [flat[start:end] for start, end in pairwise(ends)]

    def _learn(self, new: list[str]) -> None:
        """Adds blank-led pieces: words with marks by their units, anything else whole."""
        known, bare, words, marked, whole = self.known, self.bare, [], [], []
        if len(bare) > self.most:
            bare.clear()
        for piece in new:
            if piece.isalpha():
                words.append(piece)
            elif len(piece) <= CACHED_LETTERS and (match := _MARKED.fullmatch(piece)) and match[1].isalpha() and (not match[3] or match[3].isalpha()):
                marked.append((piece, match[1], [part for part in (match[2], match[3] and "\n", match[3], match[4]) if part]))
            else:
                whole.append(piece)
        words += {word for _, word, _ in marked}.difference(known, words)
        known.update(zip(words, self._units([" " + w for w in words]), strict=True))
        parts = list({part for *_, parts in marked for part in parts if part not in bare})
        bare.update(zip(parts, self._units(parts), strict=True))
        for piece, word, parts in marked:
            known[piece] = b"".join([known[word], *map(bare.__getitem__, parts)])
        known.update(zip(whole, self._ids([" " + p for p in whole]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.pieces(t) for t in texts]
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        known, older, new = self.known, self.older, []
        for piece in set().union(*split).difference(known):
            if (ids := older.get(piece)) is None:
                new.append(piece)
            else:
                known[piece] = ids
        self._learn(new)
        firsts, end, of = self._ids([p[0] for p in split]), struct.pack("<I", END_ID), known.__getitem__
        found = [b"".join([first, *map(of, islice(p, 1, None)), end]) for first, p in zip(firsts, split, strict=True)]
        for piece in new:
            if len(piece) > CACHED_LETTERS:
                del known[piece]
        return found


class FrameWriter:
    """Writes one file to a binary handle; ``close`` adds the index and the seek table."""

    def __init__(self, out: BinaryIO, frame_ids: int = FRAME_IDS, level: int = 1):
        import xxhash
        import zstandard

        self.out, self.size = out, 4 * frame_ids
        self.compress = zstandard.ZstdCompressor(level=level, write_content_size=True).compress
        self.digest = lambda data: xxhash.xxh64_intdigest(data) & 0xFFFFFFFF
        self.rest, self.frames = bytearray(), []
        self.doc_ids: list[int | None] = []
        self.counts: list[int] = []

    def _frame(self, data: bytes) -> None:
        packed = self.compress(data)
        self.out.write(packed)
        self.frames.append((len(packed), len(data), self.digest(data)))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.rest += ids
        if len(self.rest) >= self.size:
            whole = len(self.rest) // self.size * self.size
            for at in range(0, whole, self.size):
                self._frame(bytes(self.rest[at : at + self.size]))
            del self.rest[:whole]

    def close(self) -> None:
        if self.rest:
            self._frame(bytes(self.rest))
            self.rest.clear()
        known = np.array([i is not None for i in self.doc_ids], "u1")
        values = np.array([i or 0 for i in self.doc_ids], "<i8")
        index = struct.pack("<Q", len(values)) + known.tobytes() + values.tobytes() + np.array(self.counts, "<u8").tobytes()
        packed = self.compress(index)
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(packed)) + packed)
        self.frames.append((len(packed) + 8, 0, self.digest(index)))
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEK_FOOTER_MAGIC)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(table)) + table)


class FrameReader:
    """Reads one file from a seekable handle; ``touched`` counts the frames decompressed."""

    def __init__(self, source: BinaryIO, size: int):
        import xxhash
        import zstandard

        self.source, self.touched = source, 0
        self.expand = zstandard.ZstdDecompressor().decompress
        self.digest = lambda data: xxhash.xxh64_intdigest(data) & 0xFFFFFFFF
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_FOOTER_MAGIC or flags != CHECKSUMS:
            raise ValueError("not a seekable file with checksums")
        self.table = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype("i8")
        self.offsets = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        self.stream = np.concatenate([[0], np.cumsum(self.table[:, 1])])
        index = self._checked(self.expand(self._at(int(self.offsets[-2]) + 8, int(self.table[-1, 0]) - 8)), n - 1)
        (docs,) = struct.unpack_from("<Q", index)
        known = np.frombuffer(index, "u1", docs, 8)
        values = np.frombuffer(index, "<i8", docs, 8 + docs)
        self.doc_ids = [int(v) if k else None for k, v in zip(known, values, strict=True)]
        self.counts = np.frombuffer(index, "<u8", docs, 8 + 9 * docs).astype("i8")
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def _checked(self, data: bytes, frame: int) -> bytes:
        if self.digest(data) != self.table[frame, 2]:
            raise ValueError(f"checksum of frame {frame} does not match")
        return data

    def frame(self, k: int) -> bytes:
        self.touched += 1
        return self._checked(self.expand(self._at(int(self.offsets[k]), int(self.table[k, 0]))), k)

    def documents(self, wanted: set[int | None] | None = None) -> Iterator[tuple[int | None, int, list[bytes]]]:
        """(document id, first id's place in this file, its ids in parts) of the wanted documents, or all."""
        held, data = -1, b""
        for i, doc_id in enumerate(self.doc_ids):
            if wanted is not None and doc_id not in wanted:
                continue
            start, end, parts = 4 * int(self.starts[i]), 4 * int(self.starts[i + 1]), []
            while start < end:
                k = int(np.searchsorted(self.stream, start, "right")) - 1
                if k != held:
                    held, data = k, self.frame(k)
                at = start - int(self.stream[k])
                parts.append(data[at : at + end - start])
                start += len(parts[-1])
            yield doc_id, int(self.starts[i]), parts


def write_tokens(
    docs: DataFrame,
    vocabulary: str,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    frame_ids: int = FRAME_IDS,
    cache_pieces: int = CACHE_PIECES,
    keep_cache: bool = False,
) -> DataFrame:
    """Writes ``docs`` as token files, ascending by id, and returns the manifest.

    The manifest has one row per file: ``part, path, n_docs, n_tokens, start`` (ids before it). It is
    checkpointed once the files are written: a retried task writes another file, and only the files
    of tasks that succeeded are named. Rows are dealt by ranges of (id, text hash), so repeated ids
    spread as well. Null texts count as empty (just the end id); null ids come first; an empty table
    writes no file; other columns are not read. ``folder`` must be reachable by all executors.
    ``cache_pieces`` bounds what a Python worker remembers, about 200 bytes a piece, twice, and what a
    batch adds. Unless ``keep_cache`` is true it is dropped with the task, as workers serve other
    tasks and stages too; the vocabulary stays.
    """
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    rows = rows.withColumn("__h", F.xxhash64("text"))
    rows = rows.repartitionByRange(n, "doc_id", "__h").sortWithinPartitions("doc_id", "__h").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gc
        import uuid

        from pyarrow import fs
        from pyspark import TaskContext

        gc.disable()  # millions of small strings, no cycles: the collector only costs time
        encoder = writer = out = None
        try:
            part = TaskContext.get().partitionId()
            place, root = fs.FileSystem.from_uri(folder)
            path = f"part-{part:06d}-{uuid.uuid4().hex}.zst"
            for batch in slices(batches, rows=2048, most_bytes=1 << 23):
                if writer is None and batch.num_rows:
                    place.create_dir(root, recursive=True)
                    out = place.open_output_stream(f"{root}/{path}", compression=None)
                    writer, encoder = FrameWriter(out, frame_ids), Encoder.of(vocabulary, cache_pieces)
                if writer is not None:
                    for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts_of(batch)), strict=True):
                        writer.add(doc_id, ids)
            if writer is not None:
                writer.close()
                out.close()
                row = {"part": [part], "path": [path], "n_docs": [len(writer.counts)], "n_tokens": [sum(writer.counts)]}
                yield pa.RecordBatch.from_pydict(row)
        finally:
            gc.enable()
            if encoder is not None and not keep_cache:
                encoder.forget()

    manifest = cut_lineage(rows.mapInArrow(run, "part long, path string, n_docs long, n_tokens long"))
    # one row per file: as many rows as the exchange has partitions
    start = F.coalesce(F.sum("n_tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return manifest.withColumn("start", start)


def read_tokens(manifest: DataFrame, folder: str, wanted: Iterable[int] | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (binary) of the wanted documents, or all, from the files."""
    chosen = None if wanted is None else set(wanted)
    return _scan(manifest, folder, chosen, "doc_id long, start long, n_tokens long, ids binary", lambda parts: b"".join(parts), pa.binary())


def token_digests(manifest: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of all documents, from the files."""

    def crc(parts: list[bytes]) -> int:
        total = 0
        for part in parts:
            total = zlib.crc32(part, total)
        return total

    return _scan(manifest, folder, None, "doc_id long, start long, n_tokens long, ids_crc32 long", crc, pa.int64())


def _scan(manifest: DataFrame, folder: str, wanted, schema: str, value, kind: pa.DataType) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        place, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with place.open_input_file(f"{root}/{row['path']}") as source:
                    reader, rows, held = FrameReader(source, source.size()), [[], [], [], []], 0
                    for doc_id, at, parts in reader.documents(wanted):
                        size = sum(map(len, parts))
                        held += size
                        for column, v in zip(rows, (doc_id, row["start"] + at, size // 4, value(parts)), strict=True):
                            column.append(v)
                        if held > 1 << 24:
                            yield batch_of(rows)
                            rows, held = [[], [], [], []], 0
                    yield batch_of(rows)

    def batch_of(rows: list[list]) -> pa.RecordBatch:
        names = [c.split()[0] for c in schema.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), kind]
        return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names=names)

    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("path", "start").repartition(n).mapInArrow(run, schema)


def token_folder(spark: SparkSession) -> str:
    """A new folder for token files under the cluster's shared folder."""
    return fresh_path(spark, "tokens")
