"""Byte-level BPE with a public rank file: texts to ids and back, contracted by DuckDB inside each task.

A text is split by the vocabulary's pattern. A piece that is a token has that id. Other pieces of a
slice of texts become one table of token positions, a row per byte, and a recursive query joins
neighbours with the merge table and contracts each piece's leftmost pair of least rank, until no
piece has a pair left. In a long piece all places of that pair are contracted in one turn, left to
right, unless the token made takes part in a pair of lower rank: that comes to the same. Ids are
turned back into bytes by a join with the vocabulary and an aggregation in order of position.

Spark deals the rows out; DuckDB works in memory, on one thread, on slices of bounded size. Texts are
cut before blanks, where no piece goes on, and the ids of such chunks are remembered between slices in
two bounded generations, so that only new ones are split and contracted. A piece of n bytes takes up
to n turns of n places at worst; that is felt from some ten thousand bytes without a blank or mark on.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docweave.llm.common import slices, texts_of

#: Pieces and chunks remembered per generation.
KNOWN_PIECES = 250_000
#: Chunks of texts encoded together, bytes of new pieces contracted by one query, ids decoded by one query.
SLICE_CHUNKS = 1 << 19
SLICE_BYTES = 1 << 19
SLICE_IDS = 1 << 18
#: Pieces with more bytes are contracted in a table that keeps the present state only, not that of all turns.
LONG_PIECE = 256

_CUT = re.compile(r"(?= \S)")
_NOT_PLAIN = re.compile(r" (?:\s|\Z)")

# A place knows its neighbour on the right. Each turn joins places with the merge table, takes each
# piece's pair of least rank, leftmost first, and writes the places of the pieces that had one anew.
_CONTRACT = """
WITH RECURSIVE parts AS (
  SELECT w, pos, tok, lead(tok) OVER s AS nxt, lead(pos) OVER s AS nxt_pos, 0 AS turn FROM places WINDOW s AS (PARTITION BY w ORDER BY pos)
  UNION ALL
  SELECT p.w, p.pos, CASE WHEN p.pos = h.pos THEN h.made ELSE p.tok END,
         CASE WHEN p.pos = h.pos THEN h.after WHEN p.nxt_pos = h.pos THEN h.made ELSE p.nxt END,
         CASE WHEN p.pos = h.pos THEN h.after_pos ELSE p.nxt_pos END, p.turn + 1
  FROM parts p
  JOIN (SELECT f.w, f.least >> 32 AS made, f.least & 4294967295 AS pos, f.taken, r.nxt AS after, r.nxt_pos AS after_pos
        FROM (SELECT l.w, min(m.made << 32 | l.pos) AS least, arg_min(l.nxt_pos, m.made << 32 | l.pos) AS taken
              FROM parts l JOIN merges m ON m.a = l.tok AND m.b = l.nxt GROUP BY l.w) f
        JOIN parts r ON r.pos = f.taken) h ON h.w = p.w
  WHERE p.pos <> h.taken)
SELECT w, tok FROM (SELECT w, max(turn) AS turn FROM parts GROUP BY w) JOIN parts USING (w, turn) ORDER BY pos
"""

# For one long piece: of equal pairs that stand side by side every other one is contracted, from the
# left, and only the present state is kept; a place whose token was taken into another stays as a null.
_CONTRACT_LONG = """
WITH RECURSIVE parts(w, pos, tok) USING KEY (w, pos) AS (
  SELECT w, pos, tok FROM places
  UNION
  SELECT w, pos, CASE WHEN hit THEN made END
  FROM (SELECT w, pos, made, hit, lag(hit) OVER (ORDER BY pos) AS eaten
        FROM (SELECT w, pos, made, coalesce(made = least, false)
                     AND CASE WHEN alone THEN pos = min(CASE WHEN made = least THEN pos END) OVER ()
                         ELSE (i - min(i) OVER (PARTITION BY run)) % 2 = 0 END AS hit
              FROM (SELECT *, CASE WHEN made = least THEN i - row_number() OVER (PARTITION BY made IS NOT DISTINCT FROM least ORDER BY pos) ELSE -1 END AS run
                    FROM (SELECT p.*, m.made, m.alone, min(m.made) OVER () AS least
                          FROM (SELECT w, pos, tok, lead(tok) OVER (ORDER BY pos) AS nxt, row_number() OVER (ORDER BY pos) AS i
                                FROM recurring.parts WHERE tok IS NOT NULL) p
                          LEFT JOIN merges m ON p.tok = m.a AND p.nxt = m.b)
                    WHERE least IS NOT NULL)))
  WHERE hit OR eaten)
SELECT w, tok FROM parts WHERE tok IS NOT NULL ORDER BY pos
"""

_DECODE = """
SELECT doc, string_agg(letters, '') AS letters FROM (SELECT doc, letters FROM ids JOIN vocabulary USING (id) ORDER BY pos) GROUP BY doc
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks from a file of base64 tokens and numbers."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def chunks_of(text: str) -> list[str]:
    """The text in stretches that start at a blank before something else: no piece lies across such a place."""
    if _NOT_PLAIN.search(text):
        return _CUT.split(text)
    first, *rest = text.split(" ")
    return [first, *(" " + part for part in rest)]


class Coder:
    """Ids of texts, and bytes of ids, under one rank file and pattern."""

    _kept: dict[tuple, Coder] = {}

    def __init__(self, path: str, pattern: str, known_pieces: int = KNOWN_PIECES):
        import duckdb
        import regex

        self.ranks = read_ranks(path)
        self.pattern = regex.compile(pattern)
        self.most = known_pieces
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}  # of pieces, the chunks' parts
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], "i4")
        # nothing may go to a folder of this machine
        self.db = duckdb.connect(config={"threads": 1, "temp_directory": ""})
        ranks = self.ranks
        merges = [(a, b, made) for token, made in ranks.items() for k in range(1, len(token)) if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None]
        # tokens that take part in a pair of lower rank than their own
        early = {x for a, b, made in merges for x in (a, b) if made < x}
        a, b, made = (pa.array(column, pa.int32()) for column in zip(*merges, strict=True)) if merges else (pa.array([], pa.int32()),) * 3
        alone = pa.array([m in early for _, _, m in merges], pa.bool_())
        self._table("merges", pa.table({"a": a, "b": b, "made": made.cast(pa.int64()), "alone": alone}))
        # a byte as a letter from 256 on: text without nulls, of which UTF-16 gives the bytes back
        letters = pa.array(["".join(chr(256 + x) for x in token) for token in ranks], pa.string())
        self._table("vocabulary", pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "letters": letters}))

    @classmethod
    def of(cls, path: str, pattern: str, known_pieces: int) -> Coder:
        """The coder of this process: Python workers serve many tasks."""
        key = (path, pattern, known_pieces)
        if key not in cls._kept:
            cls._kept.clear()
            cls._kept[key] = cls(*key)
        return cls._kept[key]

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("given", rows)
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _contract(self, pieces: list[bytes], query: str) -> list[bytes]:
        """Ids of pieces, as little-endian unsigned 32-bit integers."""
        sizes = np.array([len(p) for p in pieces])
        starts = np.r_[0, np.cumsum(sizes)]
        places = {
            "w": np.repeat(np.arange(len(pieces), dtype="i4"), sizes),
            "pos": np.arange(starts[-1]),
            "tok": self.of_byte[np.frombuffer(b"".join(pieces), "u1")],
        }
        self._table("places", pa.table(places))
        found = self.db.sql(query).to_arrow_table()
        ends = np.searchsorted(found.column(0).to_numpy(), np.arange(len(pieces) + 1)) * 4
        ids = found.column(1).to_numpy().astype("<u4").tobytes()
        return [ids[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]

    def _learn(self, chunks: list[str]) -> None:
        """Adds the ids of chunks to what is known."""
        split = [self.pattern.findall(c) for c in chunks]
        parts = self.parts
        if len(parts) > self.most:
            parts.clear()
        short: list[tuple[str, bytes]] = []
        held = 0
        for piece in set(chain.from_iterable(split)).difference(parts):
            data = piece.encode()
            if (token := self.ranks.get(data)) is not None:
                parts[piece] = token.to_bytes(4, "little")
            elif len(data) > LONG_PIECE:
                (parts[piece],) = self._contract([data], _CONTRACT_LONG)
            else:
                short.append((piece, data))
                held += len(data)
                if held > SLICE_BYTES:
                    self._learn_short(short)
                    short, held = [], 0
        if short:
            self._learn_short(short)
        self.known.update(zip(chunks, (b"".join(map(parts.__getitem__, pieces)) for pieces in split), strict=True))

    def _learn_short(self, short: list[tuple[str, bytes]]) -> None:
        self.parts.update(zip([p for p, _ in short], self._contract([d for _, d in short], _CONTRACT), strict=True))

    def _ids(self, split: list[list[str]]) -> list[bytes]:
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        known, older, new = self.known, self.older, []
        for chunk in set(chain.from_iterable(split)).difference(known):
            if chunk in older:
                known[chunk] = older[chunk]
            else:
                new.append(chunk)
        if new:
            self._learn(new)
        return [b"".join(map(known.__getitem__, chunks)) for chunks in split]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text its ids, as little-endian unsigned 32-bit integers."""
        found = [b""] * len(texts)
        split = [chunks_of(t) for t in texts]
        for first, stop, start, end in _runs([len(c) for c in split], SLICE_CHUNKS):
            part = [split[first][start:end]] if end else split[first:stop]
            for i, ids in enumerate(self._ids(part), first):
                found[i] += ids
        return found

    def decode(self, coded: list[bytes]) -> list[bytes]:
        """Per id sequence the bytes of its tokens."""
        found: list[list[bytes]] = [[] for _ in coded]
        for first, stop, start, end in _runs([len(c) // 4 for c in coded], SLICE_IDS):
            part = [coded[first][4 * start : 4 * end]] if end else coded[first:stop]
            sizes = [len(c) // 4 for c in part]
            ids = np.frombuffer(b"".join(part), "<u4").astype("i4")
            rows = pa.table({"doc": np.repeat(np.arange(first, stop, dtype="i4"), sizes), "pos": np.arange(len(ids), dtype="i4"), "id": ids})
            self.db.register("ids", rows)
            answer = self.db.sql(_DECODE).to_arrow_table()
            self.db.unregister("ids")
            for doc, letters in zip(answer.column(0).to_pylist(), answer.column(1).to_pylist(), strict=True):
                found[doc].append(letters.encode("utf-16-le")[::2])
        return [b"".join(parts) for parts in found]


def _runs(sizes: list[int], most: int) -> Iterator[tuple[int, int, int, int]]:
    """Neighbouring sequences of at most ``most`` entries together as (first, stop, 0, 0), or a part of a longer one as (i, i + 1, start, end)."""
    first = held = 0
    for i, n in enumerate(sizes):
        if held + n > most and i > first:
            yield first, i, 0, 0
            first, held = i, 0
        if n > most:
            yield from ((i, i + 1, at, min(at + most, n)) for at in range(0, n, most))
            first, held = i + 1, 0
        else:
            held += n
    if first < len(sizes):
        yield first, len(sizes), 0, 0


def encode(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", known_pieces: int = KNOWN_PIECES) -> DataFrame:
    """``doc_id, ids`` per row: the ids of the whole text, in order.

    A null or empty text has no ids; rows with null or repeated ids are answered each; a very long
    text is split and contracted part by part; an empty table gives an empty one; other columns are
    not read. ``path`` is a rank file that every executor has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(path, pattern, known_pieces)
        for batch in slices(batches):
            coded = coder.encode(texts_of(batch))
            offsets = pa.array(np.cumsum([0, *(len(c) // 4 for c in coded)]), pa.int32())
            ids = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(coded), "<u4").astype("i4"), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids", known_pieces: int = KNOWN_PIECES) -> DataFrame:
    """``doc_id, decoded`` (binary) per row of ids; null or no ids give no bytes, an id without a token fails the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(path, pattern, known_pieces)
        tokens = set(coder.ranks.values())
        for batch in slices(batches):
            lists = [ids or [] for ids in batch.column(1).to_pylist()]
            if not tokens.issuperset(chain.from_iterable(lists)):
                raise ValueError("an id has no token in the vocabulary")
            found = coder.decode([np.array(ids, "<u4").tobytes() for ids in lists])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["doc_id", "decoded"])

    return rows.select(rows[id_col].cast("long").alias("doc_id"), rows[ids_col].alias("ids")).mapInArrow(run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", known_pieces: int = KNOWN_PIECES) -> DataFrame:
    """``doc_id, ids, decoded`` per row: ids as little-endian unsigned 32-bit integers (binary), and the bytes they decode to.

    As :func:`encode` followed by :func:`decode`, in one pass over the rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(path, pattern, known_pieces)
        for batch in slices(batches):
            coded = coder.encode(texts_of(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(coded, pa.binary()), pa.array(coder.decode(coded), pa.binary())], names=["doc_id", "ids", "decoded"]
            )

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, decoded binary")
