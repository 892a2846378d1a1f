"""Repeated windows of symbol sequences (bytes or words), found from content-defined anchors.

A window of ``length`` symbols is repeated if its content also starts elsewhere. Each window names
an anchor: the ``core`` symbols within it whose hash is least. Equal windows name equal anchors
at equal offsets, so only occurrences of one anchor need comparing, about two in ``length - core``
symbols. An occurrence stands for the run of windows that name it. Occurrences whose whole run of
windows is equal are counted without looking at them one by one; what differs is compared, per
anchor, by ``resolve``. No window starts at more places than it is compared for, and nothing is
cut off: anchors with very many different surroundings are compared window by window in a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import slices, texts_of
from docweave.session import bounded, fresh_path

PIECE = 1 << 18
MANY = 2000
LARGEST = 2**63 - 1
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_FINISH = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Spec:
    """What windows are made of: ``symbols`` turns a text into an array, ``values`` symbols into 64-bit values to hash."""

    length: int
    core: int
    symbols: Callable[[str], np.ndarray]
    values: Callable[[np.ndarray], np.ndarray]
    unit: int  # bytes per symbol
    smaller_only: bool  # only windows that also start in a row with a smaller id

    @property
    def slack(self) -> int:
        return self.length - self.core + 1


def _finished(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _FINISH
    x = (x ^ (x >> np.uint64(29))) * _FINISH
    return x ^ (x >> np.uint64(32))


class Hasher:
    """Hashes of any stretch of a symbol array in constant time."""

    def __init__(self, most: int):
        inverse = pow(int(_BASE), -1, 1 << 64)
        self.up = np.multiply.accumulate(np.r_[np.uint64(1), np.full(most, _BASE)])
        self.down = np.multiply.accumulate(np.r_[np.uint64(1), np.full(most, np.uint64(inverse))])

    def of(self, values: np.ndarray) -> np.ndarray:
        return np.r_[np.uint64(0), np.cumsum(values * self.up[: len(values)], dtype="u8")]

    def stretch(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * self.down[start]


def _window_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by minima from both ends of blocks."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo("u8").max, "u8")
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def anchors(texts: list[np.ndarray], spec: Spec, hasher: Hasher) -> list[np.ndarray]:
    """Arrays ``text, at, before, after, key, run``: the anchor's place, its largest and least offset in a window that
    names it, and the hashes of the anchor and of the whole run of windows."""
    length, core, slack = spec.length, spec.core, spec.slack
    out: list[list[np.ndarray]] = []
    pieces: list[tuple[int, int, int, int, int]] = []  # text, slice start, slice end, first window, last window + 1
    for i, values in enumerate(texts):
        windows = len(values) - length + 1
        for s in range(0, max(0, windows), PIECE):
            e = min(windows, s + PIECE)
            pieces.append((i, max(0, s - 1), min(len(values), e + slack + length), s, e))
    group: list[tuple[int, int, int, int, int]] = []
    held = 0
    for piece in [*pieces, None]:
        if group and (piece is None or held + piece[2] - piece[1] > PIECE):
            out.append(_anchors_of(texts, group, spec, hasher))
            group, held = [], 0
        if piece is not None:
            group.append(piece)
            held += piece[2] - piece[1]
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, "i8")] * 4 + [np.empty(0, "u8")] * 2


def _anchors_of(texts, group, spec: Spec, hasher: Hasher) -> list[np.ndarray]:
    length, core, slack = spec.length, spec.core, spec.slack
    values = spec.values(np.concatenate([texts[i][a:b] for i, a, b, _, _ in group]))
    starts = np.cumsum([0, *(b - a for _, a, b, _, _ in group)])
    sums = hasher.of(values)
    at = np.arange(len(values) - core + 1)
    ordered = _finished(hasher.stretch(sums, at, at + core))
    place_bits = np.uint64((1 << 21) - 1)
    least = _window_least((ordered & ~place_bits) | at.astype("u8"), slack)
    chosen = (least & place_bits).astype("i8")
    p = np.concatenate([np.arange(starts[k], starts[k] + min(len(texts[i]) - length + 1, e + slack) - a) for k, (i, a, _, _, e) in enumerate(group)])
    which = np.repeat(np.arange(len(group)), [min(len(texts[i]) - length + 1, e + slack) - a for i, a, _, _, e in group])
    named = chosen[p]
    first = np.flatnonzero(np.r_[True, (named[1:] != named[:-1]) | (which[1:] != which[:-1])])
    last = np.r_[first[1:], len(p)] - 1
    p1, p2, a, k = p[first], p[last], named[first], which[first]
    shift = np.array([lo for _, lo, _, _, _ in group])[k] - starts[k]
    own = (p1 + shift >= np.array([s for _, _, _, s, _ in group])[k]) & (p1 + shift < np.array([e for _, _, _, _, e in group])[k])
    p1, p2, a, k, shift = (x[own] for x in (p1, p2, a, k, shift))
    before, after = a - p1, a - p2
    run = _finished(hasher.stretch(sums, p1, p2 + length) + _finished((before * 65536 + after).astype("u8")))
    return [np.array([i for i, _, _, _, _ in group])[k], a + shift, before, after, ordered[a], run]


def occurrences(docs: DataFrame, spec: Spec, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, h, at, before, after, key, run`` for every anchor of every text; ``h`` is the text's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(2 * PIECE + 4 * spec.length)
        for batch in slices(batches, most_bytes=1 << 20):
            text, at, before, after, key, whole = anchors([spec.symbols(t) for t in texts_of(batch, "text")], spec, hasher)
            taken = batch.select(["doc_id", "h"]).take(pa.array(text))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(at, pa.int64()), pa.array(before, pa.int32()), pa.array(after, pa.int32())]
                + [pa.array(x.view("i8"), pa.int64()) for x in (key, whole)],
                names=["doc_id", "h", "at", "before", "after", "key", "run"],
            )

    return keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, h long, at long, before int, after int, key long, run long")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, h, text``: rows that share an id are told apart by a hash of the text."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(docs[text_col]).alias("h"), docs[text_col].alias("text"))


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, in a compact form."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def same_text(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Joined on doc_id (null equals null) and h; the right side's pair is dropped."""
    right = right.withColumnRenamed("doc_id", "__doc").withColumnRenamed("h", "__h")
    return left.join(right, left["doc_id"].eqNullSafe(F.col("__doc")) & (left["h"] == F.col("__h")), how).drop("__doc", "__h")


def _one_of_each(texts: DataFrame) -> DataFrame:
    """One row per (doc_id, h): equal rows have equal surroundings.

    Only ids and hashes are counted; the texts of repeated rows meet in each task before they are
    shuffled, and all other texts stay where they are.
    """
    pair = ["doc_id", "h"]
    repeated = stored(texts.groupBy(*pair).agg(F.count("*").alias("__rows")).filter("__rows > 1").select(*pair), "repeated-rows")
    if repeated.isEmpty():
        return texts
    repeated = bounded(repeated)
    return same_text(texts, repeated, "left_anti").union(same_text(texts, repeated, "left_semi").groupBy(*pair).agg(F.min("text").alias("text")))


def _surroundings(docs: DataFrame, wanted: DataFrame, spec: Spec, id_col: str, text_col: str) -> DataFrame:
    """``wanted`` (one row per occurrence) with ``body``: the 64-bit values of its run of windows."""
    names = ["key", "run", "n", "many", "at", "before", "after"]
    listed = wanted.groupBy("doc_id", "h").agg(F.collect_list(F.struct(*names)).alias("list"))
    joined = same_text(_one_of_each(keyed(docs, id_col, text_col)), listed, "inner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most_bytes=1 << 20):
            rows: list[dict] = []
            for doc_id, text, found in zip(batch.column(0).to_pylist(), texts_of(batch, "text"), batch.column(3).to_pylist(), strict=True):
                values = spec.symbols(text)
                for r in found:
                    body = values[r["at"] - r["before"] : r["at"] - r["after"] + spec.length]
                    rows.append({"key": r["key"], "run": r["run"], "n": r["n"], "many": r["many"], "doc_id": doc_id, "before": r["before"], "after": r["after"], "body": body.tobytes()})
            yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema(
        [("key", pa.int64()), ("run", pa.int64()), ("n", pa.int64()), ("many", pa.bool_()), ("doc_id", pa.int64()), ("before", pa.int32()), ("after", pa.int32()), ("body", pa.binary())]
    )
    return joined.mapInArrow(run, "key long, run long, n long, many boolean, doc_id long, before int, after int, body binary")


def _by_windows(rows: DataFrame, spec: Spec) -> DataFrame:
    """``key, run, low, high`` for anchors with very many surroundings: all their windows, dealt by content."""

    names = ["o", "w", "key", "run", "n", "doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(4 * spec.length)
        for batch in slices(batches):
            columns: list[list[np.ndarray]] = [[] for _ in names]
            for row in batch.to_pylist():
                sums = hasher.of(spec.values(np.frombuffer(row["body"], f"u{spec.unit}")))
                start = np.arange(row["before"] - row["after"] + 1)
                hashes = _finished(hasher.stretch(sums, start, start + spec.length)).view("i8")
                doc_id = LARGEST if row["doc_id"] is None else row["doc_id"]
                same = [np.full(len(start), v, "i8") for v in (row["key"], row["run"], row["n"], doc_id)]
                for column, x in zip(columns, [row["before"] - start, hashes, *same], strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], pa.int64()) for c in columns], names=names)

    windows = rows.mapInArrow(run, ", ".join(f"{c} long" for c in names))
    same = windows.groupBy("key", "o", "w").agg(F.sum("n").alias("all"), F.min("doc_id").alias("least"))
    met = windows.join(same, ["key", "o", "w"]).filter(F.col("least") < F.col("doc_id") if spec.smaller_only else F.col("all") > 1)
    return met.groupBy("key", "run").agg(F.min("o").cast("int").alias("low"), F.max("o").cast("int").alias("high"))


def _by_anchor(rows: DataFrame, spec: Spec, order: Callable) -> DataFrame:
    """``key, run, low, high``: least and largest offset of a repeated window, where there is one."""
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def solved(table: pa.Table) -> pa.RecordBatch:
        column = lambda name: table.column(name).to_numpy()
        ids = np.array([LARGEST if i is None else i for i in table.column("doc_id").to_pylist()], "i8")
        low, high = resolve(column("key"), column("before"), column("after"), table.column("body").to_pylist(), column("n"), ids, spec, order)
        hit = np.flatnonzero(high >= 0)
        arrays = [pa.array(column("key")[hit]), pa.array(column("run")[hit]), pa.array(low[hit], pa.int32()), pa.array(high[hit], pa.int32())]
        return pa.RecordBatch.from_arrays(arrays, names=["key", "run", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in slices(batches, rows=4096):
            held.append(batch)
            if sum(b.num_rows for b in held) >= 4 * MANY:
                table = pa.Table.from_batches(held)
                keys = table.column("key").to_numpy()
                whole = int(np.searchsorted(keys, keys[-1]))  # the last anchor may go on
                if whole:
                    yield solved(table.slice(0, whole))
                held = table.slice(whole).combine_chunks().to_batches()
        if held:
            yield solved(pa.Table.from_batches(held))

    return rows.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "key long, run long, low int, high int")


def resolve(key, before, after, bodies: list[bytes], n, ids, spec: Spec, order: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest offset of a repeated window per surrounding (-1: none), comparing those of one anchor.

    ``order(parts, groups)`` sorts byte strings within groups and returns the order and the common
    prefix of each with the one before it. Right parts run from the anchor, left parts run backwards
    from it. Two surroundings share the window at offset o if their left parts agree on o symbols
    and their right parts on ``length - o``: for each o, both are numbered by classes.
    """
    size, total, kind = spec.unit, len(key), f"u{spec.unit}"
    right = [b[size * int(k) :] for b, k in zip(bodies, before, strict=True)]
    left = [np.frombuffer(b[: size * int(k)], kind)[::-1].tobytes() for b, k in zip(bodies, before, strict=True)]
    right_order, right_common = order(right, key)
    left_order, left_common = order(left, key)
    low, high = np.full(total, np.iinfo("i4").max, "i8"), np.full(total, -1, "i8")
    for o in range(int(after.min()), int(before.max()) + 1):
        active = (after <= o) & (before >= o)
        if active.sum() < 2:
            continue
        classes = np.empty((2, total), "i8")
        classes[0, right_order] = np.cumsum(right_common < size * (spec.length - o))
        classes[1, left_order] = np.cumsum(left_common < size * o)
        rows = np.flatnonzero(active)
        _, pair = np.unique(classes[0, rows] * (total + 1) + classes[1, rows], return_inverse=True)
        if spec.smaller_only:
            least = np.full(pair.max() + 1, np.iinfo("i8").max)
            np.minimum.at(least, pair, ids[rows])
            hit = rows[least[pair] < ids[rows]]
        else:
            hit = rows[np.bincount(pair, n[rows])[pair] > 1]
        low[hit], high[hit] = np.minimum(low[hit], o), o
    return low, high


def repeats(docs: DataFrame, spec: Spec, order: Callable, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, h, spans`` (start and end, in symbols, may overlap) of texts with repeated windows.

    What moves: one narrow row per anchor, twice; texts only to cut out the surroundings that need
    comparing. Hot anchors are combined before a shuffle (equal runs of windows are one row).
    """
    found = stored(occurrences(docs, spec, id_col, text_col), "anchors")
    # written first: a join of two plain exchanges is one whose hot keys Spark can split
    again = stored(found.groupBy("key").agg(F.count("*").alias("__n")).filter("__n > 1").select("key"), "repeated-keys")
    live = stored(found.join(again, "key", "left_semi"), "repeated-anchors")
    last = F.col("doc_id").isNull()
    place = F.struct(last.alias("last"), *[F.col(c) for c in ("doc_id", "h", "at", "before", "after")])
    runs = stored(live.groupBy("key", "run").agg(F.count("*").alias("n"), F.min(place).alias("first")), "runs")
    mixed = stored(runs.groupBy("key").agg(F.count("*").alias("__runs")).filter("__runs > 1"), "mixed-keys")
    wanted = runs.join(mixed, "key").select("key", "run", "n", (F.col("__runs") > MANY).alias("many"), "first.*").drop("last")
    around = stored(_surroundings(docs, wanted, spec, id_col, text_col), "surroundings")
    partly = _by_anchor(around.filter("not many"), spec, order).union(_by_windows(around.filter("many"), spec))
    partly = stored(partly, "resolved")
    first = runs.select("key", "run", F.col("first.doc_id").alias("__first"), F.col("first.last").alias("__last"), "n")
    if spec.smaller_only:
        whole = live.join(first.filter("n > 1"), ["key", "run"]).filter((last & ~F.col("__last")) | (F.col("doc_id") > F.col("__first")))
        rest = live.join(partly, ["key", "run"]).join(first.drop("n"), ["key", "run"]).filter(F.col("doc_id").eqNullSafe(F.col("__first")))
    else:
        whole = live.join(first.filter("n > 1").select("key", "run"), ["key", "run"])
        rest = live.join(partly, ["key", "run"])
    marks = whole.select("doc_id", "h", (F.col("at") - F.col("before")).alias("s"), (F.col("at") - F.col("after") + spec.length).alias("e")).union(
        rest.select("doc_id", "h", (F.col("at") - F.col("high")).alias("s"), (F.col("at") - F.col("low") + spec.length).alias("e"))
    )
    return marks.groupBy("doc_id", "h").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def united(spans: list[dict]) -> list[tuple[int, int]]:
    """Sorted spans, with those that touch or overlap made one."""
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]
