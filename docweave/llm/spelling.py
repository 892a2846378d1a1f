"""Spelling variants: words one edit apart, found by dense tiles of padded code-point matrices.

Of two words one inserted, deleted or replaced code point apart, the common prefix and the common
suffix together reach the longer length less one. So one of the two reaches half of that, and words
are dealt out by their first and by their last half, once for either length of the longer word. In
a group the words fill two matrices of code points, padded to the left and to the right, and blocks
of rows are compared with each other densely. A tile answers with one row per word: how many near
words it met, and the most frequent of them. Pairs are never written. Groups of many words are dealt
out as pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.session import bounded, cut_lineage

RUN = r"[A-Za-zÀ-ÿ]+"
LEAST_LENGTH = 6
LEAST_COUNT = 5
FORM_RATIO = 5
DAMAGED_EVERY = 199
#: Words of a block; a group of more is dealt out as pairs of blocks.
BLOCK = 256
#: Cells of one dense comparison.
CELLS = 1 << 22
_UPPER = "".join(map(chr, range(65, 91)))


def _run_words(docs: DataFrame, id_col: str, text_col: str, damaged_every: int | None, least_length: int) -> DataFrame:
    rows = docs.select(F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(docs[text_col], F.lit(RUN), F.lit(0))).alias("run"))
    run = F.col("run")
    lowered = F.when(run.rlike("[A-Z]"), F.translate(run, _UPPER, _UPPER.lower())).otherwise(run)
    # a run that is too short stays so; one stage by itself, so that the checksum is taken once
    rows = rows.filter(F.length("run") >= least_length).select("id", lowered.alias("run"))
    if damaged_every is None:
        return rows.select(F.col("run").alias("word"))
    checksum = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    rows = rows.select("run", checksum.alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return rows.select(F.when(F.col("h") % damaged_every == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    damaged_every: int | None = DAMAGED_EVERY,
) -> DataFrame:
    """``word, n``: letter runs of all texts, A-Z in lower case, of enough code points and occurrences.

    Where the crc32 of ``id:run`` divides by ``damaged_every`` one code point is taken out (None: nowhere).
    Null texts have no words; a null id counts as empty text.
    """
    words = _run_words(docs, id_col, text_col, damaged_every, least_length)
    counted = words.groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter((F.col("n") >= least_count) & (F.length("word") >= least_length))


def _dealt(words: DataFrame, block: int) -> DataFrame:
    """Rows ``longer, side, key, low, high, block, word, n``: each word in the groups of its halves, for either length of the longer word."""
    length = F.length("word")
    half = F.col("longer").bitwiseAND(-2) / 2  # of the longer length less one, rounded up
    each = words.select("word", "n", F.explode(F.array(length, length + 1)).alias("longer")).withColumn("half", half.cast("int"))
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.substring("word", F.lit(1), F.col("half")).alias("key")),
        F.struct(F.lit(1).alias("side"), F.substring("word", length - F.col("half") + 1, F.col("half")).alias("key")),
    )
    rows = each.select("word", "n", "longer", F.explode(sides).alias("s")).select("longer", "s.side", "s.key", "word", "n")
    group = ["longer", "side", "key"]
    large = rows.groupBy(*group).agg(F.count("*").alias("held")).filter(F.col("held") > block)
    rows = rows.join(bounded(large), group, "left")
    blocks = F.ceil(F.coalesce(F.col("held"), F.lit(1)) / block).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.select(*group, "block", "word", "n", other.alias("other"))
    return rows.select(*group, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "word", "n")


def matrices(words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of Latin-1 words, padded on the right and padded on the left."""
    left = np.zeros((len(words), width), "u1")
    right = np.zeros((len(words), width), "u1")
    sizes = np.array([len(w) for w in words])
    flat = np.frombuffer(b"".join(words), "u1")
    row = np.repeat(np.arange(len(words)), sizes)
    col = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left[row, col] = flat
    right[row, width - np.repeat(sizes, sizes) + col] = flat
    return left, right


def tile(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of common prefixes and of common suffixes of all rows of one block with all of another."""
    prefix, suffix = a[0][:, None, :] == b[0][None, :, :], (a[1][:, None, :] == b[1][None, :, :])[:, :, ::-1]
    width = prefix.shape[2]
    return tuple(np.where(same.all(axis=2), width, same.argmin(axis=2)) for same in (prefix, suffix))


def near_in_group(words: list[bytes], counts: np.ndarray, group: np.ndarray, block: np.ndarray, longer: int, side: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Near words of the rows of whole groups (neighbouring rows, one length of the longer word): per row the number of them, and the place of the best or -1.

    The best has the largest count, then comes first in code-point order.
    """
    n = len(words)
    found, best = np.zeros(n, "i8"), np.full(n, -1)
    order = sorted(range(n), key=lambda i: (-counts[i], words[i]))
    rank = np.empty(n, "i8")
    rank[order] = np.arange(n)
    order = np.array(order)
    least = np.full(n, n)
    sizes = np.array([len(w) for w in words])
    both = matrices(words, longer)
    step = max(1, min(BLOCK, int((CELLS / max(1, longer)) ** 0.5)))
    starts = range(0, n, step)
    for x in starts:
        for y in starts:
            # groups are neighbours: blocks past the last group of this one have none of its rows
            if y < x or group[y] > group[min(x + step, n) - 1]:
                continue
            p, q = slice(x, x + step), slice(y, y + step)
            prefix, suffix = tile(tuple(m[p] for m in both), tuple(m[q] for m in both))
            near = (prefix + suffix >= longer - 1) & (group[p, None] == group[None, q])
            near &= np.maximum(sizes[p, None], sizes[None, q]) == longer
            # what shares its first half was met there
            near &= (side[p, None] == 0) | (prefix < longer // 2)
            # in a tile of two blocks only rows of different blocks meet
            near &= (low == high)[p, None] | (block[p, None] != block[None, q])
            i, j = np.nonzero(near)
            i, j = i + x, j + y
            apart = i < j if x == y else np.ones(len(i), bool)
            i, j = i[apart], j[apart]
            np.add.at(found, i, 1)
            np.add.at(found, j, 1)
            np.minimum.at(least, i, rank[j])
            np.minimum.at(least, j, rank[i])
    has = least < n
    best[has] = order[least[has]]
    return found, best


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """``word, n_near, best_n, best`` per word with a near word: how many, and the most frequent (ties: first in code-point order).

    ``words`` has distinct ``word`` of code points up to 255 and of three letters or more, and their counts ``n``.
    """
    group = ["longer", "side", "key", "low", "high"]
    n = max(1, int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = _dealt(words, block).repartition(n, *group).sortWithinPartitions(*group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(rows: pa.Table, group: np.ndarray) -> pa.RecordBatch:
            longer, side, low, high, at, counts = (rows.column(c).to_numpy() for c in ("longer", "side", "low", "high", "block", "n"))
            words = [w.encode("latin-1") for w in rows.column("word").to_pylist()]
            found, best = np.zeros(len(words), "i8"), np.full(len(words), -1)
            cuts = np.r_[0, np.flatnonzero(longer[1:] != longer[:-1]) + 1, len(words)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                s = slice(x, y)
                met, first = near_in_group(words[s], counts[s], group[s], at[s], int(longer[x]), side[s], low[s], high[s])
                found[s], best[s] = met, np.where(first < 0, -1, first + x)
            has = np.flatnonzero(found)
            return pa.RecordBatch.from_arrays(
                [rows.column("word").combine_chunks().take(pa.array(has)), pa.array(found[has]), pa.array(counts[best[has]]), pa.array([words[b].decode("latin-1") for b in best[has]], pa.string())],
                names=["word", "n_near", "best_n", "best"],
            )

        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if held.num_rows > 1 << 13:
                ids = _group_ids(held)
                whole = int(np.searchsorted(ids, ids[-1]))  # the last group may go on
                if whole:
                    yield solved(held.slice(0, whole), ids[:whole])
                    held = held.slice(whole)
        if held is not None and held.num_rows:
            yield solved(held, _group_ids(held))

    met = rows.mapInArrow(run, "word string, n_near long, best_n long, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("first")
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), first).select("word", "n_near", (-F.col("first.less")).alias("best_n"), F.col("first.best").alias("best"))


def _group_ids(rows: pa.Table) -> np.ndarray:
    """Numbers of the runs of rows of one group."""
    new = np.zeros(rows.num_rows, bool)
    for name in ("longer", "side", "key", "low", "high"):
        column = rows.column(name).combine_chunks()
        values = np.array(column.to_pylist(), object) if name == "key" else column.to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.cumsum(new)


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``word, form``: where following forms ends.

    A form has ``FORM_RATIO`` times its word's count, so fewer than 32 steps end every way (5 to the
    power of 27 passes 64 bits) and five doublings of the step reach it.
    """
    steps = cut_lineage(forms.select("word", F.col("form").alias("root")))
    for _ in range(5):
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if steps.join(ahead, "root", "left_semi").isEmpty():
            break
        steps = cut_lineage(steps.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return steps


def variants(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    damaged_every: int | None = DAMAGED_EVERY,
    block: int = BLOCK,
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` per word of the vocabulary of all texts.

    ``form`` is the near word (one code point inserted, deleted or replaced) of largest count, ties by
    code-point order, if it has ``FORM_RATIO`` times the word's count; ``root`` follows forms to the
    end. Words are letter runs of code points up to 255. Null and empty texts have no words, repeated
    rows count each, a null id counts as empty text, an empty table gives an empty one, long words are
    compared whole, and other columns are not read.
    """
    if least_length < 4:
        raise ValueError("halves of shorter words don't tell them apart")
    words = cut_lineage(vocabulary(docs, id_col=id_col, text_col=text_col, least_length=least_length, least_count=least_count, damaged_every=damaged_every))
    rows = words.join(near_words(words, block), "word", "left")
    is_form: Column = F.col("best_n") >= FORM_RATIO * F.col("n")
    rows = rows.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")
    )
    rows = cut_lineage(rows)
    named = rows.join(_roots(rows.filter("form IS NOT NULL")), "word", "left")
    return named.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
