"""Phrases whose words stand together more often than their parts would, counted through prefix-free parsing.

Pieces of text between marks are cut into chunks at trigger words (words whose checksum divides
``TRIGGER``): a chunk starts at one and reaches past the next one by as many words as the longest
phrase has but one. Where text repeats, the same words trigger, so it falls into the same chunks.
Distinct chunks and how often the parse has them form a dictionary, and phrases are counted in it
with those weights; a phrase belongs to the chunk in which it starts before the next trigger, so
overlaps count once.

Lengths are counted one after the other: a phrase can only be frequent if it is so without its first
and without its last word, and those are looked up in a bit table of fixed greatest size. The table
may say yes too often, which costs a row, and never no. For three words and more only the stretches
of the dictionary are left in which all neighbours are frequent pairs.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docweave.llm.common import slices, texts_of
from docweave.session import bounded, cut_lineage, fresh_path

LONGEST = 5
LEAST_COUNT = 100
MOST = 2000
TRIGGER = 16
#: Bits of the table of frequent phrases: 16 a phrase, and at most 2 ** 30 (128 MB).
MOST_BITS = 1 << 30
BLOCK_BITS = 1 << 18
#: Distinct chunks or words held by a task before they go on to Spark's aggregation.
HELD = 200_000
UNKNOWN_LANGUAGE = "und"

_MARKS = b".,;:!?\n\x0b\x0c\r"
#: A-Z in lower case, marks as line ends.
_PLAIN = bytes(ord("\n") if b in _MARKS else b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def chunks(text: str, longest: int = LONGEST, trigger: int = TRIGGER) -> Iterator[tuple[int, bytes]]:
    """The parse of a text: per chunk how many phrases may start in it, and its words, blank-joined.

    Pieces end at marks; words are runs of anything but blanks and tabs.
    """
    triggers: dict[bytes, bool] = {}
    for piece in text.encode("utf-8", "surrogatepass").translate(_PLAIN).split(b"\n"):
        words = piece.split()
        start = 0
        for at in range(1, len(words)):
            word = words[at]
            if (cut := triggers.get(word)) is None:
                cut = triggers[word] = zlib.crc32(word) % trigger == 0
            if cut:
                yield at - start, b" ".join(words[start : at + longest - 1])
                start = at
        if words:
            yield len(words) - start, b" ".join(words[start:])


def _summed(found: Counter, names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) or [()] * (len(names) - 1)
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(list(found.values()), pa.int64())], names=names)


def dictionary(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, trigger: int = TRIGGER) -> DataFrame:
    """``lang, own, chunk, times``: distinct chunks of all texts, the phrases that may start in one, and how often the parse has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["lang", "own", "chunk", "times"], [pa.string(), pa.int32(), pa.binary()]
        found: Counter = Counter()
        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                found.update((lang, own, chunk) for own, chunk in chunks(text, longest, trigger))
                if len(found) > HELD:
                    yield _summed(found, names, kinds)
                    found.clear()
        yield _summed(found, names, kinds)

    rows = docs.select(F.coalesce(docs[lang_col], F.lit(UNKNOWN_LANGUAGE)).alias("lang"), docs[text_col].alias("text"))
    parsed = rows.mapInArrow(run, "lang string, own int, chunk binary, times long")
    return parsed.groupBy("lang", "own", "chunk").agg(F.sum("times").alias("times"))


class Words:
    """The words of blank-joined texts as places in one byte array, with a hash each; a language is part of its words' hashes."""

    def __init__(self, langs: list[str], texts: list[bytes]):
        self.data = np.frombuffer(b" ".join([*texts, b""]), "u1")
        blank = self.data == 32
        self.ends = np.flatnonzero(blank)
        self.starts = np.r_[0, self.ends[:-1] + 1] if len(self.ends) else self.ends
        last = np.cumsum([len(t) + 1 for t in texts]) - 1
        self.sizes = np.diff(np.r_[0, np.searchsorted(self.ends, last, "right")])  # words per text
        self.row = np.repeat(np.arange(len(texts)), self.sizes)
        self.within = np.arange(len(self.ends)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        lengths = self.ends - self.starts
        place = np.arange(len(self.data)) - np.repeat(self.starts, lengths + 1)
        powers = np.full(int(lengths.max(initial=0)) + 1, _MIX, "u8").cumprod()
        values = np.where(blank, np.uint64(0), (self.data + np.uint64(1)) * powers[place])
        of_lang = np.array([zlib.crc32(lang.encode()) for lang in langs], "u8")
        summed = np.add.reduceat(values, self.starts) if len(self.starts) else np.empty(0, "u8")
        self.hashes = _mixed(summed + of_lang[self.row])

    def phrases(self, length: int) -> np.ndarray:
        """Hashes of the phrases that start at each word, as if the texts were one; the last ``length - 1`` are missing."""
        n = max(0, len(self.hashes) - length + 1)
        found = np.full(n, length, "u8")
        for k in range(length):
            found = _mixed(found ^ self.hashes[k : k + n])
        return found

    def often(self, bits: np.ndarray, length: int) -> np.ndarray:
        """If the phrase that starts at each word is in a bit table; False at the end."""
        at = self.phrases(length) & np.uint64(len(bits) * 8 - 1)
        found = np.zeros(len(self.hashes) + 1, bool)
        found[: len(at)] = (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype("u1")) & 1
        return found

    def stretches(self, first: np.ndarray, last: np.ndarray) -> pa.Array:
        """The bytes from one word to another, for each pair of words."""
        start, size = self.starts[first], self.ends[last] - self.starts[first]
        offsets = np.r_[0, np.cumsum(size)]
        taken = self.data[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])]
        return pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.astype("i4")), pa.py_buffer(taken)])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _MIX
    x ^= x >> np.uint64(31)
    return x


def _columns(batch: pa.RecordBatch) -> tuple[list[str], np.ndarray, list[bytes], np.ndarray]:
    langs, owns, texts, times = batch.columns
    return langs.to_pylist(), owns.to_numpy(), texts.to_pylist(), times.to_numpy()


def bit_table(phrases: DataFrame, length: int) -> bytes:
    """A bit for the hash of each row of ``lang, phrase``; built in blocks by tasks, and of at most ``MOST_BITS`` bits."""
    bits = BLOCK_BITS
    rows = phrases.count()
    while bits < min(16 * rows, MOST_BITS):
        bits *= 2

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows=8192):
            words = Words(*(c.to_pylist() for c in batch.columns))
            at = words.phrases(length)
            at = at[words.within[: len(at)] == 0] & np.uint64(bits - 1)
            yield pa.RecordBatch.from_arrays([pa.array((at // BLOCK_BITS).astype("i4")), pa.array((at % BLOCK_BITS).astype("i4"))], names=["block", "at"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        set_bits: dict[int, np.ndarray] = {}
        for batch in batches:
            block, at = (c.to_numpy() for c in batch.columns)
            for b in np.unique(block):
                set_bits.setdefault(int(b), np.zeros(BLOCK_BITS, "u1"))[at[block == b]] = 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(set_bits), pa.int32()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in set_bits.values()], pa.binary())], names=["block", "bits"]
        )

    n = min(bits // BLOCK_BITS, max(1, int(phrases.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = phrases.select("lang", "phrase").mapInArrow(slots, "block int, at int").distinct().repartition(n, "block")
    whole = bytearray(bits // 8)
    for block, part in dealt.mapInArrow(blocks, "block int, bits binary").toLocalIterator():
        whole[block * BLOCK_BITS // 8 : (block + 1) * BLOCK_BITS // 8] = part
    return bytes(whole)


def count_words(parsed: DataFrame) -> DataFrame:
    """``lang, phrase, f`` of all words of a dictionary; ``phrase`` is binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["lang", "phrase", "f"], [pa.string(), pa.binary()]
        found: dict[str, Counter] = {}
        for batch in slices(batches, rows=8192, most_bytes=1 << 21):
            langs, owns, texts, times = (c.to_pylist() for c in batch.columns)
            for lang, own, text, n in zip(langs, owns, texts, times, strict=True):
                words = text.split(b" ")[:own]
                counts = found.get(lang)
                if counts is None:
                    counts = found[lang] = Counter()
                if n == 1:
                    counts.update(words)
                else:
                    for word in words:
                        counts[word] += n
            if sum(map(len, found.values())) > HELD:
                yield from (_summed(Counter({(lang, word): n for word, n in counts.items()}), names, kinds) for lang, counts in found.items())
                found.clear()
        yield from (_summed(Counter({(lang, word): n for word, n in counts.items()}), names, kinds) for lang, counts in found.items())

    counted = parsed.select("lang", "own", "chunk", "times").mapInArrow(run, "lang string, phrase binary, f long")
    return counted.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def count_phrases(parsed: DataFrame, length: int, least: int, shorter: DataFrame) -> DataFrame:
    """``lang, phrase, f`` of the phrases of ``length`` words that a dictionary has ``least`` times; ``shorter`` are those of a word less."""
    table = parsed.sparkSession.sparkContext.broadcast(bit_table(shorter, length - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(table.value, "u1")
        for batch in slices(batches, rows=8192, most_bytes=1 << 21):
            langs, owns, texts, times = _columns(batch)
            words = Words(langs, texts)
            often = words.often(bits, length - 1)
            starts = words.within < np.minimum(owns, words.sizes - length + 1)[words.row]
            at = np.flatnonzero(starts & often[:-1] & often[1:])
            row = words.row[at]
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()).take(pa.array(row)), words.stretches(at, at + length - 1), pa.array(times[row], pa.int64())], names=["lang", "phrase", "f"])

    counted = parsed.select("lang", "own", "chunk", "times").mapInArrow(run, "lang string, phrase binary, f long")
    return counted.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)


def narrowed(parsed: DataFrame, pairs: DataFrame) -> DataFrame:
    """A dictionary of the stretches of three words or more in which all neighbours are in ``pairs``: what longer frequent phrases lie in."""
    table = parsed.sparkSession.sparkContext.broadcast(bit_table(pairs, 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(table.value, "u1")
        for batch in slices(batches, rows=8192, most_bytes=1 << 21):
            langs, owns, texts, times = _columns(batch)
            words = Words(langs, texts)
            on = words.often(bits, 2)[:-1] & (words.within + 1 < words.sizes[words.row])
            edges = np.diff(np.r_[0, on.astype("i1"), 0])
            first, stop = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)  # the stretch ends with word `stop`
            own = np.minimum(owns[words.row[first]] - words.within[first], stop - first + 1)
            keep = (stop - first >= 2) & (own > 0)
            first, stop, own = first[keep], stop[keep], own[keep]
            row = words.row[first]
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()).take(pa.array(row)), pa.array(own, pa.int32()), words.stretches(first, stop), pa.array(times[row], pa.int64())],
                names=["lang", "own", "chunk", "times"],
            )

    kept = parsed.select("lang", "own", "chunk", "times").mapInArrow(run, "lang string, own int, chunk binary, times long")
    return kept.groupBy("lang", "own", "chunk").agg(F.sum("times").alias("times"))


def _exact(name: str, digits: int = 15):
    return F.col(name).cast(f"decimal({digits},0)")


def collocations(
    docs: DataFrame,
    *,
    lang_col: str = "lang",
    text_col: str = "text",
    longest: int = LONGEST,
    least_count: int = LEAST_COUNT,
    most: int = MOST,
    contained_percent: int = 100,
    trigger: int = TRIGGER,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of two to ``longest`` words per language.

    ``a`` counts the phrase, ``l`` and ``r`` the two parts of the cut with the lowest score (ties: the
    first), ``n`` all words, and ``score`` is ``floor(1000 a n / (l r))``, in decimal numbers that hold
    10 ** 15 words exactly. Phrases that lie in a longer one of ``contained_percent`` of their count or
    more go. Rank is by score, count and phrase (byte order). Null texts have no words, a null language
    is ``und``, repeated rows count each, an empty table gives an empty one, long texts are parsed
    whole, and other columns are not read.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "chunks")
    dictionary(docs, lang_col, text_col, longest, trigger).write.parquet(path)
    parsed = spark.read.parquet(path)
    totals = parsed.groupBy("lang").agg(F.sum(F.col("own") * F.col("times")).alias("n"))
    often = [cut_lineage(count_words(parsed).filter(F.col("f") >= least_count))]
    for length in range(2, longest + 1):
        if length == 3:
            parsed = cut_lineage(narrowed(parsed, often[-1]))
        often.append(cut_lineage(count_phrases(parsed, length, least_count, often[-1])))
    counts = None
    for length, rows in enumerate(often, 1):
        rows = rows.select("lang", F.col("phrase").cast("string").alias("phrase"), F.lit(length).alias("length"), "f")
        counts = rows if counts is None else counts.union(rows)

    candidates = counts.filter("length > 1").select("lang", "phrase", "length", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    joined = lambda start, size: F.array_join(F.slice("words", start, size), " ")
    cuts = candidates.select("lang", "phrase", "length", "a", "words", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("first"), joined(F.col("k") + 1, F.col("length") - F.col("k")).alias("rest"))
    left = counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(bounded(totals), "lang")
    scored = scored.withColumn("above", F.lit(1000).cast("decimal(4,0)") * _exact("a") * _exact("n", 16)).withColumn("below", _exact("l") * _exact("r"))
    scored = scored.withColumn("score", F.expr("above div below"))
    lowest = F.min(F.struct("score", "k", "l", "r", "n")).alias("cut")
    scored = scored.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.n", "cut.score")

    inner = candidates.filter("length > 2").select("lang", "a", "length", "words", F.explode(F.sequence(F.lit(2), F.col("length") - 1)).alias("size"))
    inner = inner.select("lang", "a", "words", "size", F.explode(F.sequence(F.lit(1), F.col("length") - F.col("size") + 1)).alias("start"))
    inner = inner.select("lang", joined(F.col("start"), F.col("size")).alias("phrase"), F.col("a").alias("longer"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(inner, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < contained_percent * F.col("a"), F.lit(True)))

    best = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    kept = kept.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most)
    return kept.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
