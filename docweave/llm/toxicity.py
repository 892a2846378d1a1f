"""Toxicity of texts whose words may be disguised.

A disguise is seen as a noisy channel: letters are written as look-alike signs, spelled out with
separators, or repeated. For each disguised word, and each stretch of spelled-out letters, the
possible letters and word ends form a lattice, and a Viterbi search over it, under a letter trigram
model counted over the whole corpus, restores the likeliest words. Texts are then scored by weighted words and word beginnings, learned from labelled rows.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import slices, texts_of, tidy
from docweave.session import cut_lineage

# Letter classes of the model: 0 for everything that ends a word, then a-z, the Latin-1 small letters, any other letter.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
OTHER = len(LETTERS) + 1
CLASSES = 64

#: Signs and the letters that they stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "¡": "i",
}
_SIGNS = re.escape("".join(LOOKALIKES))
#: A look-alike before or after a letter, a sign three times, or two doubled letters in a row.
_DISGUISED = re.compile(rf"(?:^|[^\W\d_])[{_SIGNS}]+[^\W\d_]|[^\W\d_][{_SIGNS}]+$|(\w)\1\1|([^\W\d_])\2([^\W\d_])\3")
#: Four or more single letters or signs, all parted by the same separator, or by any.
_SPELLED = re.compile(r"(?<![\w@$|+€])[\w@$|+€]([ .\-_*]{1,3})[\w@$|!+€](?:\1[\w@$|!+€]){2,}(?!\w)")
_MIXED = re.compile(r"(?<![\w@$|+€])[\w@$|+€](?:[ .\-_*]{1,3}[\w@$|!+€](?![\w@$|+€])){3,}")
#: What is around a word: punctuation, and three or more of one sign as decoration.
_OUTSIDE = re.compile(r"^[^\w@$€£¡]+|[^\w@$€£]+$|([^\w])\1\1+[^\w@$€£]*$")
#: Columns of one lattice; longer stretches are searched in blocks that share the overlap.
BLOCK, OVERLAP = 64, 24
PREFIXES = (3, 4, 5, 6, 7, 8)
MOST_WEIGHT = 20.0
#: The sum takes this many words, so that length alone is no evidence.
STRONGEST = 4
SIGN_COST, RUN_COST, DIGIT_COST = 1.0, 0.5, 6.0


@dataclass(frozen=True)
class Model:
    """Letter trigram costs (a 64 x 64 x 64 table), feature weights, and the curve from their sum to a probability."""

    costs: np.ndarray
    weights: dict[str, float]
    curve: tuple[list[float], list[float]]


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    table = np.zeros(0x250, "u1")
    for i, letter in enumerate(LETTERS):
        table[ord(letter)] = i + 1
    table[0x100:] = OTHER
    return np.where(points < 0x250, table[np.minimum(points, 0x24F)], OTHER * (points > 0x370)).astype("i4")


def letter_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``code, n``: how often each class trigram stands in the lower-cased texts, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, "i8")
        for batch in slices(batches, most_bytes=1 << 18):
            c = classes("  " + "  ".join(texts_of(batch)).lower() + "  ")
            total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["code", "n"])

    return docs.select(docs[text_col].alias("text")).mapInArrow(tidy(run), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def letter_costs(counts: DataFrame) -> np.ndarray:
    """Negative log probabilities of a class after two others, smoothed by the class frequencies.

    The table has at most 64 cubed rows whatever the corpus, so it may come to the driver.
    """
    table = np.zeros(CLASSES**3)
    rows = counts.toArrow()
    table[rows.column("code").to_numpy()] = rows.column("n").to_numpy()
    table = table.reshape(CLASSES, CLASSES, CLASSES)
    single = table.sum(axis=(0, 1)) + 1.0
    single /= single.sum()
    pair = table.sum(axis=0) + 5 * single
    pair /= pair.sum(axis=1, keepdims=True)
    table = (table + 5 * pair[None]) / (table.sum(axis=2, keepdims=True) + 5)
    return -np.log(table).astype("f4")


def _runs(word: str) -> list[tuple[str, int]]:
    """Each sign of a word, and how often it stands in a row."""
    return [(m.group(1), len(m.group())) for m in re.finditer(r"(.)\1*", word, re.S)]


def _search(runs: list[tuple[str, int]], costs: np.ndarray, best: int, boundaries: bool) -> list[str]:
    """The cheapest ways through a lattice of sign runs, best first, with blanks at word ends if they are allowed."""
    place = {letter: i + 1 for i, letter in enumerate(LETTERS)}
    states: dict[tuple[int, int], list[tuple[float, str]]] = {(0, 0): [(0.0, "")]}
    for at, (sign, length) in enumerate(runs):
        options = [(l, SIGN_COST) for l in LOOKALIKES.get(sign, "")]
        options.append((sign, DIGIT_COST if sign in LOOKALIKES else 0.0))
        ways = options
        if length > 1:
            ways = [(l, cost + RUN_COST) for l, cost in options] + [(l + l, cost) for l, cost in options]
        if boundaries and at:
            ways = ways + [(" " + written, cost) for written, cost in ways]
        after: dict[tuple[int, int], list[tuple[float, str]]] = {}
        for (a, b), paths in states.items():
            for written, cost in ways:
                x, y = a, b
                for letter in written:
                    z = place.get(letter, OTHER if letter.isalpha() else 0)
                    cost += float(costs[x, y, z])
                    x, y = y, z
                after.setdefault((x, y), []).extend((c + cost, s + written) for c, s in paths)
        states = {k: heapq.nsmallest(best, v) for k, v in after.items()}
    ended = [(c + float(costs[a, b, 0]), s) for (a, b), paths in states.items() for c, s in paths]
    return [s for _, s in heapq.nsmallest(best, ended)]


def restore(word: str, costs: np.ndarray, best: int = 3) -> list[str]:
    """The likeliest words behind a disguised one, best first.

    Runs of one sign are lattice columns: each letter that the sign may stand for, once, or twice if
    it is repeated. The search keeps, per pair of last letters, the ``best`` cheapest ways. A word of
    more than ``BLOCK`` columns is longer than any word of a language: only its beginning is restored,
    as of plain words of that length only the beginning counts.
    """
    return _search(_runs(word)[:BLOCK], costs, best, False)


def readings(joined: str, costs: np.ndarray, best: int = 3) -> list[list[list[str]]]:
    """Per block of joined spelled-out letters, the ``best`` likeliest ways to part and restore its words.

    Word ends are states of the lattice. The whole stretch is searched, in blocks that overlap by more
    than a word.
    """
    runs = _runs(joined)
    blocks = [runs[i : i + BLOCK] for i in range(0, max(1, len(runs) - OVERLAP), BLOCK - OVERLAP)]
    return [[way.split() for way in _search(block, costs, best, True)] for block in blocks]


def word_features(word: str) -> list[str]:
    """The bare word, and its beginnings where it is longer."""
    core = _OUTSIDE.sub("", word)
    return [core + "$", *(core[:n] for n in PREFIXES if len(core) > n)] if len(core) > 2 else []


def hidden_words(text: str) -> list[str]:
    """Words that are spelled out with separators, joined."""
    return [re.sub(r"[ .\-_*]+", "", m.group()) for m in _SPELLED.finditer(text)]


def spelled_out(text: str) -> set[str]:
    """The same, and stretches in which the separators differ."""
    found = set(hidden_words(text)) | {re.sub(r"[ .\-_*]+", "", m.group()) for m in _MIXED.finditer(text)}
    return {joined for joined in found if any(c.isalpha() for c in joined)}


def disguised(word: str) -> bool:
    return bool(_DISGUISED.search(word)) and any(c.isalpha() for c in word)


def sample(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    most_toxic: int = 1500,
    most_clean: int = 3000,
) -> tuple[DataFrame, float]:
    """``y, half, text`` of at most so many labelled rows, the first by a hash of the id, and the toxic share of all.

    A third of the rows (``half`` 1) is set aside to fit the curve on.
    """
    known = labels.filter(usable & F.col(label_col).isin(0, 1)).select(labels[id_col].alias("__id"), labels[label_col].alias("__y")).dropDuplicates(["__id"])
    share = float(known.agg(F.avg("__y")).first()[0] or 0.0)
    picks = [known.filter(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(n) for y, n in ((1, most_toxic), (0, most_clean))]
    half = (F.pmod(F.xxhash64(F.lit("half"), "__id"), F.lit(3)) == 0).cast("int")
    # a bounded number of ids, by the two parameters
    picked = F.broadcast(picks[0].union(picks[1]).withColumn("__half", half))
    rows = docs.join(picked, docs[id_col] == F.col("__id")).select(F.col("__y").alias("y"), F.col("__half").alias("half"), docs[text_col].alias("text"))
    return cut_lineage(rows), share


def learn_weights(rows: DataFrame, least_contexts: int = 5, least_ratio: float = 15.0) -> dict[str, float]:
    """Log likelihood ratios of features, from the bounded sample ``rows`` (``y, text``).

    Candidates are features that stand behind several different words in toxic rows, none of them in
    more than half of the cases: a word that recurs in copies of one text does not count.
    """
    names = ["f", "before", "n", "docs"]

    def toxic_side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, int], list[int]] = {}
        for batch in slices(batches):
            for text in texts_of(batch):
                seen, before = set(), 0
                for word in text.lower().split():
                    for feature in word_features(word):
                        entry = counts.setdefault((feature, before), [0, 0])
                        entry[0] += 1
                        entry[1] += feature not in seen
                        seen.add(feature)
                    before = zlib.crc32(word.encode("utf-8", "surrogatepass")) & 0xFFFF
        columns = [[k[0] for k in counts], [k[1] for k in counts], [v[0] for v in counts.values()], [v[1] for v in counts.values()]]
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    toxic, clean = (rows.filter(F.col("y") == y).select("text") for y in (1, 0))
    seen = toxic.mapInArrow(toxic_side, "f string, before int, n long, docs long")
    by_context = seen.groupBy("f", "before").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_feature = by_context.groupBy("f").agg(F.count("*").alias("contexts"), F.max("n").alias("top"), F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = by_feature.filter((F.col("contexts") >= least_contexts) & (2 * F.col("top") <= F.col("n")))
    candidates = {r["f"]: r["docs"] for r in kept.select("f", "docs").collect()}

    def clean_side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in slices(batches):
            for text in texts_of(batch):
                counts.update({f for w in set(text.lower().split()) for f in word_features(w) if f in candidates})
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["f", "n"])

    in_clean = {r["f"]: r["n"] for r in clean.mapInArrow(clean_side, "f string, n long").groupBy("f").agg(F.sum("n").alias("n")).collect()}
    n_toxic, n_clean = max(1, toxic.count()), max(1, clean.count())
    ratios = {f: (n / n_toxic) / ((in_clean.get(f, 0) + 2) / n_clean) for f, n in candidates.items()}
    return {f: math.log(r) for f, r in ratios.items() if r >= least_ratio}


def _evidence(costs: np.ndarray, weights: dict[str, float]):
    """A function from a text to its summed weight and the restored words that counted."""
    memo: dict[str, tuple[float, str] | None] = {}

    def looked_up(word: str) -> tuple[float, str] | None:
        best = max((weights[f] for f in word_features(word) if f in weights), default=None)
        best = None if best is None else (best, "")
        core = _OUTSIDE.sub("", word)
        if disguised(core):
            for written in restore(core, costs):
                found = max((weights[f] for f in word_features(written) if f in weights), default=None)
                if found is not None and (best is None or found > best[0]):
                    best = (found, written)
        return best

    def uncovered(joined: str) -> dict[str, float]:
        """Hits among the words that spelled-out letters hide: of each block the reading that says most, as one word or parted."""
        core = _OUTSIDE.sub("", joined)
        blocks = readings(core, costs)
        blocks[0] += [[word] for word in restore(core, costs)]
        hits: dict[str, float] = {}
        for block in blocks:
            read = [{w: max(weights[f] for f in found) for w in way if (found := [f for f in word_features(w) if f in weights])} for way in block]
            hits |= max(read, key=lambda h: sum(h.values()), default={})
        return hits

    def of(text: str) -> tuple[float, list[str]]:
        text = text.lower()
        words = set(text.split())
        if len(memo) > 150_000:
            memo.clear()
        for word in words:
            if word not in memo:
                memo[word] = looked_up(word)
        hits = {_OUTSIDE.sub("", w) if not memo[w][1] else memo[w][1]: memo[w] for w in words if memo[w]}
        for joined in sorted(spelled_out(text)):
            for word, weight in uncovered(joined).items():
                hits.setdefault(word, (weight, word))
        return min(MOST_WEIGHT, sum(heapq.nlargest(STRONGEST, (w for w, _ in hits.values())))), sorted({w for _, w in hits.values() if w})

    return of


def fit_curve(sums: np.ndarray, y: np.ndarray, share: float) -> tuple[list[float], list[float]]:
    """Knots of a rising curve from summed weight to probability: pooled adjacent violators over the held rows."""
    row = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9)) if len(y) else sums
    blocks: list[list[float]] = []  # weight, weighted label, weighted sum
    for i in np.argsort(sums, kind="stable"):
        blocks.append([row[i], row[i] * y[i], row[i] * sums[i]])
        while len(blocks) > 1 and (
            blocks[-1][2] / blocks[-1][0] - blocks[-2][2] / blocks[-2][0] < 1e-9 or blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]
        ):
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    at = [0.0, *(s / w for w, _, s in blocks if s > 0), MOST_WEIGHT]
    rise = [(t + 0.5 * share) / (w + 0.5) for w, t, s in blocks if s > 0]
    none = [(t + 0.5 * share) / (w + 0.5) for w, t, s in blocks if s == 0]
    first = none[0] if none else min([share, *rise])
    return at, np.maximum.accumulate([first, *rise, max([first, *rise])]).tolist()


def probability(total: float, curve: tuple[list[float], list[float]]) -> float:
    """The curve at ``total``, with a slight slope of its own so that more evidence never scores the same."""
    return float(0.99 * np.interp(total, *curve) + 0.01 * total / MOST_WEIGHT)


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, restored`` per row; ``restored`` lists the disguised words that counted.

    The weights of the ``STRONGEST`` distinct words are summed. Null and empty texts sum to nothing
    and get the score of such texts; null ids stay null; repeated rows are answered each; other
    columns are not read.
    """
    costs, weights, curve = model.costs, model.weights, model.curve

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = _evidence(costs, weights)
        for batch in slices(batches):
            found = [evidence(t) for t in texts_of(batch)]
            scores = [probability(total, curve) for total, _ in found]
            columns = [batch.column(0), pa.array(scores, pa.float64()), pa.array([r for _, r in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "restored"])

    chosen = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return chosen.mapInArrow(tidy(run), "doc_id long, score double, restored array<string>")


def rows_below(docs: DataFrame, model: Model, most: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores under ``most``; scores as in ``score_texts``."""
    costs, weights, curve = model.costs, model.weights, model.curve

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = _evidence(costs, weights)
        for batch in slices(batches):
            yield batch.filter(pa.array([probability(evidence(t)[0], curve) < most for t in texts_of(batch, text_col)], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    most_toxic: int = 1500,
    most_clean: int = 3000,
) -> Model:
    """The letter model of all texts, and weights and curve from a bounded sample of the usable labelled rows."""
    costs = letter_costs(letter_counts(docs, text_col))
    rows, share = sample(docs, labels, usable, id_col, text_col, label_col, most_toxic, most_clean)
    weights = learn_weights(rows.filter("half = 0"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = _evidence(costs, weights)
        for batch in slices(batches):
            totals = [evidence(t)[0] for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.float64())], names=["y", "total"])

    # as many rows as the sample has
    held = rows.filter("half = 1").select(F.col("y").cast("int"), "text").mapInArrow(sums, "y int, total double").toArrow()
    y, totals = held.column("y").to_numpy().astype("f8"), held.column("total").to_numpy()
    return Model(costs, weights, fit_curve(totals, y, share))
