"""A quality classifier: random-indexing word vectors, pooled per document, into a two-layer network.

Random indexing gives each token a sparse vector of a few +1 and -1, and sums up the vectors of the
tokens around it over the whole corpus: tokens with like surroundings get like vectors, without
a matrix to factor. Tokens are hashed to a fixed number of rows, so the table has one size whatever
the corpus. A document is the mean of its tokens' vectors, plain and with frequent tokens held
down; a network of one hidden layer, fitted on a bounded sample of labelled rows, scores it, and
a temperature fitted on rows set aside calibrates the probability.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import slices, texts_of

ROWS = 1 << 13
DIM = 32
NONZERO = 4
WINDOW = 2
SEED = 7
#: Both means, the mean product of neighbours (high where tokens are repeated), and the number of tokens.
INPUTS = 2 * DIM + 2
#: Letters, digits, and runs of other signs.
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


@dataclass(frozen=True)
class Model:
    vectors: np.ndarray  # ROWS x DIM
    share: np.ndarray  # of all tokens, per row
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, float]
    centre: np.ndarray
    spread: np.ndarray
    temperature: float


def row_of(token: str) -> int:
    """The table row of a token: its small letters, apart for words in capitals, with the lengths of sign runs kept to 4."""
    if not token[0].isalnum():
        token = token[:4]
    shape = b"^" if len(token) > 1 and token.isupper() else b"-"
    return zlib.crc32(shape + token.lower().encode("utf-8", "surrogatepass")) % ROWS


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Per row the places and signs of its non-zero entries."""
    rng = np.random.default_rng(SEED)
    places = np.argsort(rng.random((ROWS, DIM)), axis=1)[:, :NONZERO].astype("i8")
    return places, rng.choice(np.array([-1.0, 1.0]), (ROWS, NONZERO))


class _Tokens:
    """Turns texts into table rows, remembering tokens."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of all tokens of ``texts`` in turn, and each text's number of tokens."""
        known, rows, counts = self.known, [], []
        if len(known) > 300_000:
            known.clear()
        for text in texts:
            tokens = _TOKEN.findall(text)
            for token in set(tokens):
                if token not in known:
                    known[token] = row_of(token)
            rows.extend(map(known.__getitem__, tokens))
            counts.append(len(tokens))
        return np.array(rows, "i8"), np.array(counts, "i8")


def context_sums(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``row, n, sums`` over all rows: tokens, and the summed index vectors of the tokens within ``WINDOW``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        tokens, sums, counts = _Tokens(), np.zeros(ROWS * DIM), np.zeros(ROWS, "i8")
        for batch in slices(batches, most_bytes=1 << 20):
            rows, sizes = tokens.of(texts_of(batch))
            if not len(rows):
                continue
            counts += np.bincount(rows, minlength=ROWS)
            text = np.repeat(np.arange(len(sizes)), sizes)
            for step in range(1, WINDOW + 1):
                both = text[step:] == text[:-step]
                left, right = rows[:-step][both], rows[step:][both]
                for k in range(NONZERO):
                    sums += np.bincount(left * DIM + places[right, k], signs[right, k], ROWS * DIM)
                    sums += np.bincount(right * DIM + places[left, k], signs[left, k], ROWS * DIM)
        seen = np.flatnonzero(counts)
        vectors = pa.FixedSizeListArray.from_arrays(pa.array(sums.reshape(ROWS, DIM)[seen].ravel(), pa.float64()), DIM)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen, pa.int64()), pa.array(counts[seen], pa.int64()), vectors.cast(pa.list_(pa.float64()))], names=["row", "n", "sums"]
        )

    partial = docs.select(docs[text_col].alias("text")).mapInArrow(run, "row long, n long, sums array<double>")
    total = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(DIM)]
    summed = partial.groupBy("row").agg(F.sum("n").alias("n"), *total)
    return summed.select("row", "n", F.array(*[f"s{i}" for i in range(DIM)]).alias("sums"))


def word_vectors(sums: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of surroundings plus own index vector, and token shares. At most ``ROWS`` rows come to the driver."""
    table = sums.toArrow()
    places, signs = index_vectors()
    vectors, counts = np.zeros((ROWS, DIM)), np.zeros(ROWS)
    if table.num_rows:
        at = table.column("row").to_numpy()
        vectors[at] = np.stack(table.column("sums").to_numpy(zero_copy_only=False))
        counts[at] = table.column("n").to_numpy()
        vectors[at] -= vectors[at].mean(axis=0)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    own = np.zeros((ROWS, DIM))
    np.put_along_axis(own, places, signs / np.sqrt(NONZERO), axis=1)
    return (vectors + own).astype("f4"), counts / max(1.0, counts.sum())


def pooled(texts: list[str], tokens: _Tokens, vectors: np.ndarray, share: np.ndarray, most: int = 1 << 17) -> np.ndarray:
    """One row per text: mean vector, mean vector with frequent tokens held down, mean product of neighbours, log number of tokens."""
    weight = (1e-3 / (1e-3 + share)).astype("f4")
    out = np.zeros((len(texts), INPUTS), "f4")
    rows, sizes = tokens.of(texts)
    text, alike = np.repeat(np.arange(len(texts)), sizes), np.zeros(len(texts))
    for start in range(0, len(rows), most):
        r, t = rows[start : start + most], text[start : start + most]
        starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        picked = vectors[r]
        out[t[starts], :DIM] += np.add.reduceat(picked, starts)
        out[t[starts], DIM : 2 * DIM] += np.add.reduceat(picked * weight[r, None], starts)
        same = t[1:] == t[:-1]
        alike += np.bincount(t[1:][same], np.einsum("ij,ij->i", picked[1:], picked[:-1])[same], len(texts))
    out[:, : 2 * DIM] /= np.maximum(sizes, 1)[:, None]
    out[:, -2] = alike / np.maximum(sizes - 1, 1)
    out[:, -1] = np.log1p(sizes)
    return out


def _logits(x: np.ndarray, layers) -> np.ndarray:
    w1, b1, w2, b2 = layers
    return np.tanh(x @ w1 + b1) @ w2 + b2


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 24, steps: int = 600, decay: float = 1e-3):
    """Layer weights by full-batch Adam on the mean log loss."""
    rng = np.random.default_rng(SEED)
    layers = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(())]
    first, second = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
    for step in range(1, steps + 1):
        h = np.tanh(x @ layers[0] + layers[1])
        p = 1 / (1 + np.exp(-np.clip(h @ layers[2] + layers[3], -30, 30)))
        d = (p - y) / len(y)
        back = np.outer(d, layers[2]) * (1 - h * h)
        slopes = [x.T @ back + decay * layers[0], back.sum(axis=0), h.T @ d + decay * layers[2], d.sum()]
        for i, g in enumerate(slopes):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            layers[i] = layers[i] - 0.02 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return layers[0], layers[1], layers[2], float(layers[3])


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss on rows that the network has not seen."""
    if not len(y):
        return 1.0
    choices = np.exp(np.linspace(-1.5, 2.5, 81))
    losses = [np.mean(np.logaddexp(0, -(2 * y - 1) * logits / t)) for t in choices]
    return float(choices[int(np.argmin(losses))])


def fit(
    docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = 6000
) -> Model:
    """Word vectors over all texts, and a network fitted on at most ``most_rows`` usable labelled rows.

    The rows are the first by a hash of the id; a fifth of them is set aside for the temperature.
    """
    vectors, share = word_vectors(context_sums(docs, text_col))
    known = labels.filter(usable & F.col(label_col).isin(0, 1)).select(labels[id_col].alias("__id"), labels[label_col].alias("__y")).dropDuplicates(["__id"])
    # a bounded number of ids
    picked = F.broadcast(known.orderBy(F.xxhash64("__id"), "__id").limit(most_rows))
    rows = docs.join(picked, docs[id_col] == F.col("__id")).select(F.col("__y").cast("int").alias("y"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _Tokens()
        for batch in slices(batches):
            x = pooled(texts_of(batch), tokens, vectors, share).astype("f8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "x"])

    # at most `most_rows` short vectors
    table = rows.mapInArrow(run, "y int, x array<double>").toArrow()
    y = table.column("y").to_numpy().astype("f8")
    x = np.stack(table.column("x").to_numpy(zero_copy_only=False)) if len(y) else np.zeros((0, INPUTS))
    order = np.lexsort((*x.T, y)) if len(y) else np.zeros(0, int)
    x, y = x[order], y[order]
    aside = np.arange(len(y)) % 5 == 4
    centre = x[~aside].mean(axis=0) if len(y) else np.zeros(INPUTS)
    spread = np.maximum(x[~aside].std(axis=0), 1e-3) if len(y) else np.ones(INPUTS)
    scaled = np.clip((x - centre) / spread, -8, 8)
    if not len(y) or y.min() == y.max():
        rate = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        layers = (np.zeros((INPUTS, 1)), np.zeros(1), np.zeros(1), float(np.log(rate / (1 - rate))))
        return Model(vectors, share, layers, centre, spread, 1.0)
    layers = fit_network(scaled[~aside], y[~aside])
    return Model(vectors, share, layers, centre, spread, fit_temperature(_logits(scaled[aside], layers), y[aside]))


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` per row: the calibrated probability of good quality.

    Null and empty texts are scored as texts without tokens; null ids stay null; repeated rows are
    answered each; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _Tokens()
        for batch in slices(batches, most_bytes=1 << 20):
            x = np.clip((pooled(texts_of(batch), tokens, model.vectors, model.share) - model.centre) / model.spread, -8, 8)
            logits = _logits(x, model.layers) / model.temperature
            scores = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    chosen = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return chosen.mapInArrow(run, "doc_id long, score double")
