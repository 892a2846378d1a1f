"""Vector columns and the default, model-free embedder."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions.text import search_tokens

VECTOR = T.ArrayType(T.FloatType())
# Rows of a batch that are counted together.
SLICE = 256


def norm(vector: Column) -> Column:
    squares = F.aggregate(
        vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
    )
    return F.sqrt(squares)


def normalise(vector: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    length = norm(vector)
    return F.when(length == 0, vector.cast("array<double>")).otherwise(
        F.transform(vector, lambda x: x.cast("double") / length)
    )


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Zero when either vector has no length."""
    lengths = norm(a) * norm(b)
    return F.when(lengths == 0, F.lit(0.0)).otherwise(dot(a, b) / lengths)


def is_valid(vector: Column, dimension: int) -> Column:
    return F.coalesce(F.size(vector) == dimension, F.lit(False))


def token_hash(text: Column, dimension: int = 384) -> Column:
    """Unit vector of token counts, tokens hashed to ``dimension`` buckets; blank gives zeros.

    A stand-in for a sentence model, with other rankings than a trained model's. Tokens are
    split JVM-side; an Arrow call hashes the distinct tokens of a slice of its batch and counts them
    with a single ``bincount``.
    """

    def embed_slice(tokens: pa.Array) -> np.ndarray:
        rows = len(tokens)
        lengths = np.asarray(tokens.value_lengths().fill_null(0))
        coded = tokens.flatten().dictionary_encode()
        buckets = np.array(
            [int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dimension for t in coded.dictionary.to_pylist()],
            dtype=np.int64,
        )
        cells = np.repeat(np.arange(rows), lengths) * dimension
        if len(coded):
            cells = cells + buckets[np.asarray(coded.indices)]
        counts = np.bincount(cells, minlength=rows * dimension).reshape(rows, dimension).astype(np.float64)
        lengths2 = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        unit = counts / np.where(lengths2 == 0, 1.0, lengths2)
        return unit.astype(np.float32)

    @F.arrow_udf(VECTOR)
    def embed(tokens: pa.Array) -> pa.Array:
        # a batch may hold thousands of long texts, so its counts are made for a few rows at a time
        unit = np.empty((len(tokens), dimension), np.float32)
        for at in range(0, len(tokens), SLICE):
            unit[at : at + SLICE] = embed_slice(tokens.slice(at, SLICE))
        offsets = np.arange(len(tokens) + 1, dtype=np.int32) * dimension
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(unit.ravel()))

    return embed(F.coalesce(search_tokens(text), F.array().cast("array<string>")))


def model_embedder(make_predict, dimension: int, batch_size: int = 32):
    """Plug in a model: ``make_predict`` is the factory ``predict_batch_udf`` expects.

    Returns a Column function that can be passed wherever ``embed=`` is accepted.
    """
    from pyspark.ml.functions import predict_batch_udf

    udf = predict_batch_udf(make_predict, return_type=VECTOR, batch_size=batch_size)

    def embed(text: Column, _dimension: int = dimension) -> Column:
        return udf(text)

    return embed
