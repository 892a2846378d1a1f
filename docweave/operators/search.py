"""Exact nearest-neighbour search and retrieval over tables of questions."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.config import Settings
from docweave.functions import text as X
from docweave.functions import vectors as V
from docweave.functions.binding import let
from docweave.functions.filters import id_predicate, metadata_predicate
from docweave.operators.topk import top_k
from docweave.session import bounded, cut_lineage, estimated_bytes, fresh_path

SCORE_DIGITS = 8
CELLS_PER_STEP = 4_000_000
BROADCAST_BYTES = 64 << 20
ASK_BLOCK_ROWS = 16_384
#: The part of the corpus that floors are worked out from.
FLOOR_SAMPLE = 1 / 32
#: Parts per core that a written corpus has at least, so that the tasks of a pass end evenly.
PARTS_PER_CORE = 4
WIDE_CORPUS_BYTES = 1 << 40
BROADCAST_TERMS = 1_000_000

#: Up to so many hit chunks are looked up by literal keys.
FEW_KEYS = 500

#: Up to so many hits are kept in the plan itself rather than in a checkpoint.
FEW_HITS = 2_000


def _matrix(ids: pa.Array, lists: pa.Array, dimension: int) -> tuple[pa.Array, np.ndarray]:
    """Ids and vectors of the rows whose vector has the right length."""
    usable = pc.equal(pc.list_value_length(lists), dimension).fill_null(False)
    ids, lists = ids.filter(usable), lists.filter(usable)
    return ids, np.asarray(lists.flatten()).astype(np.float64).reshape(len(lists), dimension)


def _unit(rows: np.ndarray) -> np.ndarray:
    lengths = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(lengths == 0, 1.0, lengths)


def _scored(metric: str, raw: np.ndarray) -> np.ndarray:
    """Rounded scores from cosines, or from squared distances for ``l2``."""
    return np.round(raw if metric == "cosine" else 1.0 / (1.0 + np.maximum(raw, 0.0)), SCORE_DIGITS) + 0.0


class _Best:
    """The best ``k`` (score, id) pairs per question among the corpus rows seen so far.

    Products in single precision rule out the pairs that stay below a question's floor by more than
    such products can be wrong. What is left is scored in double precision, so the result does not
    hang on the short products. Of equal vectors only the ``k`` smallest ids take part.
    """

    def __init__(self, questions: np.ndarray, k: int, metric: str, floor: np.ndarray | None = None):
        self.k, self.metric = k, metric
        self.questions = _unit(questions) if metric == "cosine" else questions
        self.squares = (self.questions * self.questions).sum(axis=1)
        # the product of the longer rows is the cosine, or the dot product less half the square of the corpus row
        self.longer = self.questions if metric == "cosine" else np.c_[self.questions, -np.ones(len(questions))]
        self.short = self.longer.astype(np.float32)
        # nothing below it is kept; it rises with the k-th score seen
        self.floor = np.full(len(questions), -np.inf) if floor is None else floor.copy()
        self.kept: pa.Table | None = None
        self.waiting: list[pa.Table] = []

    def add(self, ids: pa.Array, corpus: np.ndarray) -> None:
        if not len(self.questions) or not len(ids):
            return
        order = pc.sort_indices(ids)
        ids, corpus = ids.take(order), corpus[np.asarray(order)]
        if self.metric == "cosine":
            corpus = _unit(corpus)
        first = _first_of_equal(corpus, self.k)
        if first is not None:
            ids, corpus = ids.take(pa.array(first)), corpus[first]
        step = max(1, CELLS_PER_STEP // len(self.questions))
        for at in range(0, len(ids), step):
            self._add(ids.slice(at, step), corpus[at : at + step])

    def _least(self, floor: np.ndarray, largest: float) -> tuple[np.ndarray, np.ndarray]:
        """Per question the product that a pair at the floor has, and how far a short product may be off it."""
        short = (self.questions.shape[1] + 9) * 2.0**-23
        half = 0.6 * 10.0**-SCORE_DIGITS  # rounding may lift a score this much
        if self.metric == "cosine":
            return floor - half, np.full(len(floor), short)
        with np.errstate(divide="ignore"):
            reach = np.where(floor > half, 1.0 / np.maximum(floor - half, 0.0) - 1.0, np.inf)
        off = short * (np.sqrt(self.squares) + largest + 1e-30) * (largest + 1e-30)
        least = np.where(np.isposinf(reach), -np.inf, (self.squares - reach) / 2)
        return least, off + 2.0**-23 * np.where(np.isfinite(least), np.abs(least), 0.0)

    def _add(self, ids: pa.Array, corpus: np.ndarray) -> None:
        longer, largest = corpus, 1.0
        if self.metric != "cosine":
            squares = (corpus * corpus).sum(axis=1)
            longer, largest = np.c_[corpus, squares / 2], float(np.sqrt(squares.max()))
        least, off = self._least(self.floor, largest)
        if largest < 1e9 and (self.metric == "cosine" or np.abs(self.questions).max() < 1e9):
            products = self.short @ longer.astype(np.float32).T
        else:
            # too large for single precision
            products = np.nan_to_num(self.longer @ longer.T, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        if np.isneginf(least).any() and len(ids) >= self.k:
            cut = len(ids) - self.k
            kth = np.partition(products, cut, axis=1)[:, cut] - off
            if self.metric != "cosine":
                kth = 1.0 / (1.0 + np.maximum(self.squares - 2.0 * kth, 0.0))
            # pairs whose scores are rounded to the same one stay in
            least, off = self._least(np.maximum(self.floor, kth - 10.0**-SCORE_DIGITS), largest)
        # few pairs are left, so they are counted from their places
        asks, rows = np.divmod(np.flatnonzero(products >= (least - off)[:, None].astype(products.dtype)), len(ids))
        wide = np.bincount(asks, minlength=len(least)) > 4 * self.k
        found = []
        if wide.any():
            # questions that many rows are level with, as a question without words is
            level = np.flatnonzero(wide)
            for at in range(0, len(level), some := max(1, (CELLS_PER_STEP >> 3) // len(ids))):
                found.append(self._level(level[at : at + some], corpus))
            asks, rows = (part[~wide[asks]] for part in (asks, rows))
        some = max(1, (CELLS_PER_STEP >> 1) // self.questions.shape[1])
        for at in range(0, len(asks), some):
            ask, row = asks[at : at + some], rows[at : at + some]
            if self.metric == "cosine":
                raw = np.einsum("ij,ij->i", self.questions[ask], corpus[row])
            else:
                apart = self.questions[ask] - corpus[row]
                raw = np.einsum("ij,ij->i", apart, apart)
            scores = _scored(self.metric, raw)
            good = scores >= self.floor[ask]
            found.append((ask[good], row[good], scores[good]))
        for ask, row, scores in found:
            self.waiting.append(pa.table({"ask": ask, "score": scores, "id": ids.take(pa.array(row))}))
        if sum(map(len, self.waiting)) >= self.k * len(self.questions):
            self.merge()

    def _level(self, asks: np.ndarray, corpus: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs of some questions with all rows, of those level with the floor or the k-th score the first ``k``."""
        if self.metric == "cosine":
            raw = self.questions[asks] @ corpus.T
        else:
            raw = np.stack([np.einsum("ij,ij->i", apart, apart) for apart in (corpus - ask for ask in self.questions[asks])])
        scores = _scored(self.metric, raw)
        floor = self.floor[asks]
        if len(corpus) >= self.k:
            ranked = np.partition(np.where(np.isnan(scores), -np.inf, scores), len(corpus) - self.k, axis=1)
            floor = np.maximum(floor, ranked[:, len(corpus) - self.k])
        level = scores == floor[:, None]
        # rows are in order of id
        ask, row = np.nonzero((scores > floor[:, None]) | (level & (np.cumsum(level, axis=1) <= self.k)))
        return asks[ask], row, scores[ask, row]

    def merge(self) -> pa.Table | None:
        """What is kept, in order of question, score and id."""
        if self.waiting:
            table = pa.concat_tables(([] if self.kept is None else [self.kept]) + self.waiting)
            self.waiting = []
            order = [("ask", "ascending"), ("score", "descending"), ("id", "ascending")]
            table = table.take(pc.sort_indices(table, sort_keys=order)).combine_chunks()
            ask = table["ask"].to_numpy()
            place = np.arange(len(ask)) - np.searchsorted(ask, ask)
            kth = place == self.k - 1
            self.floor[ask[kth]] = np.maximum(self.floor[ask[kth]], table["score"].to_numpy()[kth])
            self.kept = table.filter(pa.array(place < self.k))
        return self.kept


def _first_of_equal(rows: np.ndarray, k: int) -> np.ndarray | None:
    """Places of the first ``k`` of each group of equal rows, in order; None if no group is larger."""
    if len(rows) <= k:
        return None
    keys = np.ascontiguousarray(rows + 0.0).view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel()
    _, group, sizes = np.unique(keys, return_inverse=True, return_counts=True)
    if sizes.max() <= k:
        return None
    order = np.argsort(group, kind="stable")
    place = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.sort(order[place < k])


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table[name].combine_chunks()
    return column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)


def _hits(ask_ids: pa.Array, best: _Best) -> pa.Table:
    kept = best.merge().combine_chunks()
    return pa.table(
        {
            "ask_id": ask_ids.take(_column(kept, "ask")),
            "hit_id": _column(kept, "id"),
            "score": _column(kept, "score"),
        }
    )


def _ask_matrix(rows: pa.Table, dimension: int) -> tuple[pa.Array, np.ndarray]:
    """Ids and vectors of a bounded question table, on the driver."""
    return _matrix(_column(rows, "ask_id"), _column(rows, "_vector"), dimension)


def _scan(
    corpus: DataFrame,
    questions: tuple[pa.Array, np.ndarray],
    k: int,
    metric: str,
    schema: T.StructType,
    floor: np.ndarray | None = None,
) -> DataFrame:
    """One pass over the corpus against a small broadcast question matrix.

    ``floor`` holds a score per question that its k-th best row reaches: a task gives back
    nothing below it.
    """
    shared = corpus.sparkSession.sparkContext.broadcast((*questions, floor))
    dimension = questions[1].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask_ids, matrix, least = shared.value
        best = _Best(matrix, k, metric, least)
        for batch in batches:
            best.add(*_matrix(batch.column("hit_id"), batch.column("_vector"), dimension))
        if best.merge() is not None:
            yield from _hits(ask_ids, best).to_batches()

    return corpus.mapInArrow(run, schema)


def _by_score() -> list[Column]:
    return [F.col("score").desc(), F.col("hit_id")]


def _floors(sample: DataFrame, matrix: np.ndarray, k: int, metric: str, schema: T.StructType) -> np.ndarray:
    """Per question the k-th best score in a part of the corpus; the k-th best of all is no lower.

    A pair's score may differ in its last digit between two passes, so the floor lies a little below.
    """
    places = T.StructType([T.StructField("ask_id", T.LongType()), *schema.fields[1:]])
    scored = _scan(sample, (pa.array(np.arange(len(matrix))), matrix), k, metric, places)
    last = top_k(scored, ["ask_id"], _by_score(), k).where(F.col("rank") == k).select("ask_id", "score").toArrow()
    floor = np.full(len(matrix), -np.inf)
    floor[_column(last, "ask_id").to_numpy()] = _column(last, "score").to_numpy() - 10.0 ** (1 - SCORE_DIGITS)
    return floor


def _passes(
    corpus: DataFrame, asks: DataFrame, n_asks: int, k: int, metric: str, dimension: int, schema: T.StructType
) -> DataFrame:
    """Question tables of any size: one pass over the corpus per block of questions.

    Ids and vectors of the corpus are written once, so that an unsaved corpus is worked out once and
    not in every pass. They are not shuffled, but for a corpus of few parts, which is dealt out evenly
    as it is written. A block of questions first meets a sample of the
    corpus, written once. The k-th best score in there is a floor for the pass over the whole
    corpus, whose tasks then give back about ``k / FLOOR_SAMPLE`` rows per question together,
    however many tasks there are. The sample settles how much is given back, not what comes out.
    Questions are dealt to blocks in a written table, and the hits of each pass are written, so
    that a pass depends on no earlier one.
    """
    spark = corpus.sparkSession
    blocks = max(1, -(-n_asks // ASK_BLOCK_ROWS))
    dealt, whole, part, hits = (fresh_path(spark, label) for label in ("asks", "corpus", "sample", "hits"))
    # by id and vector, so that an id that many rows share (null, say) is no block of its own
    block = F.pmod(F.xxhash64("ask_id", "_vector"), F.lit(blocks)).cast("int")
    asks.withColumn("_block", block).repartition("_block").write.partitionBy("_block").parquet(dealt)
    least = PARTS_PER_CORE * spark.sparkContext.defaultParallelism
    (corpus if corpus.rdd.getNumPartitions() >= least else corpus.repartition(least)).write.parquet(whole)
    corpus = spark.read.schema(corpus.schema).parquet(whole)
    corpus.sample(FLOOR_SAMPLE, seed=0).write.parquet(part)
    sample = spark.read.schema(corpus.schema).parquet(part)
    kept = T.StructType([*asks.schema.fields, T.StructField("_block", T.IntegerType())])
    for number in range(blocks):
        own = spark.read.schema(kept).parquet(dealt).where(F.col("_block") == number)
        questions = _ask_matrix(own.select("ask_id", "_vector").toArrow(), dimension)
        floor = _floors(sample, questions[1], k, metric, schema)
        _scan(corpus, questions, k, metric, schema, floor).write.mode("append").parquet(hits)
    return spark.read.schema(schema).parquet(hits)


def nearest(
    questions: DataFrame,
    corpus: DataFrame,
    k: int,
    metric: str = "cosine",
    dimension: int = 384,
    question_id: str = "question_id",
    corpus_id: str = "chunk_id",
    vector: str = "embedding",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``(question_id, corpus_id, score, vector_rank)``: the exact ``k`` best rows per question.

    Scores are cosine, or ``1 / (1 + squared distance)`` for ``metric='l2'``, rounded so that
    ties do not hang on the order of summation; ties go to the smaller id. Rows whose vector
    is null or of another length take no part.

    Only ids and vectors enter the scan. Question tables whose vectors stay within
    ``broadcast_bytes`` (checked before anything is shipped) meet the corpus in one pass; larger
    ones block by block, at once rather than when the result is read, from a written copy of the
    corpus's ids and vectors. Only a corpus of few parts is shuffled, once, for that copy.
    """
    # wrong vectors are left out inside the scan: a filter here would be pushed below the
    # embedding of an unsaved corpus and compute it twice
    asks = questions.select(F.col(question_id).alias("ask_id"), F.col(vector).alias("_vector"))
    hits = corpus.select(F.col(corpus_id).alias("hit_id"), F.col(vector).alias("_vector"))
    schema = T.StructType(
        [asks.schema["ask_id"], hits.schema["hit_id"], T.StructField("score", T.DoubleType())]
    )
    bound = max(1, broadcast_bytes // (8 * dimension))
    few = asks.limit(bound + 1).toArrow()
    if few.num_rows <= bound:
        best = _scan(hits, _ask_matrix(few, dimension), k, metric, schema)
    else:
        best = _passes(hits, asks, questions.count(), k, metric, dimension, schema)
    # every scan task sends k rows per question: over very many tasks these merge in two rounds
    salt_on = "hit_id" if estimated_bytes(hits) > WIDE_CORPUS_BYTES else None
    ranked = top_k(best, ["ask_id"], _by_score(), k, "vector_rank", salt_on)
    return ranked.select(
        F.col("ask_id").alias(question_id), F.col("hit_id").alias(corpus_id), "score", "vector_rank"
    )


def similar(
    references: DataFrame,
    corpus: DataFrame,
    k: int = 5,
    metric: str = "cosine",
    dimension: int = 384,
    corpus_id: str = "chunk_id",
    vector: str = "embedding",
) -> DataFrame:
    """Neighbours of the corpus rows named in ``references``, themselves left out.

    Ids without a row or a vector have no neighbours.
    """
    asks = corpus.join(bounded(references.select(corpus_id).distinct()), corpus_id, "left_semi").select(
        F.col(corpus_id).alias("reference_id"), vector
    )
    found = nearest(asks, corpus, k + 1, metric, dimension, "reference_id", corpus_id, vector)
    others = found.where(F.col("reference_id") != F.col(corpus_id))
    order = Window.partitionBy("reference_id").orderBy("vector_rank")
    return (
        others.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("reference_id", corpus_id, "score", "rank")
    )


def term_statistics(chunks: DataFrame) -> DataFrame:
    """``(term, df)``: in how many chunks a term occurs; combined before the shuffle."""
    return (
        chunks.select(F.explode(F.array_distinct(X.search_tokens(F.col("content")))).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("df"))
    )


def corpus_statistics(chunks: DataFrame) -> DataFrame:
    """One row: number of chunks and their mean length in tokens."""
    return merged_totals(length_statistics(chunks))


def length_statistics(chunks: DataFrame) -> DataFrame:
    """One row of sums that add up over parts of a corpus: chunks, those with a text, tokens."""
    size = F.size(X.search_tokens(F.col("content")))
    return chunks.agg(F.count("*").alias("n"), F.count(size).alias("sized"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("tokens"))


def merged_terms(parts: DataFrame) -> DataFrame:
    """:func:`term_statistics` of a corpus from those of its parts; what left it counts below zero."""
    return parts.groupBy("term").agg(F.sum("df").alias("df")).where(F.col("df") > 0)


def merged_totals(parts: DataFrame) -> DataFrame:
    """:func:`corpus_statistics` of a corpus from the :func:`length_statistics` of its parts."""
    mean = F.try_divide(F.sum("tokens").cast("double"), F.sum("sized").cast("double"))
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), mean.alias("avg_len"))


def with_tokens(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("_tokens", X.search_tokens(F.col("content")))


def rerank(
    candidates: DataFrame,
    questions: DataFrame,
    chunks: DataFrame,
    cap: int,
    terms: DataFrame | None = None,
    totals: DataFrame | None = None,
) -> DataFrame:
    """BM25 of question and chunk replaces the vector score; the first ``cap`` rows stay.

    ``candidates(question_id, chunk_id, score, vector_rank, content)`` with a bounded number
    of rows per question; ``questions(question_id, question)``. A stand-in for a trained
    pair scorer (see :func:`rerank_with`). A single candidate keeps its vector score.
    """
    asked_terms = questions.select(
        "question_id", F.explode(F.array_distinct(X.search_tokens(F.col("question")))).alias("term")
    )
    # Counts of the terms asked for, one row each. A word that most questions hold would make
    # the join below lopsided, so the counts are broadcast as long as they are few.
    few_terms = asked_terms.limit(FEW_KEYS + 1).toArrow()
    known = pc.unique(_column(few_terms, "term")).to_pylist() if few_terms.num_rows <= FEW_KEYS else None
    counted = terms if terms is not None else term_statistics(chunks)
    if known is None:
        counts = bounded(cut_lineage(counted.join(asked_terms.select("term").distinct(), "term", "left_semi")))
    else:
        asked_terms = questions.sparkSession.createDataFrame(few_terms, asked_terms.schema)
        counts = F.broadcast(counted.where(F.col("term").isin(known)))
    asked = (
        asked_terms.join(counts, "term")
        .groupBy("question_id")
        .agg(F.array_sort(F.collect_list(F.struct("term", "df"))).alias("_terms"))
    )
    # short question texts go to the candidates; otherwise the candidates are shuffled
    if known is not None or asked_terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        asked = F.broadcast(asked)
    stats = (totals if totals is not None else corpus_statistics(chunks)).select(F.struct("n", "avg_len"))
    scored = (
        (candidates if "_tokens" in candidates.columns else with_tokens(candidates))
        .join(asked, "question_id", "left")
        .withColumn("_stats", stats.scalar())
    )
    # tokens come from below the join, so the lambdas see a column and not an expression
    present = F.filter("_terms", lambda t: F.array_contains("_tokens", t["term"]))

    def gain(total: Column, item: Column) -> Column:
        n, df = F.col("_stats")["n"], item["df"]
        idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
        length = F.size("_tokens") / F.col("_stats")["avg_len"]
        tf = F.size("_tokens") - F.size(F.array_remove("_tokens", item["term"]))
        return total + let(tf, lambda times: idf * times * 2.2 / (times + 1.2 * (0.25 + 0.75 * length)))

    bm25 = F.round(F.coalesce(F.aggregate(present, F.lit(0.0), gain), F.lit(0.0)), SCORE_DIGITS)
    return _reordered(scored.withColumn("_pair_score", bm25), cap).drop(
        "_terms", "_tokens", "_stats"
    )


def rerank_with(candidates: DataFrame, questions: DataFrame, scorer, cap: int) -> DataFrame:
    """Rerank with a plugged-in scorer ``(question, content) -> Column``.

    One made by :func:`docweave.functions.isolate.isolated` adds an ``error`` column: a question of which
    a pair fails has the first error on all its rows, which keep the order and score of the vectors.
    Other questions are ranked as if it weren't there.
    """
    paired = candidates.join(questions.select("question_id", "question"), "question_id")
    if getattr(scorer, "reports_errors", False):
        # by itself, so that the model runs once per pair
        told = paired.withColumn("_told", scorer(F.col("question"), F.col("content")))
        group = Window.partitionBy("question_id")
        first = F.min(F.when(F.col("_told.error").isNotNull(), F.struct("vector_rank", F.col("_told.error").alias("error")))).over(group)
        told = told.withColumn("error", first["error"])
        failed = F.col("error").isNotNull()
        scored = told.withColumn("_pair_score", F.when(~failed, F.col("_told.value").cast("double"))).withColumn("_vector_score", F.col("score"))
        ranked = _reordered(scored, cap)
        return ranked.withColumn("score", F.when(failed, F.col("_vector_score")).otherwise(F.col("score"))).drop("question", "_told", "_vector_score")
    scored = paired.withColumn("_pair_score", scorer(F.col("question"), F.col("content")).cast("double"))
    return _reordered(scored, cap).drop("question")


def _reordered(scored: DataFrame, cap: int) -> DataFrame:
    group = Window.partitionBy("question_id")
    order = group.orderBy(F.col("_pair_score").desc(), F.col("vector_rank"))
    return (
        scored.withColumn("_n", F.count("*").over(group))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= cap)
        .withColumn("score", F.when(F.col("_n") > 1, F.col("_pair_score")).otherwise(F.col("score")))
        .drop("_n", "_pair_score")
    )


def few_keys(found: DataFrame, column: str) -> list[str] | None:
    """The distinct keys if they are few: as literals they reach the file scan, which then skips row groups."""
    rows = found.select(column).distinct().limit(FEW_KEYS + 1).collect()
    return None if len(rows) > FEW_KEYS else [row[0] for row in rows]


def embed_questions(questions: DataFrame, settings: Settings = Settings(), embed=V.token_hash) -> DataFrame:
    """``(question_id, question, embedding)``; blank questions are left out."""
    return (
        questions.select("question_id", X.strip(F.col("question")).alias("question"))
        .where(F.col("question") != "")
        .withColumn("embedding", embed(F.col("question"), settings.embed.dimension))
    )


def embed_chunks(chunks: DataFrame, settings: Settings = Settings(), embed=V.token_hash) -> DataFrame:
    return chunks.withColumn("embedding", embed(F.col("content"), settings.embed.dimension))


def retrieve(
    questions: DataFrame,
    chunks: DataFrame,
    documents: DataFrame | None = None,
    settings: Settings = Settings(),
    top: int | None = None,
    embed=V.token_hash,
    scorer=None,
    terms: DataFrame | None = None,
    totals: DataFrame | None = None,
    statistics_from: DataFrame | None = None,
) -> DataFrame:
    """Ranked chunks per question: vector search, rerank, cut, document attached.

    ``chunks`` carries ``embedding``; text and metadata are joined back by id after the
    vector search, so the scan stays narrow; while the hits are few they are broadcast and the
    corpus is not shuffled. Returns ``(question_id, rank, chunk_id, score,
    vector_rank, document_id, content, document_title, document_url, doc_title, doc_url, doc_description)``.
    """
    cfg = settings.search
    wanted = cfg.top_k if top is None else top
    pool = max(wanted, cfg.rerank_top_k * cfg.search_multiplier)
    if "embedding" not in questions.columns:
        questions = embed_questions(questions, settings, embed)
    # a few rows per question, needed twice below: materialised so that the scan runs once
    found = nearest(questions, chunks, pool, settings.embed.metric, settings.embed.dimension)
    most = FEW_HITS // max(1, pool)
    if questions.select("question_id").limit(most + 1).count() <= most:
        rows = found.toArrow()
        found = hits = F.broadcast(found.sparkSession.createDataFrame(rows, found.schema))
        # at most FEW_HITS of them, which the file scan takes as literals too
        keys = pc.unique(_column(rows, "chunk_id")).to_pylist()
    else:
        found = cut_lineage(found)
        hits = bounded(found)
        keys = few_keys(found, "chunk_id")
    # text is read, and split into tokens, once per chunk that is hit at all
    wanted_ids = bounded(found.select("chunk_id").distinct()) if keys is None else None

    def hit(rows: DataFrame) -> DataFrame:
        return rows.join(wanted_ids, "chunk_id", "left_semi") if keys is None else rows.where(F.col("chunk_id").isin(keys))

    details = hit(chunks.select("chunk_id", "document_id", "content", "document_title", "document_url"))
    if cfg.rerank and scorer is None:
        details = with_tokens(details)
    candidates = details.join(hits, "chunk_id")
    if cfg.rerank:
        cap = cfg.rerank_top_k if cfg.strict_rerank_cap else max(cfg.rerank_top_k, wanted)
        if scorer is not None:
            ranked = rerank_with(candidates, questions, scorer, cap)
        else:
            base = statistics_from if statistics_from is not None else chunks
            ranked = rerank(candidates, questions, base, cap, terms, totals)
    else:
        ranked = candidates.withColumn("rank", F.col("vector_rank"))
    cut = ranked.where(F.col("rank") <= wanted)
    described = [("title", "doc_title"), ("url", "doc_url"), ("short_description", "doc_description")]
    if documents is None:
        attached = cut.select("*", *(F.lit(None).cast("string").alias(name) for _, name in described))
    else:
        ids = hit(chunks.select("chunk_id", "document_id"))
        owners = None if keys is None else few_keys(ids, "document_id")
        titles = documents.select(
            F.col("doc_id").alias("document_id"),
            *(
                (F.col(source) if source in documents.columns else F.lit(None).cast("string")).alias(name)
                for source, name in described
            ),
        )
        if owners is None:
            side = titles.join(bounded(ids.select("document_id").distinct()), "document_id", "left_semi")
        else:
            side = F.broadcast(titles.where(F.col("document_id").isin(owners)))
        # a left join keeps chunks without a document
        attached = cut.join(side, "document_id", "left")
    return attached.select(
        "question_id",
        "rank",
        "chunk_id",
        "score",
        "vector_rank",
        "document_id",
        "content",
        "document_title",
        "document_url",
        "doc_title",
        "doc_url",
        "doc_description",
    )


def filter_corpus(
    chunks: DataFrame,
    documents: DataFrame,
    document_ids: Sequence[str] | DataFrame | None = None,
    filters: Mapping[str, Any] | None = None,
) -> DataFrame:
    """Chunks whose document passes the id list and the metadata conditions.

    A condition on a document column wins over a chunk column of the same name.
    """
    kept = chunks
    if isinstance(document_ids, DataFrame):
        ids = document_ids.select(document_ids.columns[0]).toDF("document_id").distinct()
        kept = kept.join(bounded(ids), "document_id", "left_semi")
    else:
        kept = kept.where(id_predicate(F.col("document_id"), document_ids))
    if filters:
        on_documents = {key: value for key, value in filters.items() if key in documents.columns}
        on_chunks = {key: value for key, value in filters.items() if key not in on_documents}
        kept = kept.where(metadata_predicate(kept, on_chunks))
        if on_documents:
            passing = documents.where(metadata_predicate(documents, on_documents)).select(
                F.col("doc_id").alias("document_id")
            )
            # vectors and text are not shuffled for a selective filter
            kept = kept.join(bounded(passing), "document_id", "left_semi")
    return kept


def retrieve_filtered(
    questions: DataFrame,
    chunks: DataFrame,
    documents: DataFrame,
    document_ids: Sequence[str] | DataFrame | None = None,
    filters: Mapping[str, Any] | None = None,
    settings: Settings = Settings(),
    top: int | None = None,
    post_filter: bool = False,
    **options: Any,
) -> DataFrame:
    """Retrieval over the chunks that pass the filters.

    Filters come before the search, so ``top`` rows come back whenever that many pass.
    ``post_filter=True`` searches ``filter_multiplier`` times as deep, filters after, then
    cuts, and may return fewer.
    """
    passing = filter_corpus(chunks, documents, document_ids, filters)
    if not post_filter:
        # term statistics stay those of the whole corpus
        options.setdefault("statistics_from", chunks)
        return retrieve(questions, passing, documents, settings, top, **options)
    deep = None if top is None else top * settings.search.filter_multiplier
    found = retrieve(questions, chunks, documents, settings, deep, **options)
    left = found.join(passing.select("chunk_id"), "chunk_id", "left_semi")
    order = Window.partitionBy("question_id").orderBy("rank")
    renumbered = left.withColumn("rank", F.row_number().over(order))
    return renumbered if top is None else renumbered.where(F.col("rank") <= top)


def documents_by_rank(retrieved: DataFrame) -> DataFrame:
    """Distinct documents per question in the order their first chunk ranks.

    Chunks without a document are passed over.
    """
    first = (
        retrieved.where(F.col("doc_url").isNotNull())
        .groupBy("question_id", F.col("document_id").alias("doc_id"))
        .agg(
            F.min("rank").alias("first_rank"),
            F.first("doc_url").alias("url"),
            F.first("doc_title").alias("title"),
            F.first("doc_description").alias("short_description"),
        )
    )
    order = Window.partitionBy("question_id").orderBy("first_rank")
    return first.withColumn("position", F.row_number().over(order)).select(
        "question_id", "position", "doc_id", "url", "title", "short_description", "first_rank"
    )
