"""Documents to token files, in five stages.

Toxic documents go, one document of each group of near copies stays, documents with benchmark items
go, sources are mixed to their target weights, and what is left is written as token files. Each
stage takes the rows that its predecessor kept, and works on all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import decontaminate, mixing, near_index, token_store, toxicity
from docweave.llm.common import held_out, table
from docweave.session import bounded, cut_lineage, fresh_path

TOXIC_SCORE = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose restored text scores under ``TOXIC_SCORE``; the model learns from the labels of usable rows in ``docs``."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    return toxicity.rows_below(docs, model, TOXIC_SCORE)


def _named(docs: DataFrame, *names: str) -> list[str]:
    """Column names that the documents don't have yet."""
    return [next(n for k in range(len(docs.columns) + 1) if (n := f"__{name}_{k}") not in docs.columns) for name in names]


def _one_of_equal(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per key, the least in order of its columns; equal rows meet in each task before they are shuffled."""
    return rows.groupBy(*keys).agg(F.min(F.struct(*columns)).alias("__least")).select(*keys, "__least.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row: the least by id (null last), then by hash of the text.

    Near copies share 0.8 or more of their five-word shingles, found by the Gray-order index. Rows
    are known by id and hash of the text, so rows that share an id, or have none, each stand for
    their own group. Which rows stay is settled on ids and hashes; texts are read once more for them.
    Null and empty texts are one group, an empty table gives an empty one, and other columns may have
    any name.
    """
    columns = docs.columns
    hashed, key, text = _named(docs, "hash", "id", "text")
    rows = docs.withColumn(hashed, F.xxhash64(F.coalesce("text", F.lit(""))))
    roots = near_index.groups(rows.select(F.col(hashed).alias("node"), "text"))
    named = rows.select("doc_id", F.col(hashed).alias("node")).groupBy("doc_id", "node").agg(F.count("*").alias("rows")).join(roots, "node", "left")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("node").alias("hash"))
    kept = named.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct(order.alias("first"), "rows")).alias("m"))
    kept = cut_lineage(kept.select(F.col("m.first.id").alias(key), F.col("m.first.hash").alias(text), "m.rows"))

    def chosen(which: DataFrame) -> DataFrame:
        found = bounded(which.drop("rows"))
        return rows.join(found, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(hashed) == F.col(text)), "left_semi")

    single = chosen(kept.filter("rows = 1")).select(*columns)
    repeated = kept.filter("rows > 1")
    if repeated.isEmpty():
        return single
    return single.union(_one_of_equal(chosen(repeated).withColumnRenamed("doc_id", key), [key, hashed], [c for c in columns if c != "doc_id"]).withColumnRenamed(key, "doc_id").select(*columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows into which no benchmark item leaked."""
    rows = decontaminate.marked(docs, table(spark, sf_dir, "benchmark"))
    return rows.filter(F.size("items") == 0).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, rows that share an id or have none each for itself.

    Rows are known by id, source and hash of the text; equal ones are one row, as often as the mix
    takes them together. While the keys taken are few (counted first) they are broadcast, and the
    texts stay where they are.
    """
    columns = docs.columns
    hashed, key, source, text, times, copy = _named(docs, "hash", "id", "source", "text", "times", "copy")
    rows = docs.withColumn(hashed, F.xxhash64(F.coalesce("text", F.lit(""))))
    plan = mixing.mix(rows.withColumn(key, F.struct("doc_id", F.col(hashed).alias("hash"))), id_col=key)
    plan = plan.groupBy(F.col("doc_id.doc_id").alias(key), F.col("source").alias(source), F.col("doc_id.hash").alias(text))
    plan = cut_lineage(plan.agg(F.sum("copies").cast("int").alias(times), F.count("*").alias("rows")).filter(F.col(times) > 0))

    def taken(which: DataFrame) -> DataFrame:
        same = F.col("doc_id").eqNullSafe(F.col(key)) & F.col("source").eqNullSafe(F.col(source)) & (F.col(hashed) == F.col(text))
        return rows.join(bounded(which.drop("rows")), same)

    found = taken(plan.filter("rows = 1")).select(*columns, times)
    repeated = plan.filter("rows > 1")
    if not repeated.isEmpty():
        found = found.union(_one_of_equal(taken(repeated), [key, source, text], [*columns, times]).select(*columns, times))
    return found.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*columns)


def write_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the rows, and per row its place in them: ``doc_id, start, n_tokens, ids_crc32``."""
    import public_tokenizers

    folder = fresh_path(spark, "tokens")
    # a small piece table: workers serve all stages
    manifest = token_store.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), folder, cache_pieces=150_000)
    return token_store.token_digests(manifest, folder)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token_files", write_files),
]
#: Restoration, components and tokens have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            path = fresh_path(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
