"""The stored corpus: documents, chunks and figures as Parquet and JSON.

An ingest writes one segment per table, ``batch=<id>``, and then a one-row commit. Reading
takes the committed segments and, per document, its latest one: so a re-ingested document
replaces its rows and all its chunks, the cost of an ingest depends on the batch alone, a
committed segment is never overwritten, and a half-written one is never seen.
``compact`` folds the segments into one. A segment carries its own term and length statistics, which
add up to those of the corpus.

Several writers may work on one store. A writer claims its segment id by making a file that must not
exist yet, so no two share an id. A full segment lists the commits that it replaces; what others
commit meanwhile is not among them, stays visible, and counts as later than what was folded.
"""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.config import Settings
from docweave.functions.vectors import normalise
from docweave.operators import search
from docweave.operators.metrics import crawl_report, index_stats, system_stats
from docweave.schemas import CHUNKS, DOCUMENTS, FETCH_LOG
from docweave.session import bounded, cut_lineage, is_missing

COMMITS = T.StructType(
    [
        T.StructField("batch", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("committed_at", T.TimestampType()),
        T.StructField("owner", T.StringType()),
        T.StructField("replaces", T.ArrayType(T.LongType())),
    ]
)
_BATCH = T.StructField("batch", T.LongType())
TERMS = T.StructType([T.StructField("term", T.StringType()), T.StructField("df", T.LongType())])
LENGTHS = T.StructType([T.StructField(name, T.LongType()) for name in ("n", "sized", "tokens")])


class CorpusStore:
    def __init__(self, spark: SparkSession, root: str, settings: Settings = Settings()):
        self.spark, self.root, self.settings = spark, root.rstrip("/"), settings
        self._stale: tuple[tuple[int, ...], DataFrame] | None = None
        self._left: tuple[tuple[int, ...], DataFrame, DataFrame] | None = None
        self._totals: tuple[tuple[int, ...], DataFrame] | None = None

    def _path(self, *parts: str) -> str:
        return "/".join((self.root, *parts))

    def _commit_rows(self) -> list[tuple[int, str, str | None, list[int] | None]]:
        try:
            reader = self.spark.read.schema(COMMITS).option("recursiveFileLookup", "true")
            rows = reader.json(self._path("commits")).select("batch", "kind", "owner", "replaces").collect()
        except AnalysisException as error:
            if is_missing(error):
                return []
            raise
        return [tuple(row) for row in rows]

    def commits(self) -> list[tuple[int, str]]:
        """``(batch, kind)`` of every commit in order: one small row per ingest."""
        return sorted({(batch, kind) for batch, kind, *_ in self._commit_rows()})

    def committed_by(self, owner: str) -> bool:
        """True if a commit carries this owner: how a replayed stream batch knows that it is done."""
        return any(name == owner for _, _, name, _ in self._commit_rows())

    def last_batch(self) -> int:
        """The greatest committed batch id; -1 for an empty store."""
        return max((batch for batch, _ in self.commits()), default=-1)

    def exists(self) -> bool:
        return bool(self.commits())

    def _visible(self) -> list[int]:
        """Committed batch ids that count, from the oldest content on: the last full segment, then what it doesn't replace."""
        rows = self._commit_rows()
        full = max((batch for batch, kind, _, _ in rows if kind == "full"), default=None)
        if full is None:
            return sorted({batch for batch, *_ in rows})
        replaced = next(replaces for batch, kind, _, replaces in rows if batch == full)
        gone = (lambda batch: batch < full) if replaced is None else set(replaced).__contains__
        kinds = {batch: kind for batch, kind, _, _ in rows if not gone(batch)}
        return sorted(kinds, key=lambda batch: (kinds[batch] != "full", batch))

    def _claim(self, batch: int) -> bool:
        """True for the one writer that gets this segment id.

        Rests on the file system's exclusive create, as HDFS and local folders have it.
        """
        jvm, context = self.spark._jvm, self.spark.sparkContext
        path = jvm.org.apache.hadoop.fs.Path(self._path("claims", str(batch)))
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        try:
            files.create(path, False).close()
        except Py4JJavaError as error:
            if files.exists(path):
                return False
            raise error
        return True

    def _segments(self, table: str, schema: T.StructType, batches: list[int]) -> DataFrame:
        with_batch = T.StructType([*schema.fields, _BATCH])
        if not batches:
            return self.spark.createDataFrame([], with_batch)
        paths = [self._path(table, f"batch={b}") for b in batches]
        return self.spark.read.option("basePath", self._path(table)).schema(with_batch).parquet(*paths)

    def _current(self, table: str, schema: T.StructType, key: str) -> DataFrame:
        """Rows of each document's latest segment."""
        batches = self._visible()
        rows = self._segments(table, schema, batches)
        if len(batches) <= 1:
            return rows.drop("batch")
        stale = self._superseded(batches).withColumnRenamed("_doc", key)
        return rows.join(stale, [key, "batch"], "left_anti").drop("batch")

    def _superseded(self, batches: list[int]) -> DataFrame:
        """``_doc, batch``: copies of documents that a later segment replaced.

        They are worked out once for a set of committed segments, as those never change. Usually
        they are few and then broadcast, which leaves the corpus unshuffled.
        """
        if self._stale is None or self._stale[0] != tuple(batches):
            # ids are in order of content, but for a full segment in front
            order = F.when(F.col("batch") == batches[0], F.lit(-1).cast("long")).otherwise(F.col("batch"))
            stale = (
                self._segments("documents", DOCUMENTS, batches)
                .groupBy(F.col("doc_id").alias("_doc"))
                .agg(F.array_sort(F.collect_set(F.struct(order.alias("order"), "batch"))).alias("_batches"))
                .where(F.size("_batches") > 1)
                .select("_doc", F.explode(F.slice("_batches", F.lit(1), F.size("_batches") - 1)).alias("b"))
                .select("_doc", "b.batch")
            )
            self._stale = (tuple(batches), bounded(cut_lineage(stale)))
        return self._stale[1]

    def documents(self) -> DataFrame:
        return self._current("documents", DOCUMENTS, "doc_id")

    def chunks(self) -> DataFrame:
        return self._current("chunks", CHUNKS, "document_id")

    def write(
        self,
        documents: DataFrame,
        chunks: DataFrame | Callable[[DataFrame], DataFrame],
        batch: int | None = None,
        full: bool = False,
        owner: str | None = None,
        replaces: list[int] | None = None,
    ) -> int:
        """One segment. ``chunks`` may be a function of the documents just stored.

        ``full`` makes it the start of the store: the commits in ``replaces`` (those there are now unless
        told) are left behind. A segment takes the next free id, which no other writer gets; a committed
        one is never written again. With ``batch`` the caller answers for the id.
        """
        if full and replaces is None:
            replaces = [taken for taken, _ in self.commits()]
        if batch is None:
            batch = self.last_batch() + 1
            while not self._claim(batch):
                batch += 1
        elif any(batch == taken for taken, _ in self.commits()):
            raise ValueError(f"segment {batch} is committed")
        path = self._path("documents", f"batch={batch}")
        documents.select(*DOCUMENTS.names).write.mode("overwrite").parquet(path)
        if callable(chunks):
            chunks = chunks(self.spark.read.schema(DOCUMENTS).parquet(path))
        chunks.select(*CHUNKS.names).write.mode("overwrite").parquet(self._path("chunks", f"batch={batch}"))
        self._count_terms(batch)
        row = self.spark.range(1).select(
            F.lit(batch).cast("long").alias("batch"),
            F.lit("full" if full else "delta").alias("kind"),
            F.current_timestamp().alias("committed_at"),
            F.lit(owner).cast("string").alias("owner"),
            (F.array(*map(F.lit, replaces)) if full else F.lit(None)).cast("array<bigint>").alias("replaces"),
        )
        # a folder of its own: jobs that write into one folder at a time remove each other's unfinished files
        row.write.mode("append").json(self._path("commits", str(batch)))
        return batch

    def write_fetch_log(self, log: DataFrame, batch: int) -> None:
        log.write.mode("overwrite").parquet(self._path("fetch_log", f"batch={batch}"))

    def fetch_log(self, batch: int | None = None) -> DataFrame:
        """What an ingest fetched, the last one unless told otherwise."""
        batch = self.last_batch() if batch is None else batch
        return self.spark.read.schema(FETCH_LOG).parquet(self._path("fetch_log", f"batch={batch}"))

    def write_crawl_report(self, path: str, batch: int | None = None) -> None:
        crawl_report(self.fetch_log(batch), self.settings.crawl).write.mode("overwrite").json(path)

    def compact(self) -> int:
        """Folds the segments into one, sorted by id so that look-ups skip most row groups."""
        replaces = [taken for taken, _ in self.commits()]
        documents = self.documents().repartitionByRange("doc_id").sortWithinPartitions("doc_id")
        order = ("document_id", "chunk_index")
        return self.write(documents, self.chunks().repartitionByRange(*order).sortWithinPartitions(*order), full=True, replaces=replaces)

    def clear(self) -> int:
        """An empty store; earlier segments stay on disk until removed by hand."""
        documents = self.spark.createDataFrame([], DOCUMENTS)
        return self.write(documents, self.spark.createDataFrame([], CHUNKS), full=True)

    def rebuild(self, embed=None) -> int:
        """Vectors made anew from the text with ``embed``, or the stored ones normalised again."""
        replaces = [taken for taken, _ in self.commits()]
        chunks = self.chunks()
        if embed is not None:
            vector = embed(F.col("content"), self.settings.embed.dimension)
        else:
            vector = normalise(F.col("embedding"))
        return self.write(
            self.documents(), chunks.withColumn("embedding", vector.cast("array<float>")), full=True, replaces=replaces
        )

    def _count_terms(self, batch: int) -> None:
        """Term and length statistics of one segment, sorted by term within its files for look-ups."""
        text = self._segments("chunks", CHUNKS, [batch]).select("content")
        terms = search.term_statistics(text).sortWithinPartitions("term")
        terms.write.mode("overwrite").parquet(self._path("segment_terms", f"batch={batch}"))
        search.length_statistics(text).write.mode("overwrite").parquet(self._path("segment_lengths", f"batch={batch}"))

    def _counted(self, table: str, schema: T.StructType, batches: list[int]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(self._path(table, f"batch={b}") for b in batches))

    def _withdrawn(self, batches: list[int]) -> tuple[DataFrame, DataFrame]:
        """Statistics of the chunks whose documents a later segment replaced, worked out once per set of segments.

        Documents that were replaced are looked up by key while they are few; otherwise the text of
        the segments is read once.
        """
        if self._left is None or self._left[0] != tuple(batches):
            stale = self._superseded(batches).withColumnRenamed("_doc", "document_id")
            rows = self._segments("chunks", CHUNKS, batches).select("document_id", "batch", "content")
            keys = search.few_keys(stale, "document_id")
            if keys is not None:
                rows = rows.where(F.col("document_id").isin(keys))
            gone = rows.join(stale, ["document_id", "batch"])
            terms = search.term_statistics(gone).withColumn("df", -F.col("df"))
            lengths = search.length_statistics(gone).select(*((-F.col(name)).alias(name) for name in LENGTHS.names))
            self._left = (tuple(batches), cut_lineage(terms), cut_lineage(lengths))
        return self._left[1:]

    def analyse(self) -> None:
        """Adds the statistics of segments that were committed without them."""
        for batch in self._visible():
            try:
                self._counted("segment_lengths", LENGTHS, [batch])
            except AnalysisException as error:
                if not is_missing(error):
                    raise
                self._count_terms(batch)

    def statistics(self) -> dict[str, DataFrame]:
        """``terms`` and ``totals`` of the present corpus for :func:`docweave.operators.search.rerank`.

        They are the sums over the visible segments less what was replaced; the text is not read. Empty
        for an empty store, or if a segment has none (see :meth:`analyse`).
        """
        batches = self._visible()
        if not batches:
            return {}
        try:
            terms = self._counted("segment_terms", TERMS, batches)
            lengths = self._counted("segment_lengths", LENGTHS, batches)
        except AnalysisException as error:
            if is_missing(error):
                return {}
            raise
        if len(batches) > 1:
            gone_terms, gone_lengths = self._withdrawn(batches)
            terms, lengths = terms.unionByName(gone_terms), lengths.unionByName(gone_lengths)
        if self._totals is None or self._totals[0] != tuple(batches):
            # one row, kept in the plan
            totals = search.merged_totals(lengths)
            self._totals = (tuple(batches), self.spark.createDataFrame(totals.toArrow(), totals.schema))
        return {"terms": search.merged_terms(terms), "totals": self._totals[1]}

    def stats(self) -> DataFrame:
        return index_stats(self.chunks(), self.documents(), self.settings)

    def save_figures(self) -> None:
        self.stats().select("num_vectors", "dimension", "num_documents", "similarity_metric").coalesce(1).write.mode(
            "overwrite"
        ).json(self._path("metadata"))

    def export(self, path: str) -> None:
        """Documents, chunks and figures as JSON with ISO timestamps."""
        path = path.rstrip("/")
        self.documents().write.mode("overwrite").json(f"{path}/documents")
        self.chunks().write.mode("overwrite").json(f"{path}/chunks")
        system_stats(self.chunks(), self.documents(), self.settings).write.mode("overwrite").json(
            f"{path}/system_stats"
        )
