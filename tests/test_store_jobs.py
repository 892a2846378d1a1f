import json

import pytest
from pyspark.sql import functions as F

from docweave import DocumentEngine, Settings
from docweave.operators import metrics as M
from docweave.operators import search as S
from docweave.operators.upsert import latest, replace_chunks, upsert_documents
from docweave.schemas import CHUNKS, DOCUMENTS
from docweave.sources import pages as SP
from docweave.sources import questions as SQ
from docweave.sources import runlog as SR
from docweave.sources.store import CorpusStore
from docweave.streaming.ingest import ingest_stream, page_stream
from docweave.streaming.runlog import log_stream, rolling_counts, write_counts

PAGES = "page_id long, url string, html string"
WARM_JOBS = 27


def html(word, links=""):
    body = ". ".join(f"The {word} sentence number {i} has some {word} text in it" for i in range(30))
    return f"<html><head><title>About {word}</title></head><body><article>{body}</article>{links}</body></html>"


def table(spark, rows):
    return spark.createDataFrame(rows, PAGES)


@pytest.fixture
def engine(spark, tmp_path):
    return DocumentEngine(spark, f"file://{tmp_path}/store")


def test_engine_end_to_end(spark, engine, tmp_path):
    pages = table(spark, [(1, "http://x/a", html("apple")), (2, "http://x/b", html("banana")), (3, "http://x/c", None)])
    report = engine.ingest(pages)
    assert (report.pages_scraped, report.pages_failed, report.error_count) == (2, 1, 1)
    assert report.total_chunks_created == engine.store.chunks().count() > 2
    assert report.total_tokens_processed > 500
    answers = engine.query(["banana text", "banana text", "apple"]).orderBy("question_id").collect()
    assert len(answers) == 3 and answers[0]["answer"] == answers[1]["answer"]
    assert "banana" in answers[0]["answer"] and answers[0]["sources"][0]["url"] == "http://x/b"
    before = answers[2]["answer"]
    engine.analyse()
    assert engine.query(["apple"]).first()["answer"] == before
    found = engine.search_documents(["banana"], 10).orderBy("position").collect()
    assert found[0]["url"] == "http://x/b" and len({r["doc_id"] for r in found}) == len(found)
    assert engine.document_by_url("http://x/a").count() == 1
    chunk = engine.store.chunks().first()["chunk_id"]
    assert engine.chunk(chunk).count() == 1 and engine.similar_chunks([chunk], 2).count() == 2
    stats = {r["name"]: r["value"] for r in engine.stats().collect()}
    assert stats["index.num_documents"] == "2" and stats["chunk.size"] == "1000"
    answers, summary = engine.batch(["apple", "banana"])
    assert [r["question_id"] for r in answers.collect()] == [0, 1]
    assert summary.first()["successful_questions"] == 2 and summary.first()["total_processing_time"] > 0
    given = spark.createDataFrame([("10", "apple"), ("2", "banana"), ("x", "apple")], "question_id string, question string").coalesce(1)
    assert [r["question_id"] for r in engine.batch(given)[0].collect()] == ["10", "2", "x"]
    assert report.extraction_time > 0 and report.embedding_time > 0 and not report.budget_hit
    engine.store.write_crawl_report(f"file://{tmp_path}/report")
    report_rows = {(r["section"], r["name"]): r["value"] for r in spark.read.json(f"file://{tmp_path}/report").collect()}
    assert report_rows["total", "failed_crawls"] == "1" and report_rows["config", "max_pages"] == "150"
    engine.export(f"file://{tmp_path}/out")
    exported = spark.read.json(f"file://{tmp_path}/out/documents")
    assert exported.count() == 2 and "T" in exported.first()["created_at"]
    with pytest.raises(ValueError):
        engine.query([])


def test_statistics_add_up_over_segments(spark, tmp_path):
    store = CorpusStore(spark, f"file://{tmp_path}/store")
    assert store.statistics() == {}

    def put(texts, **options):
        documents = spark.createDataFrame([{"doc_id": n} for n in texts], DOCUMENTS)
        rows = [{"chunk_id": f"{n}{i}", "document_id": n, "content": c} for n, parts in texts.items() for i, c in enumerate(parts)]
        return store.write(documents, spark.createDataFrame(rows, CHUNKS), **options)

    def check():
        told, chunks = store.statistics(), store.chunks()
        rows = lambda df: sorted(tuple(r) for r in df.collect())
        assert rows(told["terms"]) == rows(S.term_statistics(chunks))
        assert rows(told["totals"]) == rows(S.corpus_statistics(chunks))

    put({"a": ["alpha beta", "beta beta gamma"], "b": ["alpha", None, ""]})
    check()
    put({"a": ["delta"], "c": ["gamma gamma alpha"]})
    check()
    put({"b": [], "c": ["beta"], "a": ["delta epsilon"]})
    check()
    store.compact()
    check()
    put({"c": ["zeta"]})
    check()
    store.clear()
    check()


def test_segments_without_statistics(spark, tmp_path, monkeypatch):
    store = CorpusStore(spark, f"file://{tmp_path}/store")
    chunks = spark.createDataFrame([{"chunk_id": "a0", "document_id": "a", "content": "alpha beta"}], CHUNKS)
    with monkeypatch.context() as without:
        without.setattr(CorpusStore, "_count_terms", lambda self, batch: None)
        store.write(spark.createDataFrame([{"doc_id": "a"}], DOCUMENTS), chunks)
    assert store.statistics() == {}
    store.analyse()
    assert {r["term"] for r in store.statistics()["terms"].collect()} == {"alpha", "beta"}


def test_a_warm_question_takes_few_jobs(spark, engine):
    for part in range(3):
        engine.ingest(table(spark, [(i, f"http://x/{i}", html(f"word{i}")) for i in range(part, 8, 2)]))
    engine.retrieve(["word3 text"]).collect()
    spark.sparkContext.setJobGroup("warm", "one question")
    try:
        assert engine.retrieve(["word3 text"]).first()["doc_url"] == "http://x/3"
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("warm"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs < WARM_JOBS


def test_hit_text_is_read_by_key(spark, engine):
    engine.ingest(table(spark, [(i, f"http://x/{i}", html(f"word{i}")) for i in range(6)]))
    plan = engine.retrieve(["word3 text"])._jdf.queryExecution().optimizedPlan().toString()
    physical = engine.retrieve(["word3 text"])._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in physical.splitlines() if "Scan parquet" in line and "content:string" in line and "PushedFilters" in line]
    assert scans and any("chunk_id" in line.split("PushedFilters")[1] for line in scans), plan


def test_ingest_from_seeds_uses_all_of_them(spark, engine):
    pages = table(
        spark,
        [(1, "http://x/a", html("apple", '<a href="/b">b</a>')), (2, "http://x/b", html("banana")), (3, "http://y/", html("cherry"))],
    )
    report = engine.ingest(pages, ["http://x/a", "http://y/", "nonsense"], max_depth=1)
    assert {r["url"] for r in engine.store.documents().collect()} == {"http://x/a", "http://x/b", "http://y/"}
    assert report.pages_scraped == 3
    assert engine.store.documents().where("url = 'http://x/b'").first()["crawl_depth"] == 1
    with pytest.raises(ValueError):
        engine.ingest(pages, ["nonsense"])


def test_relevance_rule_in_ingest(spark, tmp_path):
    rule = Settings().override({"relevance": {"content_terms": ["apple", "sentence"]}})
    engine = DocumentEngine(spark, f"file://{tmp_path}/s", rule)
    engine.ingest(table(spark, [(1, "http://x/a", html("apple")), (2, "http://x/b", html("banana"))]))
    assert [r["url"] for r in engine.store.documents().collect()] == ["http://x/a"]


def test_reingest_replaces_documents_and_chunks(spark, engine):
    engine.ingest(table(spark, [(1, "http://x/a", html("apple")), (2, "http://x/b", html("banana"))]))
    first = engine.store.chunks().count()
    engine.ingest(table(spark, [(1, "http://x/a", html("apricot"))]))
    assert engine.store.documents().count() == 2
    titles = {r["title"] for r in engine.store.documents().collect()}
    assert titles == {"About apricot", "About banana"}
    chunks = engine.store.chunks()
    assert chunks.groupBy("chunk_id").count().where("count > 1").isEmpty()
    assert chunks.where("content like '%apple%'").isEmpty() and chunks.count() >= first - 1
    before = {r["chunk_id"] for r in chunks.collect()}
    engine.store.compact()
    assert {r["chunk_id"] for r in engine.store.chunks().collect()} == before
    engine.store.rebuild()
    assert {r["chunk_id"] for r in engine.store.chunks().collect()} == before
    engine.clear()
    assert engine.store.chunks().isEmpty() and engine.store.documents().isEmpty()


def test_empty_store(spark, engine):
    assert not engine.store.exists()
    assert engine.query(["anything"]).first()["no_results_found"] is True


def test_unfinished_segment_is_not_seen(spark, engine):
    engine.ingest(table(spark, [(1, "http://x/a", html("apple"))]))
    rows = engine.store.documents().withColumn("doc_id", F.lit("half"))
    rows.write.parquet(engine.store.root + "/documents/batch=7")
    assert engine.store.documents().where("doc_id = 'half'").isEmpty()


def test_streamed_ingest_equals_batch(spark, tmp_path):
    rows = [(i, f"http://x/{i % 9}", html(f"word{i}")) for i in range(12)]
    folder = f"{tmp_path}/in"
    for part in range(3):
        table(spark, rows[part * 4 : part * 4 + 4]).coalesce(1).write.mode("append").parquet(folder)
    store = CorpusStore(spark, f"file://{tmp_path}/streamed")
    state = f"file://{tmp_path}/state"
    ingest_stream(page_stream(spark, folder, 1), store, state).awaitTermination()
    assert len(store.commits()) == 3
    engine = DocumentEngine(spark, f"file://{tmp_path}/batch")
    engine.ingest(table(spark, rows[:9]))
    engine.ingest(table(spark, rows[9:]))
    key = lambda s: sorted((r["chunk_id"], r["content"]) for r in s.chunks().collect())
    assert key(store) == key(engine.store)
    # nothing new: nothing changes; a replayed segment leaves the same table
    ingest_stream(page_stream(spark, folder, 1), store, state).awaitTermination()
    assert len(store.commits()) == 3 and key(store) == key(engine.store)


def arrive(spark, folder, *rows):
    table(spark, list(rows)).coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("between", ["compact", "ingest", "rebuild", "clear", "nothing"])
def test_other_writers_between_two_runs_of_a_stream(spark, tmp_path, between):
    folder, root, state = f"{tmp_path}/in", f"file://{tmp_path}/store", f"file://{tmp_path}/state"
    engine = DocumentEngine(spark, root)
    run = lambda: ingest_stream(page_stream(spark, folder, 1), CorpusStore(spark, root), state).awaitTermination()
    urls = lambda: sorted(r["url"] for r in CorpusStore(spark, root).documents().collect())
    arrive(spark, folder, (1, "http://x/1", html("one")), (2, "http://x/2", html("two")))
    run()
    if between == "ingest":
        engine.ingest(table(spark, [(9, "http://x/9", html("nine"))]))
    elif between != "nothing":
        getattr(engine.store, between)()
    arrive(spark, folder, (3, "http://x/3", html("three")))
    run()
    kept = [] if between == "clear" else ["http://x/1", "http://x/2"]
    wanted = [*kept, "http://x/3", *(["http://x/9"] if between == "ingest" else [])]
    assert urls() == wanted
    segments = [batch for batch, _ in CorpusStore(spark, root).commits()]
    assert len(segments) == len(set(segments))
    run()
    assert urls() == wanted


def test_a_replayed_stream_batch_is_skipped(spark, tmp_path):
    store = CorpusStore(spark, f"file://{tmp_path}/store")
    documents, chunks = spark.createDataFrame([], DOCUMENTS), spark.createDataFrame([], CHUNKS)
    assert store.write(documents, chunks, owner="s:0") == 0 and store.committed_by("s:0") and not store.committed_by("s:1")
    with pytest.raises(ValueError):
        store.write(documents, chunks, batch=0)
    assert store.write(documents, chunks, full=True) == 1


def test_a_read_error_is_no_empty_store(spark, tmp_path):
    store = CorpusStore(spark, "nosuchscheme://host/store")
    with pytest.raises(Exception):
        store.commits()
    assert CorpusStore(spark, f"file://{tmp_path}/none").commits() == []


def test_latest_page_of_a_url(spark):
    # one URL holds most of the table, and its newest copy occurs twice
    rows = [(i, "http://x/hot", f"v{i}") for i in range(30)] + [(29, "http://x/hot", "v29"), (40, "http://x/b", "b"), (1, "http://x/c", None)]
    got = sorted(tuple(r) for r in SP.latest_pages(table(spark, rows)).collect())
    assert got == [(1, "http://x/c", None), (29, "http://x/hot", "v29"), (40, "http://x/b", "b")]


def test_upsert_operators(spark):
    stored = spark.createDataFrame([("a", 1), ("b", 1)], "doc_id string, v int")
    incoming = spark.createDataFrame([("b", 2), ("c", 2)], "doc_id string, v int")
    assert {tuple(r) for r in upsert_documents(stored, incoming).collect()} == {("a", 1), ("b", 2), ("c", 2)}
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z")], "k string, v int, t string")
    assert {tuple(r) for r in latest(rows, "k", "v").collect()} == {("a", 3, "y"), ("b", 2, "z")}
    old = spark.createDataFrame([("a_0", "a"), ("a_1", "a"), ("b_0", "b")], "chunk_id string, document_id string")
    new = spark.createDataFrame([("a_0", "a")], "chunk_id string, document_id string")
    documents = spark.createDataFrame([("a",)], "doc_id string")
    assert {r["chunk_id"] for r in replace_chunks(old, new, documents).collect()} == {"a_0", "b_0"}


def test_question_file(spark, tmp_path):
    (tmp_path / "q.txt").write_text("# comment\n\n  First one?  \nSecond\n   # also\n")
    rows = SQ.read_questions(spark, f"file://{tmp_path}/q.txt").orderBy("line").collect()
    assert [(r["line"], r["question"]) for r in rows] == [(2, "First one?"), (3, "Second")]


def test_seeds(spark):
    df = spark.createDataFrame([("http://a",), ("https://b",), ("ftp://c",), (None,)], "url string")
    kept, rejected = SP.split_seeds(df)
    assert kept.count() == 2 and rejected.count() == 2


def test_crawl_figures(spark):
    log = spark.createDataFrame(
        [("a", "success", None, 2.0, 10), ("b", "success", None, 4.0, None), ("c", "failed", "HTTP 404", 9.0, None)],
        "url string, status string, error_message string, response_time double, content_length int",
    )
    row = M.crawl_metrics(log).first()
    assert (row["pages_scraped"], row["pages_failed"], row["average_response_time"]) == (2, 1, 3.0)
    assert row["total_content_length"] == 10 and row["error_count"] == 1
    assert [tuple(r) for r in M.crawl_errors(log).collect()] == [("c", "HTTP 404")]
    none = M.crawl_metrics(log.limit(0)).first()
    assert none["success_rate"] == 0.0 and none["total_content_length"] == 0


LINES = [
    ("2024-01-01T10:05:00", "ingestion", "success", {"pages_scraped": 3, "errors": ["a", "b"]}),
    ("2024-01-01T10:40:00", "batch_query", "success", {"summary": {"total_questions": 5}, "results": [1, 2, 3]}),
    ("2024-01-01T11:10:00", "ingestion", "failed", None),
    ("2024-01-01T15:00:00", "ingestion", "success", {"pages_scraped": 1}),
]


def write_lines(path, lines):
    with open(path, "w") as f:
        for ts, operation, status, metrics in lines:
            payload = {"operation": operation, "status": status, "metrics": metrics, "timestamp": ts}
            f.write(json.dumps({"timestamp": ts, "source_ip": "::1", "payload": payload}) + "\n")


def test_run_log(spark, tmp_path):
    write_lines(tmp_path / "log.json", LINES)
    log = SR.read_log(spark, f"file://{tmp_path}/log.json")
    rows = {(r["operation"], r["name"], r["value"]) for r in SR.scan_log(log).collect()}
    assert rows == {
        ("ingestion", "pages_scraped", "3"),
        ("ingestion", "pages_scraped", "1"),
        ("ingestion", "errors", "2"),
        ("batch_query", "total_questions", "5"),
        ("batch_query", "results_returned", "3"),
    }
    SR.append_log(log, f"file://{tmp_path}/copy")
    SR.append_log(log, f"file://{tmp_path}/copy")
    assert SR.read_log(spark, f"file://{tmp_path}/copy").count() == 8


def test_rolling_counts_drop_late_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write_lines(tmp_path / "in" / "1.json", LINES)
    source = f"file://{tmp_path}/in"

    def run():
        counts = rolling_counts(log_stream(spark, source))
        write_counts(counts, f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination()
        return {(str(r["window_start"]), r["operation"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}

    first = run()
    assert ("2024-01-01 10:00:00", "ingestion", 1) in first and ("2024-01-01 11:00:00", "ingestion", 1) in first
    # windows before the watermark are closed: a late row changes nothing
    write_lines(tmp_path / "in" / "2.json", [("2024-01-01T10:06:00", "ingestion", "success", None), ("2024-01-02T00:00:00", "ingestion", "success", None)])
    second = run()
    assert first <= second and ("2024-01-01 10:00:00", "ingestion", 2) not in second
    assert ("2024-01-01 15:00:00", "ingestion", 1) in second


def test_writers_that_interleave_lose_nothing(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from docweave.schemas import CHUNKS, DOCUMENTS
    from docweave.sources.store import CorpusStore

    root = f"file://{tmp_path}/shared"

    def rows(names, content):
        documents = spark.createDataFrame([{"doc_id": n, "content": content} for n in names], DOCUMENTS)
        return documents, spark.createDataFrame([{"chunk_id": n, "document_id": n, "content": content} for n in names], CHUNKS)

    def held():
        store = CorpusStore(spark, root)
        documents = {r["doc_id"]: r["content"] for r in store.documents().collect()}
        assert documents == {r["document_id"]: r["content"] for r in store.chunks().collect()}
        assert store.documents().count() == len(documents)
        return documents

    CorpusStore(spark, root).write(*rows("ab", "first"))
    documents, chunks = rows("bc", "slow")

    def meanwhile(stored):
        CorpusStore(spark, root).write(*rows("ad", "quick"))
        CorpusStore(spark, root).compact()
        assert held() == {"a": "quick", "b": "first", "d": "quick"}
        return chunks

    CorpusStore(spark, root).write(documents, meanwhile)
    assert held() == {"a": "quick", "b": "slow", "c": "slow", "d": "quick"}
    CorpusStore(spark, root).compact()
    assert held() == {"a": "quick", "b": "slow", "c": "slow", "d": "quick"}
    with ThreadPoolExecutor(3) as pool:
        ids = list(pool.map(lambda k: CorpusStore(spark, root).write(*rows([f"t{k}"], "thread")), range(3)))
    assert len(set(ids)) == 3 and set(held()) == {"a", "b", "c", "d", "t0", "t1", "t2"}
    CorpusStore(spark, root).clear()
    assert held() == {}
