import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.config import Settings
from docweave.functions import vectors as V
from docweave.operators import search as S
from docweave.operators.topk import first_rows, top_k

DIM = 6


def brute(questions, corpus, k, metric):
    out = {}
    for qid, q in questions:
        rows = []
        for cid, c in corpus:
            if c is None or len(c) != DIM:
                continue
            q64, c64 = np.float32(q).astype(float), np.float32(c).astype(float)
            if metric == "cosine":
                scale = np.linalg.norm(q64) * np.linalg.norm(c64)
                score = float(q64 @ c64) / scale if scale else 0.0
            else:
                score = 1 / (1 + float(((q64 - c64) ** 2).sum()))
            rows.append((-round(score, 8), cid))
        out[qid] = [cid for _, cid in sorted(rows)[:k]]
    return out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    corpus = [(f"c{i:03d}", rng.normal(size=DIM).tolist()) for i in range(120)]
    # a third of all vectors are copies of one, so ties are settled by id
    corpus += [(f"d{i:03d}", corpus[0][1]) for i in range(60)]
    corpus += [("zero", [0.0] * DIM), ("short", [1.0] * (DIM - 1)), ("none", None)]
    questions = [(i, rng.normal(size=DIM).tolist()) for i in range(25)] + [(99, corpus[0][1])]
    return questions, corpus


def frames(spark, data):
    questions, corpus = data
    return (
        spark.createDataFrame(questions, "question_id long, embedding array<float>"),
        spark.createDataFrame(corpus, "chunk_id string, embedding array<float>").repartition(5),
    )


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("bytes_", [64 << 20, 0])
@pytest.mark.parametrize("k", [1, 7, 500])
def test_nearest_is_exact(spark, data, metric, bytes_, k, monkeypatch):
    monkeypatch.setattr(S, "ASK_BLOCK_ROWS", 10)
    monkeypatch.setattr(S, "FLOOR_SAMPLE", 0.3)
    monkeypatch.setattr(S, "CELLS_PER_STEP", 300)
    questions, corpus = frames(spark, data)
    found = S.nearest(questions, corpus, k, metric, DIM, broadcast_bytes=bytes_)
    got = {}
    for row in found.orderBy("question_id", "vector_rank").collect():
        got.setdefault(row["question_id"], []).append(row["chunk_id"])
    assert got == brute(*data, k, metric)


def test_similar_leaves_itself_out(spark, data):
    _, corpus = frames(spark, data)
    references = spark.createDataFrame([("c005",), ("d001",), ("none",), ("absent",)], "chunk_id string")
    got = {}
    for row in S.similar(references, corpus, 4, "cosine", DIM).orderBy("reference_id", "rank").collect():
        got.setdefault(row["reference_id"], []).append(row["chunk_id"])
    vectors = dict(data[1])
    for key in ("c005", "d001"):
        others = [(i, v) for i, v in data[1] if i != key]
        assert got[key] == brute([(key, vectors[key])], others, 4, "cosine")[key]
    assert set(got) == {"c005", "d001"}


def test_search_plan_has_no_cross_join(spark, data):
    questions, corpus = frames(spark, data)
    plan = S.nearest(questions, corpus, 3, dimension=DIM)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_floors_cut_what_tasks_give_back(spark, data, monkeypatch):
    """Passes shuffle no vectors, and with floors their tasks give back fewer rows, none of them needed less."""
    monkeypatch.setattr(S, "ASK_BLOCK_ROWS", 10)
    monkeypatch.setattr(S, "FLOOR_SAMPLE", 0.5)
    scan, passes = S._scan, []

    def recorded(corpus, questions, k, metric, schema, floor=None):
        out = scan(corpus, questions, k, metric, schema, floor)
        if floor is not None:
            bare = scan(corpus, questions, k, metric, schema)
            passes.append((out._jdf.queryExecution().executedPlan().toString(), out.count(), bare.count(), len(questions[0])))
        return out

    monkeypatch.setattr(S, "_scan", recorded)
    questions, corpus = frames(spark, data)
    stored = S.fresh_path(spark, "vectors")
    corpus.write.parquet(stored)
    corpus = spark.read.parquet(stored)
    found = S.nearest(questions, corpus, 4, "cosine", DIM, broadcast_bytes=0)
    assert found.count() == 4 * 26
    assert len(passes) == 3 and sum(rows for *_, rows in passes) == 26
    assert all("Exchange" not in plan for plan, *_ in passes)
    assert sum(cut for _, cut, *_ in passes) < 0.75 * sum(bare for _, _, bare, _ in passes)


def test_passes_without_rows(spark, data):
    questions, corpus = frames(spark, data)
    assert S.nearest(questions, corpus.limit(0), 4, "cosine", DIM, broadcast_bytes=0).isEmpty()
    wrong = questions.withColumn("embedding", F.slice("embedding", 1, 2))
    assert S.nearest(wrong, corpus, 4, "cosine", DIM, broadcast_bytes=0).isEmpty()


def test_passes_work_an_unsaved_corpus_out_once(spark, data, monkeypatch):
    monkeypatch.setattr(S, "ASK_BLOCK_ROWS", 10)
    questions, corpus = frames(spark, data)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    unsaved = corpus.mapInArrow(counted, corpus.schema)
    found = S.nearest(questions, unsaved, 4, "cosine", DIM, broadcast_bytes=0).count()
    assert found == 4 * len(data[0]) and seen.value == len(data[1])


def test_unsaved_corpus_is_embedded_once(spark):
    chunks = S.embed_chunks(spark.createDataFrame([("c", "some text")], "chunk_id string, content string"))
    asked = S.embed_questions(spark.createDataFrame([("q", "text")], "question_id string, question string"))
    plan = S.nearest(asked, chunks, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_hash_vectors(spark):
    df = spark.createDataFrame([("The the CAT",), ("",), (None,)], "t string")
    rows = [r["v"] for r in df.select(V.token_hash(F.col("t"), 16).alias("v")).collect()]
    assert np.isclose(np.linalg.norm(rows[0]), 1) and sorted(rows[0])[-2:] == pytest.approx([1 / 5**0.5, 2 / 5**0.5])
    assert rows[1] == rows[2] == [0.0] * 16


def test_cosine_of_zero_vectors(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<float>, b array<float>")
    assert [round(r[0], 9) for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0]


TEXTS = [
    ("d1_chunk_0", "d1", "alpha beta gamma delta"),
    ("d1_chunk_1", "d1", "alpha alpha alpha epsilon"),
    ("d2_chunk_0", "d2", "beta zeta"),
    ("d3_chunk_0", "d3", "omega psi chi"),
]


@pytest.fixture
def small(spark):
    chunks = spark.createDataFrame(TEXTS, "chunk_id string, document_id string, content string").select(
        "*", F.lit("title").alias("document_title"), F.lit("url").alias("document_url")
    )
    documents = spark.createDataFrame(
        [("d1", "One", "u1", 10), ("d2", "Two", "u2", 20)], "doc_id string, title string, url string, size int"
    ).withColumn("short_description", F.lit(""))
    questions = spark.createDataFrame([("q1", "alpha?"), ("q2", "beta zeta"), ("q3", "  ")], "question_id string, question string")
    return questions, S.embed_chunks(chunks), documents


def ranks(df):
    out = {}
    for r in df.orderBy("question_id", "rank").collect():
        out.setdefault(r["question_id"], []).append(r["chunk_id"])
    return out


def test_retrieve_reranks_and_keeps_orphans(small):
    questions, chunks, documents = small
    found = S.retrieve(questions, chunks, documents, top=2)
    got = ranks(found)
    assert got["q1"] == ["d1_chunk_1", "d1_chunk_0"] and got["q2"][0] == "d2_chunk_0" and "q3" not in got
    deep = S.retrieve(questions, chunks, documents, top=4).where("chunk_id = 'd3_chunk_0'").first()
    assert deep["doc_title"] is None and deep["document_title"] == "title"


def test_rerank_cap(small):
    questions, chunks, documents = small
    capped = Settings().override({"search": {"rerank_top_k": 2, "strict_rerank_cap": True}})
    open_ = Settings().override({"search": {"rerank_top_k": 2}})
    count = lambda s: S.retrieve(questions, chunks, documents, s, top=4).where("question_id = 'q1'").count()
    assert count(capped) == 2 and count(open_) == 4


def test_own_scorer(small):
    questions, chunks, documents = small
    found = S.retrieve(questions, chunks, documents, top=1, scorer=lambda q, c: -F.length(c))
    assert ranks(found)["q1"] == ["d2_chunk_0"]


def test_filter_before_and_after(small):
    questions, chunks, documents = small
    before = S.retrieve_filtered(questions, chunks, documents, filters={"size": {"gte": 15}}, top=1)
    assert ranks(before) == {"q1": ["d2_chunk_0"], "q2": ["d2_chunk_0"]}
    after = S.retrieve_filtered(questions, chunks, documents, document_ids=["d1"], top=1, post_filter=True)
    assert set(ranks(after)) == {"q1", "q2"}
    everything = S.retrieve_filtered(questions, chunks, documents, document_ids=[], top=4)
    assert len(ranks(everything)["q1"]) == 4


def test_documents_by_rank(small):
    questions, chunks, documents = small
    found = S.retrieve(questions, chunks, documents, top=4)
    got = [r["doc_id"] for r in S.documents_by_rank(found).where("question_id = 'q1'").orderBy("position").collect()]
    assert got == ["d1", "d2"]


def test_salted_top_k_equals_plain(spark):
    # one key holds most rows
    df = spark.range(3000).select(F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 7).alias("g"), "id", F.pmod(F.hash("id"), F.lit(50)).alias("v"))
    order = [F.col("v").desc(), F.col("id")]
    plain = {tuple(r) for r in top_k(df, ["g"], order, 9).collect()}
    salted = {tuple(r) for r in top_k(df, ["g"], order, 9, salt_on="id", salts=8).collect()}
    assert plain == salted


@pytest.mark.parametrize("limit", [1_000_000, 10])
def test_first_rows(spark, limit):
    df = spark.range(500).select(F.sha2(F.col("id").cast("string"), 256).alias("k")).repartition(6)
    wanted = sorted(r["k"] for r in df.collect())[:137]
    assert sorted(r["k"] for r in first_rows(df, "k", 137, sort_limit=limit).collect()) == wanted


def test_model_embedder_plugs_in(small):
    def make_predict():
        import numpy as np

        def predict(texts):
            return np.array([[float(t.count("a")), float(t.count("e"))] for t in texts], dtype=np.float32)

        return predict

    questions, chunks, documents = small
    embed = V.model_embedder(make_predict, 2, 3)
    two = Settings().override({"embed": {"dimension": 2}, "search": {"rerank": False}})
    chunks = S.embed_chunks(chunks.drop("embedding"), two, embed)
    found = S.retrieve(questions, chunks, documents, two, top=1, embed=embed)
    # 'alpha?' counts (2, 0); the chunks of d1 count (6, 2) and (6, 1)
    assert ranks(found)["q1"] == ["d1_chunk_1"]
    assert found.where("question_id = 'q1'").first()["score"] == pytest.approx(6 / 37**0.5, abs=1e-6)


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("scale", [1.0, 1e-6, 1e12])
def test_short_products_rule_out_most_pairs(metric, scale, monkeypatch):
    """Most pairs are settled in single precision; ties, zero questions and vectors of any size end as by brute force."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    corpus = np.float32(rng.normal(size=(3000, DIM)) * scale).astype(float)
    corpus[1000:1400] = corpus[7]
    corpus[40] = 0.0
    questions = np.vstack([corpus[:60], np.zeros((2, DIM)), corpus[5:8] + 1e-4 * scale])
    scored, one = [], S._scored
    monkeypatch.setattr(S, "_scored", lambda metric, raw: scored.append(raw.size) or one(metric, raw))
    monkeypatch.setattr(S, "CELLS_PER_STEP", 200 * len(questions))
    best = S._Best(questions, 4, metric)
    for at in range(0, 3000, 700):
        best.add(pa.array(np.arange(at, min(at + 700, 3000))), corpus[at : at + 700])
    kept = best.merge().to_pydict()
    for ask, question in enumerate(questions):
        if metric == "cosine":
            lengths = np.linalg.norm(corpus, axis=1) * np.linalg.norm(question)
            exact = np.round(np.divide(corpus @ question, lengths, out=np.zeros(3000), where=lengths > 0), 8) + 0.0
        else:
            exact = np.round(1 / (1 + ((corpus - question) ** 2).sum(axis=1)), 8)
        wanted = np.lexsort((np.arange(3000), -exact))[:4].tolist()
        assert [i for a, i in zip(kept["ask"], kept["id"], strict=True) if a == ask] == wanted
    if scale == 1.0:
        assert sum(scored) < 0.3 * 3000 * len(questions)


def test_hash_vectors_are_made_in_slices(spark, monkeypatch):
    """Rows of one batch are counted a few at a time, with the same vectors; nulls and blanks give zeros."""
    texts = [(i, t) for i, t in enumerate(["salt pepper", None, "  ", "salt salt", "pepper"])]
    df = spark.createDataFrame(texts, "id long, text string").coalesce(1)
    made = lambda: [r["v"] for r in df.select("id", V.token_hash(F.col("text"), 8).alias("v")).orderBy("id").collect()]
    whole = made()
    monkeypatch.setattr(V, "SLICE", 2)
    assert made() == whole and not any(whole[1]) and not any(whole[2])
    assert sum(x * x for x in whole[3]) == pytest.approx(1.0)
