import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docweave.config import ChunkSettings
from docweave.operators.chunk import chunk_documents, pack_words, window_pieces
from docweave.operators.extract import build_documents


def by_hand(text, size, overlap):
    """The packing rule word by word; long words are cut into windows first."""
    words = []
    for word in text.split():
        if len(word) <= size:
            words.append(word)
            continue
        at = 0
        while True:
            words.append(word[at : at + size])
            if at + size >= len(word):
                break
            at += size - overlap
    chunks, buffer = [], []
    for word in words:
        length = len(" ".join(buffer))
        if buffer and length + 1 + len(word) > size:
            chunks.append(" ".join(buffer))
            while buffer and (length > overlap or length + 1 + len(word) > size):
                buffer.pop(0)
                length = len(" ".join(buffer))
        buffer.append(word)
    return [*chunks, " ".join(buffer)] if buffer else []


@given(
    st.lists(st.text("abé", min_size=1, max_size=30), max_size=60),
    st.integers(8, 40),
    st.integers(0, 7),
)
@settings(max_examples=300, deadline=None)
def test_packing_matches_the_rule(words, size, overlap):
    text = " ".join(words)
    starts, ends = pack_words(text, size, overlap)
    assert [text[a:b] for a, b in zip(starts, ends)] == by_hand(text, size, overlap)


def chunks_of(spark, texts, **options):
    rows = [(str(i), "t", f"u{i}", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id string, title string, url string, content string")
    kept = chunk_documents(df, **options).orderBy("document_id", "chunk_index").collect()
    return {str(i): [r for r in kept if r["document_id"] == str(i)] for i in range(len(texts))}


def test_edges(spark):
    got = chunks_of(spark, ["", "x" * 99, "x" * 100, "x" * 1000, "x" * 2500, "  "])
    assert [len(got[k]) for k in "012345"] == [0, 0, 1, 1, 3, 0]
    assert [len(r["content"]) for r in got["4"]] == [1000, 1000, 900]
    assert got["4"][0]["chunk_id"] == "4_chunk_0" and got["4"][0]["total_chunks"] == 3


def test_numbering_comes_before_the_length_filter(spark):
    text = "a" * 990 + " " + "b" * 990 + " " + "c" * 40
    rows = chunks_of(spark, [text])["0"]
    assert [r["chunk_index"] for r in rows] == [0, 1] and {r["total_chunks"] for r in rows} == {3}


def test_offsets_run_over_kept_chunks(spark):
    random.seed(3)
    text = " ".join("w" * random.randint(1, 12) for _ in range(900))
    rows = chunks_of(spark, [text])["0"]
    running = 0
    for row in rows:
        assert (row["start_char"], row["end_char"]) == (running, running + len(row["content"]))
        assert text[row["true_start"] :].startswith(row["content"])
        running = row["end_char"]


def test_every_word_is_covered(spark):
    text = " ".join(f"word{i}" for i in range(2000))
    rows = chunks_of(spark, [text])["0"]
    seen = {w for r in rows for w in r["content"].split()}
    assert seen == set(text.split())


@pytest.mark.parametrize("n", [1, 999, 1000, 1001, 1800, 1801, 2600])
def test_windows(spark, n):
    text = "".join(chr(97 + i % 26) for i in range(n))
    rows = chunks_of(spark, [text], chunk=ChunkSettings(min_size=0), pieces=window_pieces)["0"]
    assert rows[-1]["true_start"] + len(rows[-1]["content"]) == n
    for row in rows:
        assert row["content"] == text[row["true_start"] : row["true_start"] + 1000]


def test_packing_is_planned_once(spark):
    """No inferred filter may repeat the packing below itself."""
    df = spark.createDataFrame([("1", "a b")], "doc_id string, content string")
    plan = chunk_documents(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_chunks_of_unsaved_documents(spark):
    """Pages are extracted and packed in one plan, whatever their text is made with."""
    html = "<title>A &amp; B</title><article>" + "salt &amp; pepper " * 20 + "</article>"
    pages = spark.createDataFrame([(0, "http://a/x", html), (1, "http://a/y", None)], "page_id long, url string, html string")
    found = chunk_documents(build_documents(pages)).collect()
    assert [(r["document_title"], r["content"]) for r in found] == [("A  B", " ".join(["salt & pepper"] * 20))]
