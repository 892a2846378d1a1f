"""Classifiers on held-out rows, token files by round trip, secrets by a scanner, the pipeline stage by stage."""

import base64
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm import quality_model, secrets, token_store, toxicity
from docweave.llm.common import held_out, table
from docweave.llm.queries import QUERIES

tables = pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
DOCS = "doc_id long, text string, score string, start string, path string"


def frame(spark, texts):
    rows = [(i, t, "", "", "") for i, t in (texts if texts and isinstance(texts[0], tuple) else enumerate(texts))]
    return spark.createDataFrame(rows, DOCS)


@tables
def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    rows = QUERIES["op2_toxicity"](spark, folder).join(table(spark, folder, "labels"), "doc_id").filter("held_out").collect()
    clean = [r["predicted"] for r in rows if r["toxic"] == 0]
    toxic = [r["predicted"] for r in rows if r["toxic"] == 1]
    assert sum(clean) <= 0.01 * len(clean) and sum(toxic) >= 0.8 * len(toxic)


@pytest.fixture(scope="module")
def letters(spark):
    rng = random.Random(1)
    words = ["idiot", "moron", "scum", "pathetic", "the", "and", "house", "river", "green", "table", "hello", "little"]
    return toxicity.letter_costs(toxicity.letter_counts(frame(spark, [" ".join(rng.choice(words) for _ in range(50)) for _ in range(40)])))


@pytest.mark.parametrize("seen, word", [("1d10t", "idiot"), ("$cum", "scum"), ("m0r0n", "moron"), ("idiooot", "idiot"), ("p@th3t1c", "pathetic"), ("hellooo", "hello")])
def test_restoration(letters, seen, word):
    assert toxicity.disguised(seen) and toxicity.restore(seen, letters)[0] == word


def test_spelled_out():
    assert toxicity.hidden_words("you i d i o t! a s.c.u.m and m-o-r-o-n, x") == ["idiot", "scum", "moron"]
    assert toxicity.hidden_words("a b c words") == []


@pytest.mark.parametrize("seen", ["idio7", "iiddiioott", "idi" + 25 * "o" + "t", "1d10t"])
def test_ends_doubles_and_long_runs_are_restored(letters, seen):
    assert toxicity.disguised(seen) and "idiot" in toxicity.restore(seen, letters)


def test_spelled_out_words_are_parted(letters):
    assert not toxicity.disguised("plain") and not toxicity.disguised("letter") and toxicity.spelled_out("1 2 3 4 5") == set()
    assert toxicity.spelled_out("such i d.i-o t here") == {"idiot"}
    for joined, word in (("aidiot", "idiot"), ("thehouseandidiot", "idiot"), ("the1d10tandhouse", "idiot")):
        assert any(word in way for block in toxicity.readings(joined, letters) for way in block)
    # a stretch of many blocks: the word is found wherever it stands
    long = "thehouseandriver" * 20
    for at in (0, 16 * 3, 16 * 10, 16 * 20):
        found = toxicity.readings(long[:at] + "idiot" + long[at:], letters)
        assert any("idiot" in way for block in found for way in block)


def test_one_reading_counts_per_stretch(spark, letters):
    model = toxicity.Model(letters, {"idiot$": 3.0, "idio": 3.0, "scum$": 3.0}, ([0.0, 4.0, 20.0], [0.01, 0.5, 0.99]))
    texts = ["an idiot", "an i d i o t", "a i d.i o-t", "s c u m i d i o t", "scum idiot", "1 2 3 4 5 6", "i d i " + "o " * 3000 + "t"]
    score = {r["doc_id"]: r["score"] for r in toxicity.score_texts(frame(spark, texts), model).collect()}
    assert score[0] == score[1] == score[2] and score[3] == score[4] > score[0] > score[5] and score[6] >= score[0]


def test_disguised_words_score_like_plain_ones(spark, letters):
    model = toxicity.Model(letters, {"idiot$": 5.0}, ([0.0, 4.0, 20.0], [0.01, 0.9, 0.99]))
    texts = ["a plain idiot here", "a plain 1d10t here", "a plain i d i o t here", "a plain house", None, "", "x" * 200_000]
    rows = {r["doc_id"]: r for r in toxicity.score_texts(frame(spark, texts), model).collect()}
    assert all(rows[i]["score"] > 0.8 for i in range(3)) and all(rows[i]["score"] < 0.1 for i in range(3, 7))
    assert rows[1]["restored"] == ["idiot"]
    kept = toxicity.rows_below(frame(spark, texts), model, 0.5)
    assert kept.columns == frame(spark, texts).columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6]
    assert toxicity.score_texts(frame(spark, []), model).count() == 0


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(frame(spark, ["a b", None]), none, ~held_out(F.col("doc_id")))
    assert all(0 <= r["score"] <= 1 for r in toxicity.score_texts(frame(spark, ["a b", None]), model).collect())


@tables
def test_quality_held_out(spark):
    rows = QUERIES["op7_quality_model"](spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    for texts in (["a b", None, "", "z" * 200_000], []):
        model = quality_model.fit(frame(spark, texts), none, ~held_out(F.col("doc_id")))
        rows = quality_model.score_texts(frame(spark, texts), model).collect()
        assert len(rows) == len(texts) and all(0 <= r["score"] <= 1 for r in rows)


def test_temperature():
    rng = np.random.default_rng(0)
    logits = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-logits))).astype(float)
    assert 2.5 < quality_model.fit_temperature(3 * logits, y) < 3.6


ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a   b ", "one two\nthree\n\nfour. Five,six\n seven", "don't we'll 's x's", "<|endoftext|> x",
    "ünï cödé ß words", "tabs\tand\r\nlines", "word.\nThen, more.\n\nEnd", "x,.y", "3.14 and 12,5", "日本語 text", "a b  c", "é é.\nÀ", "²x ⅷ.\nⅷ", "long " * 20_000,
]


def test_token_files(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(vocabulary)
    tokenizer.encode_special_tokens = True
    rng = random.Random(3)
    texts = [*ODD, *(" ".join("".join(rng.choice("abcdeé.,\n'1") for _ in range(rng.randint(1, 7))) for _ in range(40)) for _ in range(60))]
    rows = [(7 * i % 101, t) for i, t in enumerate(texts)] + [(None, "no id"), (3, "shares an id")]
    folder = token_store.token_folder(spark)
    manifest = token_store.write_tokens(frame(spark, rows), vocabulary, folder, frame_ids=100)
    want = sorted((-1 if i is None else i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in rows)
    found = token_store.read_tokens(manifest, folder).collect()
    ids = lambda r: np.frombuffer(r["ids"], "<u4").tolist()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], ids(r)) for r in found) == want
    at = 0
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == at and r["n_tokens"] == len(ids(r))
        at += r["n_tokens"]
    assert [r["doc_id"] or -1 for r in sorted(found, key=lambda r: r["start"])] == sorted(-1 if i is None else i or -1 for i, _ in rows)
    digests = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in token_store.token_digests(manifest, folder).collect()}
    assert digests == {(r["doc_id"], r["start"]): zlib.crc32(bytes(r["ids"])) for r in found}
    assert [r["doc_id"] for r in token_store.read_tokens(manifest, folder, [7]).collect()] == [7]
    again = token_store.write_tokens(frame(spark, rows), vocabulary, folder, frame_ids=100, keep_cache=False)
    assert again.select("part", "n_docs", "n_tokens", "start").collect() == manifest.select("part", "n_docs", "n_tokens", "start").collect()
    empty = token_store.write_tokens(frame(spark, []), vocabulary, folder)
    assert token_store.read_tokens(empty, folder).count() == 0


def test_encoder_forgets_pieces_and_keeps_its_vocabulary():
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    encoder = token_store.Encoder.of(vocabulary, 1000)
    text = "a word " + "x" * 5_000 + " " + "y" * 5_000 + ". and " + "3$" * 5_000
    (first,) = encoder.encode([text])
    assert first[:-4] == np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert max(map(len, [*encoder.known, *encoder.bare])) <= 256  # what is remembered is bounded in bytes
    tokenizer = encoder.tokenizer
    encoder.forget()
    assert not encoder.known and not encoder.older and not encoder.bare
    assert token_store.Encoder.of(vocabulary, 1000).tokenizer is tokenizer
    assert encoder.encode([text]) == [first]


def test_frames_are_independent_and_checked():
    import io

    import zstandard

    out = io.BytesIO()
    writer = token_store.FrameWriter(out, frame_ids=10)
    for i in range(50):
        writer.add(i, np.full(7, i, "<u4").tobytes())
    writer.close()
    data = out.getvalue()
    reader = token_store.FrameReader(io.BytesIO(data), len(data))
    assert [(d, b"".join(p)) for d, _, p in reader.documents({40})] == [(40, np.full(7, 40, "<u4").tobytes())]
    assert reader.touched <= 2
    stream = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert stream == np.repeat(np.arange(50, dtype="<u4"), 7).tobytes()
    broken = bytearray(data)
    broken[int(reader.offsets[-2]) - 3] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(token_store.FrameReader(io.BytesIO(bytes(broken)), len(data)).documents())


def scan(text):
    """The stated patterns, character by character."""
    found, low = [], text.lower() if text.isascii() else "".join(c.lower() if c.isascii() else c for c in text)
    names = ("password", "passwd", "secret", "token", "api_key", "apikey")
    body = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    i = 0
    while i < len(text):
        name = next((n for n in names if low.startswith(n, i)), None)
        if name:
            k = i + len(name)
            k += text[k : k + 1] in ('"', "'") and k < len(text)
            while text[k : k + 1] == " ":
                k += 1
            if text[k : k + 1] in (":", "="):
                k += 1
                while text[k : k + 1] == " ":
                    k += 1
                k += text[k : k + 1] in ('"', "'") and k < len(text)
                start = k
                while text[k : k + 1] in body and k < len(text):
                    k += 1
                if k > start:
                    if k - start >= 8:
                        found.append((i, 0, k))
                    i = k
                    continue
        i += 1
    for kind, prefix, letters, least in ((1, "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 16), (2, "", set("0123456789abcdef"), 32)):
        i = 0
        while i < len(text):
            k = i + len(prefix)
            while text.startswith(prefix, i) and text[k : k + 1] in letters and k < len(text):
                k += 1
            if text.startswith(prefix, i) and k > i + len(prefix):
                if k - i >= least:
                    found.append((i, kind, k))
                i = k
            else:
                i += 1
    return sorted(found)


def test_secrets(spark):
    import public_tokenizers

    rng = random.Random(8)
    parts = ["password", "Token ", "SECRET", "api_key", "apikey", "='", ": ", '" = "', "AKIA", "ABCDEF0123456789", "0a" * 16, "deadbeef", "é ", " ", "abcdefgh", "x", ":", "ſecret=", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(30)) for _ in range(200)] + [None, ""]
    key = base64.b64encode(rng.randbytes(30)).decode()
    texts += [f"use {key} now", "see 550e8400-e29b-41d4-a716-446655440000 and " + "f" * 40, "release-2024-notes-version-12 ok"]
    found = secrets.find_secrets(frame(spark, texts), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    for r in found:
        text = texts[r["doc_id"]] or ""
        base = [(s["start"], secrets.KINDS.index(s["kind"]), s["end"]) for s in r["spans"] if s["kind"] != "dense"]
        assert base == scan(text)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in base) for i in range(3)]
    by_id = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in found}
    assert by_id[202] == [("dense", 4, 4 + len(key.rstrip()))] and by_id[203] == [("hex", 45, 85)] and by_id[204] == []


def test_random_strings_are_dense(spark):
    import string

    import public_tokenizers

    rng = random.Random(9)
    draw = lambda signs, n: "".join(rng.choice(signs) for _ in range(n))
    letters, path = string.ascii_letters, "https://a.com/reset/password/confirmation/account/session/"
    keys = [("", draw(letters, 32)) for _ in range(100)] + [(path, draw(letters + string.digits, 24)) for _ in range(100)]
    keys += [("", draw(letters + string.digits, 40)) for _ in range(100)]
    plain = ["getElementsByTagNameNSWithCallback", "internationalization/of/everything", "Donaudampfschifffahrtsgesellschaft", "com.apple.developer.networking"]
    plain += ["2024-11-30T12-00-00", "haha" * 8, "release-2024-notes-version-12", "HTTP_REQUEST_HEADER_CONTENT_TYPE", "ACGTACGGTTACGATTACCAGT", "=" * 80, "x" * 200_000]
    texts = [f"see {before}{key} now" for before, key in keys] + plain
    spans = {}
    for r in secrets.find_secrets(frame(spark, texts), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect():
        spans[r["doc_id"]] = [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"] if s["kind"] == "dense"]
    for first in (0, 100, 200):
        assert sum(any(keys[i][1] in s or s in keys[i][1] for s in spans[i]) for i in range(first, first + 100)) >= 95
    assert all(not spans[len(keys) + i] for i in range(len(plain)))


@tables
def test_pipeline(spark):
    import corpus_pipeline as P

    folder = "/root/testdata/sf0.001"
    docs = before = table(spark, folder, "documents")
    for name, stage in P.STAGES:
        after = spark.createDataFrame(stage(spark, before, folder).toPandas(), None if name != "token_files" else "doc_id long, start long, n_tokens long, ids_crc32 long")
        if name != "token_files":
            assert after.columns == docs.columns
        ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
        if name == "simhash":
            from docweave.llm import near_copies

            # the exact join of the same contract: the index may miss a link, and makes none
            nodes = before.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("node"), "text")
            root = {r["node"]: r["root"] for r in near_copies.groups(nodes).collect()}
            named = [(r["doc_id"], root.get(r["node"], r["node"])) for r in before.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("node")).collect()]
            least = {}
            for doc_id, r in sorted(named):
                least.setdefault(r, doc_id)
            assert set(least.values()) <= set(ids(after))
            assert len(ids(after)) - len(least) <= 0.1 * (len(named) - len(least))
        elif name == "decontamination":
            from docweave.llm import decontaminate

            leaked = {r["doc_id"] for r in decontaminate.leaks(before, table(spark, folder, "benchmark")).collect()}
            assert ids(after) == [i for i in ids(before) if i not in leaked]
        elif name == "mixing":
            from docweave.llm import mixing

            assert ids(after) == sorted(r["doc_id"] for r in mixing.mix(before).collect() for _ in range(r["copies"]))
        elif name == "token_files":
            assert ids(after) == ids(before)
        else:
            assert set(ids(after)) <= set(ids(before))
        before = after
    assert [name for name, _ in P.STAGES] == ["toxicity", "simhash", "decontamination", "mixing", "token_files"]
