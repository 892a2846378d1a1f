"""Spelling variants, collocations and byte-level BPE against brute force and the public library."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, word string, n long, chunk string, ids string"


def frame(spark, rows):
    """Rows of id, text and language, with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, None, "x", 7, "y", "z") for i, t, lang in rows], SCHEMA)


def made_texts(seed, n=60):
    r = random.Random(seed)
    words = ["harbour", "harbor", "harbours", "colours", "colour", "colours", "Éclairs", "éclairs", "aaaaaa", "aaaaaaa", "abababa", "bababab", "letters", "lettters", "settler", "in", "of", "x" * 400, "x" * 401]
    return [(k % 50, " ".join(r.choice(words) for _ in range(r.randrange(0, 60))), r.choice(["en", "de", None])) for k in range(n)]


EDGES = [(None, "harbour harbour", None), (None, None, "en"), (7, "", "en"), (7, "", "en"), (8, "\t\n .;", None), (9, "harbour\x0bharbour", "en"), (10, "wörter WÖRTER ÀÉ 漢字 \0 🎉 don't I'll  two   blanks ", "de")]


def brute_variants(rows):
    upper = {c: c + 32 for c in range(65, 91)}
    counts = Counter()
    for doc_id, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(upper)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            counts[run[:at] + run[at + 1 :] if h % 199 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    forms, found = {}, {}
    met = {w: [x for x in words if near(w, x)] for w in words}
    for w, n in words.items():
        best = min(met[w], key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best is not None and words[best] >= 5 * n else None
    for w in words:
        root = w
        while forms[root] is not None:
            root = forms[root]
        found[w] = (forms[w], root, words[w], len(met[w]), words.get(forms[w]))
    return found


@pytest.mark.parametrize("block", [256, 2])
def test_spelling_variants(spark, block):
    from docweave.llm import spelling

    rows = made_texts(1) + EDGES + [(k, "lettter " + "harbou " * 2 + "zebras zebra " + "zebrass " * 30, "en") for k in range(6)]
    chain = [(100, "abcdefg " * 5 + "abcdefgh " * 25 + "abcdefghi " * 125 + "abcdefghij " * 700, "en")]
    rows += chain
    answer = spelling.variants(frame(spark, rows).repartition(3), block=block).collect()
    want = brute_variants(rows)
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in answer} == want
    assert len(answer) == len(want) and want["abcdefg"][1] == "abcdefghij"
    assert spelling.variants(frame(spark, [])).count() == 0


def brute_collocations(rows, least, most):
    lower = {c: c + 32 for c in range(65, 91)}
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 6):
                for k in range(len(words) - size + 1):
                    f[lang, *words[k : k + size]] += 1
    found = []
    for key, a in f.items():
        lang, *words = key
        if len(words) < 2 or a < least:
            continue
        cuts = [((1000 * a * n[lang]) // (f[lang, *words[:k]] * f[lang, *words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        inside = (x for x, c in f.items() if c >= least and len(x) > len(key) and x[0] == lang and 100 * c >= 100 * a)
        if any(list(x[i : i + len(words)]) == words for x in inside for i in range(1, len(x))):
            continue
        found.append((lang, -score, -a, " ".join(words).encode(), a, f[lang, *words[:k]], f[lang, *words[k:]], n[lang], score))
    answer = []
    for lang in n:
        ranked = sorted(x for x in found if x[0] == lang)[:most]
        answer += [(lang, rank, p.decode(), a, left, r, total, score) for rank, (_, _, _, p, a, left, r, total, score) in enumerate(ranked, 1)]
    return sorted(answer)


@pytest.mark.parametrize("trigger", [1, 3, 1000])
def test_collocations(spark, trigger):
    from docweave.llm import collocations

    r = random.Random(5)
    words = ["New", "new", "york", "city", "the", "of", "a", "Émile", "émile", "漢字", "b-c"]
    rows = [(k, " ".join(r.choice(words) + r.choice(["", "", "", ",", ".", "\n", "\t"]) for _ in range(r.randrange(0, 80))), r.choice(["en", "de", None])) for k in range(60)]
    rows += EDGES + [(k, "the New York City hall, a a a a a a a a", "en") for k in range(12)]
    answer = collocations.collocations(frame(spark, rows).repartition(4), least_count=6, most=20, trigger=trigger)
    got = sorted(tuple(x) for x in answer.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == brute_collocations(rows, 6, 20) and got
    assert collocations.collocations(frame(spark, [])).count() == 0


def test_chunks_hold_each_start_once():
    from docweave.llm.collocations import chunks

    text = " ".join(f"w{k % 37}" for k in range(500)) + ". short one"
    pieces = [p.split() for p in text.split(".")]
    starts = [" ".join(words[i : i + 5]) for words in pieces for i in range(len(words))]
    held = [" ".join(chunk.decode().split(" ")[i : i + 5]) for own, chunk in chunks(text, 5, 4) for i in range(own)]
    assert held == starts
    assert list(chunks("")) == []


def test_scores_past_64_bits(spark):
    from pyspark.sql import functions as F

    from docweave.llm.collocations import _exact

    row = spark.createDataFrame([(10**14, 10**15, 10**9, 10**10 + 1)], "a long, n long, l long, r long")
    row = row.withColumn("above", F.lit(1000).cast("decimal(4,0)") * _exact("a") * _exact("n", 16)).withColumn("below", _exact("l") * _exact("r"))
    assert row.select(F.expr("above div below")).first()[0] == 1000 * 10**14 * 10**15 // (10**9 * (10**10 + 1))


def bpe_texts():
    r = random.Random(3)
    letters = "".join(r.choice("abcdefgh") for _ in range(700))
    odd = "".join(chr(r.randrange(1, 0x3000)) for _ in range(2000))
    return [t for _, t, _ in EDGES] + ["a" * 3001, " " * 500 + "x", letters, odd, "=-" * 300, "tail ", "\n \n x", "words again words again"]


def test_byte_bpe_is_the_librarys(spark):
    public = pytest.importorskip("public_tokenizers")
    import tiktoken

    from docweave.llm import byte_bpe

    path = public.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    texts = bpe_texts()
    rows = frame(spark, [(k, t, "en") for k, t in enumerate(texts)] + [(None, "x y", "en"), (0, "x y", "en")]).repartition(2)
    want = Counter((k, tuple(library.encode_ordinary(t or "")), t or "") for k, t in [*enumerate(texts), (None, "x y"), (0, "x y")])
    both = byte_bpe.round_trip(rows, path, public.PATTERN).collect()
    assert Counter((x["doc_id"], tuple(np.frombuffer(x["ids"], "<u4").tolist()), bytes(x["decoded"]).decode()) for x in both) == want
    coded = byte_bpe.encode(rows, path, public.PATTERN)
    assert Counter((x["doc_id"], tuple(x["ids"])) for x in coded.collect()) == Counter((k, ids) for k, ids, _ in want.elements())
    decoded = byte_bpe.decode(coded, path, public.PATTERN).collect()
    assert Counter((x["doc_id"], bytes(x["decoded"]).decode()) for x in decoded) == Counter((k, t) for k, _, t in want.elements())
    assert byte_bpe.round_trip(rows.limit(0), path, public.PATTERN).count() == 0


def test_byte_bpe_in_small_slices_and_generations(monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    import tiktoken

    from docweave.llm import byte_bpe

    path = public.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    for name, value in {"SLICE_CHUNKS": 7, "SLICE_BYTES": 20, "SLICE_IDS": 11, "LONG_PIECE": 6}.items():
        monkeypatch.setattr(byte_bpe, name, value)
    coder = byte_bpe.Coder(path, public.PATTERN, known_pieces=5)
    texts = [(t or "")[:120] for t in bpe_texts()] + ["mississippi banana bandana " * 5] * 2
    for _ in range(2):
        coded = coder.encode(texts)
        assert [np.frombuffer(c, "<u4").tolist() for c in coded] == [library.encode_ordinary(t) for t in texts]
        assert [hashlib.sha256(d).digest() for d in coder.decode(coded)] == [hashlib.sha256(t.encode()).digest() for t in texts]
