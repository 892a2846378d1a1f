"""SimHash groups and substring dedup against brute force."""

import random

import pytest

from docweave.llm import anchors, rlz_dedup, simhash, suffix_dedup
from docweave.llm.components import components

DOCS = "doc_id long, text string, fp string, spans string, key string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "", "", "") for i, t in rows], DOCS)


def corpus(seed, n=60):
    """Texts with exact copies, shared passages, edits, repeats within a text, nulls and blanks."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(rng.randint(20, 60))) for _ in range(5)]
    texts = []
    for _ in range(n):
        parts = [" ".join(word() for _ in range(rng.randint(0, 40))) for _ in range(3)]
        if rng.random() < 0.7:
            parts.insert(1, rng.choice(passages))
        texts.append("\n".join(parts))
    for _ in range(n // 4):
        words = rng.choice(texts).split()
        if words and rng.random() < 0.6:
            words[rng.randrange(len(words))] = word()
        texts.append(" ".join(words))
    texts += [None, "", "  ", "ab " * 300, "aaaa" * 200, texts[0], texts[0]]
    return list(enumerate(texts))


def groups_of(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(900 + i, 901 + i) for i in range(40)] + [(5, i) for i in range(1000, 1100)]
    want = groups_of(links, {n for link in links for n in link})
    rows = components(spark.createDataFrame([*links, (None, 3)], "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in rows} == {n: r for n, r in want.items() if any(n in link and link[0] != link[1] for link in links)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_fingerprint(text):
    import xxhash

    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    votes = [sum(xxhash.xxh64_intdigest(s, seed=42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def test_simhash(spark):
    rows = corpus(1) + [(None, "aaaa" * 200), (None, "only here")]
    marks = [brute_fingerprint(t) for _, t in rows]
    pairs = [(a, b) for b in range(len(rows)) for a in range(b) if (marks[a] ^ marks[b]).bit_count() <= 3]
    groups = groups_of(pairs, range(len(rows)))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[groups[k]] = min(i, least.get(groups[k], i))
    want = sorted((-1 if i is None else i, marks[k], least.get(groups[k], -1)) for k, (i, _) in enumerate(rows))
    found = simhash.near_duplicates(frame(spark, rows)).collect()
    as_int = lambda x: -1 if x is None else x
    assert sorted((as_int(r["doc_id"]), r["fp"] % (1 << 64), as_int(r["component_id"])) for r in found) == want
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_links_of_crowded_fingerprints(spark):
    """Thousands of fingerprints a few bits apart, some at exactly 3 and 4 bits."""
    rng = random.Random(4)
    centre = [rng.getrandbits(64) for _ in range(4)]
    marks = {c ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 6))) % (1 << 64) for c in centre for _ in range(400)}
    marks = sorted(marks)
    pairs = [(a, b) for j, b in enumerate(marks) for a in marks[:j] if (a ^ b).bit_count() <= 3]
    want = groups_of(pairs, marks)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    links = simhash.links_of(spark.createDataFrame([(signed(m),) for m in marks], "fp long"))
    found = groups_of([(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in links.collect()], marks)
    assert found == want


def brute_bytes(rows, length):
    data = [(t or "").encode() for _, t in rows]
    count = {}
    for b in data:
        for k in range(len(b) - length + 1):
            count[b[k : k + length]] = count.get(b[k : k + length], 0) + 1
    kept = []
    for b in data:
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        kept.append(bytes(x for x, g in zip(b, gone) if not g))
    return kept


def brute_words(rows, length):
    words = [(t or "").encode().split() for _, t in rows]
    ids = [2**63 if i is None else i for i, _ in rows]
    first = {}
    for i, w in zip(ids, words):
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            first[key] = min(i, first.get(key, i))
    kept = []
    for i, w in zip(ids, words):
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < i:
                gone[k : k + length] = [True] * length
        kept.append(b" ".join(x for x, g in zip(w, gone) if not g))
    return kept


@pytest.mark.parametrize("many, piece", [(2000, 1 << 18), (1, 1 << 18), (2000, 64)])
def test_substrings(spark, monkeypatch, many, piece):
    """Also with every anchor dealt by windows, and with texts that span many pieces."""
    monkeypatch.setattr(anchors, "MANY", many)
    monkeypatch.setattr(anchors, "PIECE", piece)
    rows = corpus(3) + [(None, "ab " * 300), (3, "shares an id " + "ab " * 90)]
    found = suffix_dedup.remove_repeats(frame(spark, rows), length=40, core=12).collect()
    order = lambda i: (i is None, i)
    want = [(order(i), len((t or "").encode()), k) for (i, t), k in zip(rows, brute_bytes(rows, 40))]
    assert sorted((order(r["doc_id"]), r["n_bytes"], bytes(r["kept"])) for r in found) == sorted(want)
    found = rlz_dedup.remove_repeats(frame(spark, rows), length=8, core=3).collect()
    want = [(order(i), len((t or "").encode().split()), k) for (i, t), k in zip(rows, brute_words(rows, 8))]
    assert sorted((order(r["doc_id"]), r["n_words"], bytes(r["kept"])) for r in found) == sorted(want)


def test_equal_rows_beside_a_variant(spark):
    """Equal rows give one surrounding per anchor, and each of them its result."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcde") for _ in range(4)) for _ in range(40)]
    same, variant = " ".join(words), " ".join([*words[:30], "other", *words[31:]])
    rows = [(7, same)] * 3000 + [(None, same)] * 500 + [(9, variant), (7, variant), (11, "alone " * 3)]
    spec = anchors.Spec(8, 3, rlz_dedup.word_symbols, lambda values: values, 8, smaller_only=True)
    docs = frame(spark, rows)
    wanted = anchors.occurrences(docs, spec, "doc_id", "text").dropDuplicates(["key", "run"]).selectExpr("*", "1L AS n", "false AS many")
    assert anchors._surroundings(docs, wanted, spec, "doc_id", "text").count() == wanted.count()
    order = lambda i: (i is None, i)
    found = rlz_dedup.remove_repeats(docs, length=8, core=3).collect()
    want = [(order(i), k) for (i, _), k in zip(rows, brute_words(rows, 8))]
    assert sorted((order(r["doc_id"]), bytes(r["kept"])) for r in found) == sorted(want)
    found = suffix_dedup.remove_repeats(docs, length=40, core=12).collect()
    want = [(order(i), k) for (i, _), k in zip(rows, brute_bytes(rows, 40))]
    assert sorted((order(r["doc_id"]), bytes(r["kept"])) for r in found) == sorted(want)


def test_no_rows(spark):
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0
    assert rlz_dedup.remove_repeats(frame(spark, [])).count() == 0


@pytest.mark.parametrize("shallow", [1, 2, 20])
def test_deep_shallow(shallow):
    import numpy as np

    rng = random.Random(9)
    text = lambda n: bytes(rng.choice(b"ab") for _ in range(n))
    heads = [text(50) for _ in range(3)]
    strings = [rng.choice(heads)[: rng.randint(0, 50)] + text(rng.randint(0, 20)) for _ in range(200)]
    groups = np.array([rng.randrange(3) for _ in strings])
    order, common = suffix_dedup.deep_shallow(strings, groups, shallow)
    want = sorted(range(len(strings)), key=lambda i: (groups[i], strings[i]))
    assert [(groups[i], strings[i]) for i in order] == [(groups[i], strings[i]) for i in want]
    for k in range(1, len(want)):
        a, b = strings[want[k - 1]], strings[want[k]]
        same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert common[k] == (same if groups[want[k]] == groups[want[k - 1]] else -1)
