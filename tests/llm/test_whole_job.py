"""Near copies by brute-force Jaccard, one survivor per group, and leaks in capitals and beside variants."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from docweave.llm import decontaminate, near_copies, near_index
from docweave.llm.simhash import gray_rank

DOCS = "doc_id long, text string, source string"


def shingle_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_copies_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    line = [word() for _ in range(12)]
    texts = [None, "", " ", "one two", "One  two"]
    for _ in range(40):
        words = [word() for _ in range(rng.randint(20, 150))] + line
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 3)):
            copy = list(words)
            for _ in range(rng.randint(1, 5)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if 5 * both >= 4 * either and root[a] != root[b]:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    want = sorted({root[i] for i in range(len(texts))})
    docs = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], DOCS)
    kept = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert kept == want and 40 < len(kept) < len(texts) - 10
    nodes = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("node"), F.col("text"))
    for named in (near_copies.groups(nodes), near_index.groups(nodes)):
        assert named.count() == named.select("node").distinct().count()
    assert near_index.groups(nodes.limit(0)).count() == 0


def test_each_group_keeps_one_row(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(None, text(1), "a"), (None, text(2), "a"), (None, text(2), "a"), (1, text(3), "a"), (7, text(3) + " end", "a"), (7, text(4), "a"), (None, text(3), "a")]
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == sorted([(0, text(1)), (0, text(2)), (1, text(3)), (7, text(4))])


def test_no_group_is_wrong_and_most_are_found(spark):
    """Families of many near copies, salted cells, and texts just under the similarity."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = []
    for _ in range(60):
        base = [word() for _ in range(rng.randint(60, 200))]
        texts.append(" ".join(base))
        for edits in (1, 2, 3, 12):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    nodes = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    exact = {r["node"]: r["root"] for r in near_copies.groups(nodes).collect()}
    for most in (near_index.MOST, 40):
        kept, near_index.MOST = near_index.MOST, most
        try:
            found = {r["node"]: r["root"] for r in near_index.groups(nodes).collect()}
        finally:
            near_index.MOST = kept
        assert all(exact[n] == exact[r] for n, r in found.items())
        merged = lambda of: len(texts) - len({of.get(n, n) for n in range(len(texts))})
        assert merged(found) >= 0.9 * merged(exact) and merged(exact) > 100


def test_fingerprint_is_the_majority_of_its_hashes():
    hashes = np.random.default_rng(1).integers(0, 2**64, 1001, dtype="u8")
    for n in (0, 1, 2, 3, 10, 1001):
        each = [near_index.fingerprint(hashes[k : k + 1]) for k in range(n)]
        bits = [np.unpackbits(x.view("u1"), bitorder="little").astype(int) for x in each]
        want = 2 * sum(bits, np.zeros(512, int)) > n
        assert (np.unpackbits(near_index.fingerprint(hashes[:n]).view("u1"), bitorder="little") == want).all()


def test_mixing_takes_rows_not_ids(spark):
    text = lambda n, w: " ".join([w] * n)
    rows = [(i % 3 if i % 4 else None, text(20, f"w{i % 50}"), "ab"[i % 2], "clash") for i in range(120)] + [(5, text(20, "same"), "a", "clash")] * 30 + [(9, None, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __hash_0 string")
    mixed = corpus_pipeline.mix_sources(spark, docs, "")
    assert mixed.columns == docs.columns
    words = sum(len((r["text"] or "").split()) for r in mixed.collect())
    total = sum(len((r[1] or "").split()) for r in rows)
    assert abs(words - 1.5 * total) <= 40
    assert corpus_pipeline.mix_sources(spark, docs.limit(0), "").count() == 0


def test_repeated_rows_and_clashing_names(spark):
    rows = [(1, "a b c d e f", "s", 3)] * 50 + [(1, "a b c d e f", None, 4), (2, "g h i j k l", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __hash_0 int")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 2] and kept[0].asDict().keys() == set(docs.columns)
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), "").count() == 0


ITEM = "If Bob has 12 apples and gives 5 apples to Carol how many apples does Bob keep in his own basket"


def leaked(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = decontaminate.marked(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    return {r["doc_id"]: r["items"] for r in rows}


def test_leaks_in_capitals(spark):
    title = "Some Words. " + ITEM.title() + " and more"
    texts = ["SOME WORDS. " + ITEM.upper() + " AND MORE", title, "some words, " + ITEM.lower(), "SOME OTHER WORDS " * 9]
    assert leaked(spark, texts, [(1, ITEM)]) == {0: [1], 1: [1], 2: [1], 3: []}
    assert leaked(spark, ["so: " + ITEM, ITEM.upper(), None], [(1, ITEM.upper())]) == {0: [1], 1: [1], 2: []}


def test_leaks_beside_a_variant(spark):
    other = ITEM.replace("12", "31").replace("5", "8")
    assert leaked(spark, [f"so {ITEM} and then {other} as said", "nothing here"], [(1, ITEM)]) == {0: [1], 1: []}


def test_leaks_of_repeated_items(spark):
    items = [(1, ITEM), (1, ITEM), (2, "A train leaves the old town at noon and is late"), (2, "other words stand here under the same number as before"), (None, "an item that has no number at all is here")]
    found = leaked(spark, ["so " + ITEM, "so a train leaves the old town at noon and is late", "well, an item that has no number at all is here", None], items)
    assert found == {0: [1], 1: [2], 2: [None], 3: []}


def test_predecessors_of_other_groups():
    """All of them within the distance, against brute force, and none of the same group."""
    rng = np.random.default_rng(3)
    n = 600
    bits = rng.integers(0, 1 << 63, 6, "u8")[rng.integers(0, 6, n)] ^ (np.uint64(1) << rng.integers(0, 63, n, "u8"))
    cell, group, size = np.sort(rng.integers(0, 4, n)), rng.integers(0, 9, n), rng.integers(8, 12, n)
    order = np.lexsort((gray_rank(bits), cell))
    bits, group, size = bits[order], group[order], size[order]
    found = [(a, b, d) for part in near_index._before(cell, bits, size, 17, 4, group) for a, b, d in zip(*map(np.ndarray.tolist, part))]
    apart = np.bitwise_count(bits[:, None] ^ bits[None])
    near = (cell[:, None] == cell[None]) & (group[:, None] != group[None]) & (apart <= 17) & (np.arange(n)[None] < np.arange(n)[:, None])
    near &= 5 * np.minimum(size[:, None], size[None]) >= 4 * np.maximum(size[:, None], size[None])
    assert sorted(found) == [(a, b, int(apart[a, b])) for a, b in np.argwhere(near).tolist()]


def test_nearer_text_hides_no_link(spark):
    """Copies that are nearer to each other than to the text they are all similar to."""
    rng = random.Random(1)
    rows = []
    for _ in range(60):
        base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        rows.append(" ".join(base))
        for _ in range(6):
            at, span = rng.randrange(340), rng.randrange(20, 70)
            rows.append(" ".join([*base[:at], *(f"x{rng.randrange(10**6)}" for _ in range(span)), *base[at + span :]]))
    nodes = spark.createDataFrame(list(enumerate(rows)), "node long, text string")
    exact, found = ({r["node"]: r["root"] for r in way.groups(nodes).collect()} for way in (near_copies, near_index))
    merges = [len(named) - len(set(named.values())) for named in (exact, found)]
    assert merges[1] >= 0.97 * merges[0]
    assert all(exact[node] == exact[root] for node, root in found.items())


def test_crowded_cells_leave_no_pair_out(spark, monkeypatch):
    """A cell cut into parts gives at least the links of the whole cell."""
    rng = random.Random(4)
    rows = []
    for _ in range(3):
        base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        for _ in range(60):
            words = list(base)
            words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(words))
    nodes = spark.createDataFrame(list(enumerate(rows)), "node long, text string")
    marked = near_index.fingerprints(nodes).localCheckpoint()
    none = spark.createDataFrame([], "node long, root long")
    pairs = lambda: {(r["a"], r["b"]): r["apart"] for r in near_index.candidates(marked).collect()}
    rows_of = lambda: {(r["cell"], r["node"]) for r in near_index._meetings(marked, none).collect()}
    monkeypatch.setattr(near_index, "tables_for", lambda texts: (8, 2))
    whole, met = pairs(), rows_of()
    monkeypatch.setattr(near_index, "MOST", 8)
    cut = pairs()
    assert len(whole) > 100 and all(cut.get(ends) == apart for ends, apart in whole.items())
    assert rows_of() == met


def test_search_between_groups_grows_with_texts(spark):
    """A family of texts that are near but not similar: rows for its members, not for its pairs, whatever the blocks."""
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for _ in range(300):
        words = list(base)
        for _ in range(3):
            words[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append(" ".join(words))
    nodes = spark.createDataFrame(list(enumerate(rows)), "node long, text string")
    marked = near_index.fingerprints(nodes).localCheckpoint()
    none = spark.createDataFrame([], "node long, root long")
    sets = [shingle_set(t) for t in rows]
    similar = {(b, a) for b in range(300) for a in range(b) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    want, groups = components_of(300, similar), []
    for shingles in (near_index.BLOCK_SHINGLES, 5000):
        kept, near_index.BLOCK_SHINGLES = near_index.BLOCK_SHINGLES, shingles
        try:
            met = near_index._meetings(marked, none).localCheckpoint()
            found = {(r["a"], r["b"]) for r in near_index._hidden(marked, none, nodes).collect()}
        finally:
            near_index.BLOCK_SHINGLES = kept
        per_cell = met.groupBy("cell", "node").count().agg(F.max("count")).first()[0]
        blocks = -(-sum(map(len, sets)) // shingles) + 1
        assert per_cell <= blocks and met.count() <= blocks * near_index.tables_for(300)[1] * 300
        assert found <= similar
        groups.append(components_of(300, found))
    assert groups[0] == groups[1] and len(similar) > 50 and len(set(want)) > 1
    assert 300 - len(set(groups[0])) >= 0.9 * (300 - len(set(want)))


def components_of(n, links):
    root = list(range(n))
    for b, a in links:
        old, new = max(root[a], root[b]), min(root[a], root[b])
        root = [new if r == old else r for r in root]
    return root


def test_leaks_are_searched_once(spark):
    """What is broadcast is worked out before it is counted: no search of the texts is left in the plan."""
    docs = spark.createDataFrame([(0, f"so {ITEM}"), (1, "nothing here")], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    for as_sql in (False, True):
        rows = decontaminate.marked(docs, items, as_sql=as_sql)
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "Aggregate" not in plan
        assert {r["doc_id"]: r["items"] for r in rows.collect()} == {0: [1], 1: []}
