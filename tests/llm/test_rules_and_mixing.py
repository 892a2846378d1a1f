"""Quality rules, mixing and decontamination: SQL on the smallest tables, and stated cases."""

import os

import duckdb
import pytest

from docweave.llm import decontaminate, mixing, quality_rules
from docweave.llm.queries import ORACLES, QUERIES
from tools.compare import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, words string, kept string"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    duck = duckdb.connect()
    for table in TABLES:
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    result = duck.execute(ORACLES[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([c[0] for c in result.description], result.fetchall())


def docs(spark, texts, sources=None):
    rows = [(i, t, (sources or {}).get(i, "a"), "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def test_rules(spark):
    clean = " ".join(f"the word{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10]} of" for i in range(40))
    texts = [None, "", " \n\t ", clean, clean.replace(" ", "%%% "), "go on now " * 60, "a b a b a b a b"]
    rows = {r["doc_id"]: r for r in quality_rules.apply_rules(docs(spark, texts)).collect()}
    assert [rows[i]["kept"] for i in range(5)] == [False, False, False, True, False]
    assert rows[1]["n_words"] == rows[0]["n_repeat_words"] == rows[2]["word_chars"] == 0
    assert rows[5]["base_failed"] and rows[5]["n_repeat_words"] == 180
    assert rows[6]["n_repeat_words"] == 8
    assert quality_rules.apply_rules(docs(spark, [])).count() == 0


def test_repeated_words_by_hand(spark):
    def brute(words):
        seen = {}
        for i in range(len(words) - 2):
            seen.setdefault(tuple(words[i : i + 3]), []).append(i)
        return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)})

    import random

    rng = random.Random(5)
    texts = [" ".join(rng.choice("abc" if n % 2 else "abcdefghijkl") for _ in range(n)) for n in (0, 1, 2, 3, 4, 9, 50, 401)]
    rows = {r["doc_id"]: r for r in quality_rules.apply_rules(docs(spark, texts)).collect()}
    assert [rows[i]["n_repeat_words"] for i in range(len(texts))] == [brute(t.split()) for t in texts]


def test_native_plans(spark):
    plan = quality_rules.apply_rules(docs(spark, ["x"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_mix(spark):
    sources = {i: [None, "b", "c"][i % 3] if i < 900 else "d" for i in range(1000)}
    texts = [" ".join(["w"] * (1 + i * 7 % 83)) for i in range(1000)] + [None]
    rows = mixing.mix(docs(spark, texts, sources)).collect()
    assert len(rows) == 1001 and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    total = sum(r["size"] for r in rows)
    targets = {r["source"]: r["target"] for r in rows}
    assert abs(sum(targets.values()) - 1.5 * total) < 1e-6 * total
    for source, target in targets.items():
        taken = sum(r["taken"] for r in rows if r["source"] == source)
        assert abs(taken - target) <= 0.02 * target + 2 * 83
    again = mixing.mix(docs(spark, texts, sources).repartition(7)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in rows) == sorted((r["doc_id"], r["taken"]) for r in again)
    assert mixing.mix(docs(spark, [])).count() == 0
    assert {r["taken"] for r in mixing.mix(docs(spark, [None, ""])).collect()} == {0}


ITEMS = [
    (1, "A train leaves Paris at 40 km per hour and Anna waits 15 minutes before she follows it to Paris"),
    (2, "short item"),
    (3, None),
    (4, "If Bob has 12 apples and gives 5 apples to Carol how many apples does Bob keep in his own basket"),
]


def test_leaks(spark):
    filler = "nothing of interest is said here, "
    texts = [
        filler + ITEMS[0][1] + " " + filler,
        # other numbers and names, used consistently
        filler + "if Tom has 31 apples and gives 8 apples to Zoe how many apples does Tom keep in his own basket",
        # the same with a name that changes
        filler + "if Tom has 31 apples and gives 8 apples to Zoe how many apples does Max keep in his own basket",
        "this is a short item indeed",
        filler,
        None,
        "",
    ]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = {r["doc_id"]: r["items"] for r in decontaminate.marked(docs(spark, texts), bench).collect()}
    assert rows == {0: [1], 1: [4], 2: [], 3: [2], 4: [], 5: [], 6: []}
    assert decontaminate.marked(docs(spark, texts), bench.limit(0)).filter("size(items) > 0").count() == 0
    assert decontaminate.marked(docs(spark, []), bench).count() == 0


def test_leaks_of_rows_that_share_an_id(spark):
    rows = [(7, ITEMS[0][1], "a", "", ""), (7, "something else", "a", "", ""), (None, ITEMS[0][1], "a", "", "")]
    found = decontaminate.marked(spark.createDataFrame(rows, DOCS), spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert sorted((r["doc_id"] or 0, len(r["items"])) for r in found.collect()) == [(0, 1), (7, 0), (7, 1)]
