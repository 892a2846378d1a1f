import pytest
from pyspark.sql import functions as F

from docweave.config import CrawlSettings
from docweave.operators import crawl as W
from docweave.operators import links as L
from docweave.plans.ingest import crawl
from docweave.config import Settings

H = "http://s.org"


def page(*links):
    return "".join(f'<a href="{h}">{t}</a>' for h, t in links)


def site():
    hub = [(f"/h{i:02d}", "x") for i in range(20)]
    return {
        "/": page(("/a", "a"), ("/b", "b"), ("/", "self"), ("mailto:x@y", "m"), ("/f.pdf", "f"), ("//o.org/z", "o")),
        "/a": page(("/c", "c"), ("/", "back")),
        "/b": page(("/c", "c"), ("/missing", "gone"), ("/hub", "h")),
        "/c": page(("../d?x=1#y", "d"), ("/e", "Learn more"), ("/e", "learn more"), ("/g", "g")),
        "/d": page(("/a", "cycle")),
        "/e": page(),
        "/hub": page(*hub),
        **{f"/h{i:02d}": page() for i in range(20)},
    }


@pytest.fixture
def pages(spark):
    rows = [(i, H + k, v) for i, (k, v) in enumerate(sorted(site().items()))]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn(
        "html", F.when(F.col("html") == "", "<p>leaf</p>").otherwise(F.col("html"))
    )


def walk(pages, **options):
    cfg = CrawlSettings(**options)
    seeds = pages.sparkSession.createDataFrame([(H + "/",), (H + "/",), ("ftp://no",)], "url string")
    rows = W.traverse(W.link_graph(W.link_table(pages, cfg), cfg), seeds, cfg).collect()
    assert len({r["url"] for r in rows}) == len(rows)
    return {r["url"].removeprefix(H): (r["depth"], r["status"]) for r in rows}


def test_traversal(pages):
    got = walk(pages)
    assert got["/"] == (0, "success") and got["/a"][0] == got["/b"][0] == 1
    assert got["/c"] == (2, "success") and got["/missing"] == (2, "failed")
    assert got["/d"][0] == got["/e"][0] == 3 and got["http://o.org/z"] == (1, "failed")
    assert "/f.pdf" not in got and not any(u.startswith("mailto") for u in got)
    # the hub has twenty links; the first fifteen are followed
    assert sorted(u for u in got if u.startswith("/h") and u != "/hub") == [f"/h{i:02d}" for i in range(15)]


def test_depth_and_budget(pages):
    assert max(d for d, _ in walk(pages, max_depth=1).values()) == 1
    cut = walk(pages, max_pages=6)
    everything = walk(pages)
    order = sorted(everything, key=lambda u: (everything[u][0], u if "://" in u else H + u))
    assert set(cut) == set(order[:6])
    assert walk(pages, max_depth=0) == {"/": (0, "success")}


def test_domain_limit(pages):
    assert "http://o.org/z" not in walk(pages, allowed_domains=("s.org",))


def test_the_latest_copy_of_a_page_counts(spark, pages):
    copies = spark.createDataFrame([(100 + i, H + "/a", page(("/old", "x"))) for i in range(50)], pages.schema)
    newest = spark.createDataFrame([(999, H + "/a", page(("/new", "x")))], pages.schema)
    got = walk(pages.union(copies).union(newest))
    assert "/new" in got and "/old" not in got
    reached = W.traverse(W.link_graph(W.link_table(pages.union(copies).union(newest))), spark.createDataFrame([(H + "/a",)], "url string"))
    taken = W.crawled_pages(pages.union(copies).union(newest), reached).where(F.col("url") == H + "/a").collect()
    assert [r["page_id"] for r in taken] == [999]


def test_link_order(pages):
    rows = L.distinct_links(pages).where(F.col("src_url") == H + "/c").orderBy("rank").collect()
    assert [(r["dst_url"].removeprefix(H), r["is_priority"]) for r in rows] == [("/e", True), ("/d", False), ("/g", False)]


def test_discovery(spark):
    shop = {
        "/": page(("/products/a", "a"), ("/about", "x"), ("/solutions/s", "s")),
        "/products/a": page(("/products/b", "b"), ("/solutions/t", "other section"), ("/products/a", "self")),
        "/solutions/s": page(("/solutions/u", "u"), ("/products/a", "found already")),
    }
    rows = [(i, H + k, v) for i, (k, v) in enumerate(shop.items())]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    starts = spark.createDataFrame([(H + "/",)], "url string")
    found = L.discover(L.distinct_links(pages), starts)
    got = {(r["url"].removeprefix(H), r["kind"]) for r in found.collect()}
    assert got == {("/products/a", "primary"), ("/solutions/s", "primary"), ("/products/b", "child"), ("/solutions/u", "child")}
    reached = crawl(pages, starts, Settings().override({"crawl": {"max_depth": 0}}))
    assert {r["url"].removeprefix(H) for r in reached.collect()} == {"/", "/products/a", "/solutions/s", "/products/b", "/solutions/u"}
