from urllib.parse import urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from docweave.functions import filters as P
from docweave.functions import html as H
from docweave.functions import text as X
from docweave.functions import urls as U
from docweave.config import RelevanceSettings, Settings
from docweave.operators import extract as E
from docweave.operators.extract import build_documents

C = F.col


def test_collapse_covers_unicode_spaces(one):
    assert one(X.collapse(C("t")), t="  a 　b\r\n\tc\x0b\x1d ") == "a b c"


@pytest.mark.parametrize(
    "raw, kept",
    [("Café ± über!  «x»", "Café  über! x"), ("a_b-c (d) [e] {f} \"g\" 'h'", "a_b-c (d) [e] {f} \"g\" 'h'"), ("", "")],
)
def test_clean_title(one, raw, kept):
    assert one(X.clean_title(C("t")), t=raw) == kept


def test_clean_title_of_null_is_empty(one):
    assert one(X.clean_title(C("t")), t=None) == ""


@pytest.mark.parametrize(
    "content, wanted", [("One two. Three", "One two."), ("", "."), ("x" * 201, "x" * 200 + "..."), ("?!a", ".")]
)
def test_short_description(one, content, wanted):
    assert one(X.short_description(C("t")), t=content) == wanted


@pytest.mark.parametrize(
    "raw, wanted",
    [
        (None, X.EMPTY_ANSWER),
        (" \n ", X.EMPTY_ANSWER),
        ("fine", "fine."),
        ("fine?", "fine?"),
        ("Question: a Answer: b", "b."),
        ("b Answer:", ""),
        ("x Context: y\nz", "y\nz."),
        ("Answer: one Answer: two!", "two!"),
    ],
)
def test_tidy_answer(one, raw, wanted):
    assert one(X.tidy_answer(C("t")), t=raw) == wanted


def test_token_estimate_is_whole(one):
    assert one(X.llm_token_estimate(C("t")), t=" a b\nc ") == 4


BASE = "http://h.org/a/b/c.html?q=1#f"


@pytest.mark.parametrize(
    "href",
    ["d", "./d", "../d", "../../d/./e", "/x/../y", "//o.org/p?q", "https://z.org/k;v?x#y", "?n=2", "#top", "", "..", "d/?a=1#b"],
)
def test_resolve_and_canonical_match_the_standard_library(one, href):
    parsed = urlparse(urljoin(BASE, href))
    got = one(U.canonical(U.resolve(U.base_parts(C("b")), C("h"))), b=BASE, h=href)
    assert got == f"{parsed.scheme}://{parsed.netloc}{parsed.path}"


def test_relative_link_of_a_bare_host(one):
    assert one(U.resolve(U.base_parts(C("b")), C("h")), b="http://h.org", h="x") == "http://h.org/x"


@pytest.mark.parametrize(
    "url, ok",
    [("http://a.com/x", True), ("https://a.com/x.PDF", False), ("mailto:a@b", False), ("http://a.com/js", True), ("ftp://a.com/", False)],
)
def test_crawlable(one, url, ok):
    assert one(U.crawlable(C("u")), u=url) is ok


def test_domain_rule_is_a_substring_unless_asked_otherwise(one):
    assert one(U.domain_allowed(C("u"), ("a.com",)), u="http://nota.com/") is True
    assert one(U.domain_allowed(C("u"), ("a.com",), True), u="http://nota.com/") is False
    assert one(U.domain_allowed(C("u"), ("a.com",), True), u="http://w.A.com:80/") is True


def test_file_name_drops_the_query(one):
    assert one(U.file_name(C("u")), u="http://h.org/a/b?x=1") == "h.org_a_b.html"
    assert one(U.file_name(C("u")), u="http://h.org/a.html") == "h.org_a.html"


def test_prefix_alias(one):
    pairs = (("http://a.com", "http://www.a.com"),)
    assert one(U.replace_prefix(C("u"), pairs), u="http://a.com/p") == "http://www.a.com/p"
    assert one(U.replace_prefix(C("u"), pairs), u="http://b.com/p") == "http://b.com/p"


@pytest.mark.parametrize(
    "raw, wanted",
    [
        ("a &amp; b", "a & b"),
        ("&amp;lt;", "&lt;"),
        ("&lt;p&gt; &eacute;&#233;&#xE9; &#128512;", "<p> ééé 😀"),
        ("&unknown; & &; &#; &#xD800;", "&unknown; & &; &#; &#xD800;"),
        ("fish&chips", "fish&chips"),
    ],
)
def test_entities(one, raw, wanted):
    assert one(H.decode_entities(C("t")), t=raw) == wanted


def documents(spark, *htmls):
    rows = [(i, f"http://h.org/{i}", h) for i, h in enumerate(htmls)]
    df = build_documents(spark.createDataFrame(rows, "page_id long, url string, html string"))
    return [r.asDict() for r in df.orderBy("url").collect()]


def test_documents(spark):
    page = (
        "<html><head><title>T &amp; U</title><script>var s='<article>no</article></p>';</script></head><body>"
        "<nav>menu</nav><article><h1>Head</h1><p>One<b>two</b>&nbsp;three. <!-- gone --><form>f</form>Four</article>"
        "<footer>foot</footer></body></html>"
    )
    blocks = "<body><div>short</div><div>the longer block wins</div><aside>not this rather long aside text here</aside></body>"
    bare = "<html><head><title>Only</title></head><body><article></article><nav>n</nav></body></html>"
    got = documents(spark, page, blocks, bare, None, "")
    assert len(got) == 3
    assert got[0]["content"] == "Head One two three. Four"
    assert got[0]["title"] == "T  U" and got[0]["short_description"] == "Head One two three."
    assert got[1]["content"] == "the longer block wins"
    # no main text: the whole page, title included, described by its start
    assert got[2]["content"] == "Only" and got[2]["short_description"] == "Only"
    assert got[0]["content_length"] == len(page)


def test_anchor_in_a_script_is_no_link(one):
    html = "<script>x='<a href=\"/no\">n</a>'</script><A class=k HREF='/yes?a=1&amp;b=2'> Read <b>More</b> </A><a name=q>x</a>"
    got = one(H.anchors(H.without_noise(C("t"))), t=html)
    assert [(g["href"], g["anchor"]) for g in got] == [("/yes?a=1&b=2", "read more")]


@pytest.mark.parametrize(
    "url, content, rule, keep",
    [
        ("http://x/", "any", RelevanceSettings(), True),
        ("http://x/Prod", "any", RelevanceSettings(url_terms=("prod",), content_terms=("q",)), True),
        ("http://x/", "alpha beta", RelevanceSettings(content_terms=("alpha", "beta", "z")), True),
        ("http://x/", "alpha alpha", RelevanceSettings(content_terms=("alpha", "beta")), False),
        ("http://x/", "alpha BRAND", RelevanceSettings(content_terms=("alpha", "beta"), brand_terms=("brand",)), True),
        ("http://x/", "none", RelevanceSettings(url_terms=("prod",)), True),
    ],
)
def test_relevance(one, url, content, rule, keep):
    assert one(P.relevant(C("u"), C("c"), rule), u=url, c=content) is keep


def test_metadata_filter(spark):
    rows = [("a", 5, "x"), ("b", None, "y"), ("c", 9, None)]
    df = spark.createDataFrame(rows, "id string, n int, t string")

    def ids(filters):
        return [r["id"] for r in df.where(P.metadata_predicate(df, filters)).orderBy("id").collect()]

    assert ids({"n": {"gte": 5, "lt": 9}}) == ["a"]
    assert ids({"n": {"gt": 5}}) == ["c"]
    assert ids({"t": ["x", "y"]}) == ["a", "b"]
    assert ids({"t": "x", "n": 5}) == ["a"]
    with pytest.raises(KeyError):
        ids({"missing": 1})


def test_settings_merge_deeply():
    changed = Settings().override({"crawl": {"max_depth": 2}})
    assert changed.crawl.max_depth == 2 and changed.crawl.max_pages == 150
    with pytest.raises(KeyError):
        Settings().override({"crawl": {"nope": 1}})


@pytest.mark.parametrize(
    "raw, wanted",
    [
        ("&rarr; &alpha; &AMP; &check;", "→ α & ✓"),
        ("&copy 2020 &notit; &ampx", "© 2020 ¬it; &x"),
        ("&#150; &#x92; &#8364 &#0; &#xD800;", "– ’ € &#0; &#xD800;"),
        ("&unknown; & &; &#; a&b", "&unknown; & &; &#; a&b"),
        ("&amp;lt;", "&lt;"),
    ],
)
def test_character_references(one, raw, wanted):
    assert one(H.decode_entities(C("t")), t=raw) == wanted


@pytest.mark.parametrize(
    "page, wanted",
    [
        ("<a href=/x>one <a href=/y>two</a>", [("/x", "one"), ("/y", "two")]),
        ("<a href='/x'>One</a> between <a name=q>no link</a> <A HREF=/z>last", [("/x", "one"), ("/z", "last")]),
        ("<a href=/x><b>Bold</b> text</a> rest", [("/x", "bold text")]),
        ("<abbr href=/n>no</abbr>", []),
    ],
)
def test_anchors(one, page, wanted):
    assert [(a["href"], a["anchor"]) for a in one(H.anchors(C("t")), t=page)] == wanted


@pytest.mark.parametrize(
    "body, wanted",
    [
        ("<p>Alpha text one.</p><div>short</div><p>tail of the page</p>", "Alpha text one. short tail of the page"),
        ("<div><p>First paragraph of it.</p></div><div><p>Second paragraph of it.</p></div><div>Ad</div>", "First paragraph of it. Second paragraph of it."),
        ("<div><div><div>Nested text only</div></div></div>", "Nested text only"),
        ("<table><tr><td>cell one text</td><td>cell two text</td></tr></table>", "cell one text cell two text"),
    ],
)
def test_main_text_without_article(spark, body, wanted):
    page = f"<html><head><title>t</title></head><body>{body}</body></html>"
    pages = spark.createDataFrame([(1, "http://x/a", page)], "page_id long, url string, html string")
    assert E.with_main_text(pages).first()["main_text"] == wanted


@pytest.mark.parametrize(
    "html, inside",
    [
        ("<article>one</article><div>menu</div><article>two</article>", "one two"),
        ("x<article>a <article>b</article> c</article>d<ARTICLE class='q'>e</ARTICLE >f", "a  b  c e"),
        ("</article>x<article>y</article>", "y"),
        ("<article>u<article>v</article>w", "u v"),
        ("<article>a</article></article>b", "a"),
        ("<article>never closed", ""),
        ("<articles>z</articles>", ""),
        ("", ""),
    ],
)
def test_elements_are_paired_by_depth(one, html, inside):
    assert one(H.element(C("t"), "article"), t=html) == inside


def test_a_table_is_two_literals(spark, monkeypatch):
    from pyspark.sql import functions

    from docweave.operators import extract

    made = []
    plain = functions.lit
    monkeypatch.setattr(functions, "lit", lambda value: made.append(value) or plain(value))
    pages = spark.createDataFrame([(1, "u", "<p>&amp;</p>")], "page_id long, url string, html string")
    extract.build_documents(pages)
    assert len(made) < 400 and not any(isinstance(value, (list, tuple, dict)) for value in made)
