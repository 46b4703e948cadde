"""Main text of pages: known texts in several templates, the vote of a host, odd markup, and another extractor on the given pages."""

from html.parser import HTMLParser

import pytest
from pyspark.sql import types as T

from eventloom.llm import page_text as pt

SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
    T.StructField("host", T.LongType()), T.StructField("paths", T.StringType()), T.StructField("text", T.LongType()),
])
SAY = "The river ran past old mills and nobody counted the stones that it took along on its way down."


def article(i, n=3):
    return [f"Heading {i}", *(f"{SAY} Part {k} of {i}." for k in range(n))]


def semantic(i):
    h, *ps = article(i)
    return f"""<!DOCTYPE html><html><head><title>x</title><script>var t="</p><p>no";</script></head><body class="has-sidebar no-menu"><header><h1>Site</h1></header>
    <nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies. {SAY}</div><article class="post-{i}"><header><h1>{h}</h1><span>menu</span></header>
    {"".join(f"<p>{p}</p>" for p in ps)}<aside>{SAY}</aside><form>{SAY}</form></article><section id="comments"><p>{SAY}</p><p>{SAY}</p></section><footer>&copy; {SAY}</footer></body></html>"""


def plain(i):
    h, *ps = article(i)
    return f"""<body><div id=top role="navigation">{SAY}</div><div class="wrap"><div class="entry-{i} main"><h2>{h}</h2>{"".join(f"<p>{p}" for p in ps)}</div>
    <div class="side-bar sidebar">{SAY}</div><ol class="commentlist"><li>{SAY}<li>{SAY}</ol></div><script>if (a < b) {{}}</script>"""


def table(i):
    h, *ps = article(i)
    return f"""<TABLE><TR><TD CLASS='menu'><A HREF="a>b">{SAY}</A><TD class=text><H1>{h}</H1>{"<BR>".join(ps)}<TR><TD><a href=x>{SAY} {SAY}</a></TABLE>"""


@pytest.mark.parametrize("template", [semantic, plain, table])
def test_known_texts(spark, template):
    rows = [(i, f"HTTPS://user@Site.{template.__name__}.org:80/a/{i}?x", template(i), 1, "clash", 2) for i in range(12)]
    got = pt.main_text(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint"), ("path", "string")]
    for r in got.collect():
        want = " ".join(article(r.page_id))
        assert (r.url, r.text, r.n_chars) == (rows[r.page_id][1], want, len(want))


def test_a_page_follows_its_host(spark):
    """On its own, page 0 takes the long thread below its short text; the host's other pages know better."""
    body = lambda n, k: f"<div class=entry>{'<p>' + SAY + '</p>' if n == 1 else ('<p>' + SAY) * n}</div><div class=thread>{('<p>Thread. ' + SAY) * k}</div>"
    rows = [(0, "http://a.b/0", body(1, 9), None, None, None)] + [(i, f"http://a.b/{i}", body(5, 1), None, None, None) for i in range(1, 9)]
    alone = pt.main_text(spark.createDataFrame(rows[:1], SCHEMA)).first()
    assert alone.text.startswith("Thread.") and alone.path == "/div.thread"
    got = {r.page_id: r for r in pt.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0].text == SAY and {r.path for r in got.values()} == {"/div.entry"}
    # two templates on one host: the second path wins too; a page of neither takes its own best
    rows += [(20 + i, "http://a.b/", f"<main><p>{SAY}</main>", None, None, None) for i in range(3)] + [(40, "http://a.b/", f"<section><p>Own. {SAY}</section>", None, None, None)]
    won = pt.winning_paths(spark.createDataFrame(rows, SCHEMA).select(pt.F.lit("a.b").alias("host"), "html"), share=10).collect()
    assert [tuple(r) for r in won] == [("a.b", ["/div.entry", "/main"])]
    got = {r.page_id: r for r in pt.main_text(spark.createDataFrame(rows, SCHEMA), share=10).collect()}
    assert got[21].text == SAY and got[40].text == f"Own. {SAY}"


def test_large_tables_of_paths_meet_by_host(spark):
    rows = [(i, f"http://h{i % 5}.x/", semantic(i), None, None, None) for i in range(40)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = pt.main_text(spark.createDataFrame(rows, SCHEMA)).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r.page_id: r.text for r in got} == {i: " ".join(article(i)) for i in range(40)}


@pytest.mark.parametrize(("source", "want"), [
    ("<p>a &amp; b&nbsp;&nbsp;c &#x41;&#66; &lt;p&gt; &bogus; &am", "a & b c AB <p> &bogus; &am"),
    ("<article><p>x<b>y</b>z<!-- > <p>no --><p>2 < 3 <i>and</i>\n\t4</article>after", "xyz 2 < 3 and 4"),
    ("<div><p>a<span class=ad>no <span>no</span> no</span>b</div>", "ab"),
    ("<p>one<script>x = '<p>two</p>'</script> three<style>p{}</style><textarea>no", "one three"),
    ("<p>cut <a title='x>y' href=", "cut"),
    ("</p></b></div>text<p>more</i>", "text more"),
    ("<div><p data-id=nav title='id=menu'>a <a href='/x?id=search&class=ad'>b</a> c <i DATA-ROLE='banner' hidden>d</i><b ID = nav>no</b>", "a b c d"),
    ("<nav>only a menu</nav>", ""), ("   \n ", ""), ("<", "<"), ("<!-- never closed <p>x", ""),
    ("<div><table><tr><td>a<td>b<tr><td>c</table></div><ul><li>d<li>e<ul><li>f</ul></ul>", None),
])
def test_markup(source, want):
    page = pt.parse(source)
    text = page.text(page.best()[0]) if page.best() else page.text("")
    if want is None:
        assert [t for _, t, _ in page.blocks] == list("abcdef")
    else:
        assert text == want


def test_deep_and_long_pages():
    page = pt.parse("<div>" * 3000 + "<p>" + SAY + "</div>" * 10)
    assert page.text(page.best()[0]) == SAY
    assert pt.parse("<b>" * 20_000 + "</i>" * 20_000 + "x").blocks[0][1] == "x"
    many = pt.parse("<article>" + ("<p>" + SAY) * 20_000 + "</article>")
    assert len(many.text("/article")) == 20_000 * (len(SAY) + 1) - 1


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(1, None, None, 1, "a", 1), (2, "no url", "", 1, "a", 1), (None, "http://x/", semantic(1), 1, "a", 1), (4, None, plain(4), None, None, None), (4, None, plain(4), None, None, None)]
    got = sorted(map(tuple, pt.main_text(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    four = " ".join(article(4))
    assert got == sorted([(1, None, "", 0, None), (2, "no url", "", 0, None), (None, "http://x/", " ".join(article(1)), len(" ".join(article(1))), "/article.post-#"), *[(4, None, four, len(four), "/div.wrap/div.entry-#.main")] * 2], key=repr)
    assert pt.main_text(spark.createDataFrame([], SCHEMA)).collect() == []


class _Article(HTMLParser):
    """All text in <article>, by the library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag in ("p", "h1", "br"):
            self.parts.append(" ")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        if tag in ("p", "h1"):
            self.parts.append(" ")

    def handle_data(self, data):
        if self.depth:
            self.parts.append(data)


def test_given_pages_against_another_parser(spark):
    from eventloom.llm.queries import op12_page_text

    want = {}
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        other = _Article()
        other.feed(r.html or "")
        other.close()
        want[r.page_id] = " ".join("".join(other.parts).split())
    got = op12_page_text(spark, "/root/testdata/sf0.001").collect()
    assert {r.page_id: r.text for r in got} == want and all(want.values())
    assert all(r.n_chars == len(r.text) for r in got)
