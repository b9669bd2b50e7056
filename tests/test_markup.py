"""Markup in linear time and in full: large broken pages, attributes, labels, JSON-LD in all its forms, nested scopes, rule tables."""

import json
import time

import pytest
from pyspark.sql import functions as F

from tomewatch.operators import extract as x
from tomewatch.operators import markup as m

BROKEN = [
    "<script ", "<script>", "<style>", "<!--", "<", "<a href=", '<a href="', "<a ", "<meta property=\"og:title\" ", "<meta ", "<tr><th>", "<tr><th>k</th>", "<dt>", "<dt>k</dt>", "<li><b>", "<li><b>k</b>",
    '<span class="label">', "<h1", "<h1>", "<title>", "</script", "<button add-to-cart ", "<button", '<script type="application/ld+json">', '<b itemprop="x">', '<div itemscope itemprop="a">', 'a="', "x" * 99 + " ", "class=\"price\" ", "<p><b>", "&amp", "<div>",
]


def one(spark, html, *columns):
    return spark.createDataFrame([(html,)], "html string").select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()


def test_broken_megabytes(spark):
    """All extraction over a megabyte of each broken form; a quadratic pattern would take hours."""
    size = 1 << 20
    pages = [(k, "https://s/p", (b * (size // len(b) + 1))[:size]) for k, b in enumerate(BROKEN)] + [(99, "https://s/p", "<p " + "a" * size), (98, "https://s/p", "<meta " + "name='og:title' " * (size // 16))]
    df = spark.createDataFrame(pages, "id long, url string, html string").repartition(4).persist()
    df.count()
    began = time.time()
    h = F.col("html")
    df.select(x.bare(h), x.sanitise(h), x.stock_signals(h), *[x.label_values(h, k) for k in m.LABELS]).write.format("noop").mode("overwrite").save()
    for out in (x.extract(df), x.json_ld(df), x.page_data(df), x.internal_links(df, df), m.microdata(df, ["id"]), x.markdown(df, "html", ["id"])):
        out.write.format("noop").mode("overwrite").save()
    assert time.time() - began < 120


def test_attributes(spark):
    attrs = F.lit(""" data-href="/no" HREF='/it"s' title="href=x" class=big  href="/second" empty="" broken=" """)
    assert tuple(one(spark, "", m.attribute(attrs, "href"), m.attribute(attrs, "class"), m.attribute(attrs, "title"), m.attribute(attrs, "empty"), m.attribute(attrs, "none"))) == ('/it"s', "big", "href=x", "", None)


def test_page_fields(spark):
    html = "<html lang='lt-LT'><meta content=' T &amp; U ' PROPERTY=og:title><meta name=\"description\" content=\"d\"><script>'<h1>no</h1>'</script><h1 class=a>Head <i>line</i></h1><h1>two</h1>"
    r = x.extract(spark.createDataFrame([(1, html)], "id long, html string")).first()
    assert (r.title, r.description, r.language) == ("T & U", "d", "lt-LT")
    assert one(spark, "<p>a<b>b</p><h1>open", x.bare(m.element(F.col("html"), "h1")))[0] == "open"


def test_sanitise(spark):
    cases = {"<p class=x>a<br/>b</p><script>x</script>": "<p>a<br>b</p>", "<img src=x onerror=a <b>t</b>": "&lt;img src=x onerror=a <b>t</b>", "<li>1<script>": "<li>1", "a < b": "a &lt; b", "<P>q</P>": "<P>q</P>", "<pre>z</pre>": "z"}
    for html, want in cases.items():
        assert one(spark, html, x.sanitise(F.col("html")))[0] == want


def test_labels(spark):
    html = "<table><tr><th>ISBN:</th>\n<td>1</td></tr><tr class=a><td>Metai</td> <td><b>19</b>99</td></tr><tr><th>ISBN</th><td>2</td></tr></table><dl><dt>A</dt><dd>x</dd></dl><span class=\"label\">L:</span> <span class=\"value\">v &amp; w</span><ul><li><strong>S:</strong> some <b>bold</b></li></ul>"
    got = one(spark, html, *[x.label_values(F.col("html"), k) for k in ("table", "definitions", "spans", "list")])
    assert list(got) == [{"isbn": "1", "metai": "19 99"}, {"a": "x"}, {"l": "v & w"}, {"s": "some bold"}]


def ld(*blocks):
    return "".join(f'<script type="application/ld+json">{b if isinstance(b, str) else json.dumps(b)}</script>' for b in blocks)


BOOK = {"@type": "Book", "name": "N", "author": {"name": "A"}, "offers": {"price": "3,50", "availability": "http://schema.org/InStock"}}
CRUMBS = {"@type": "BreadcrumbList", "itemListElement": [{"name": "One"}, "odd", {"name": ""}, {"item": {"name": "Two"}}]}


@pytest.mark.parametrize("html", [ld(BOOK, CRUMBS), ld([BOOK, CRUMBS]), ld({"@context": "c", "@graph": [CRUMBS, BOOK]}), ld("{broken", [[], 7, None, BOOK], CRUMBS), ld(BOOK | {"@type": ["Thing", "Book"], "author": ["A", "B"], "offers": [BOOK["offers"], {"price": 9}]}, CRUMBS) + '<script type="application/ld+json">{"@type": "Product", "name": "later", "sku": 12}'])
def test_json_ld(spark, html):
    df = spark.createDataFrame([(1, html), (2, "<p>none"), (3, None)], "id long, html string")
    rows = x.page_data(df).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.title, r.author, r.price_cents, r.in_stock, r.categories) == ("N", "A", 350, True, ["One", "Two"]) and "Book" in r.types and "BreadcrumbList" in r.types
    assert r.sku == ("12" if "later" in html else None)
    assert {q.title for q in x.json_ld(df).collect()} == ({"N", "later"} if "later" in html else {"N"})


def test_microdata():
    html = """<p itemprop="lost">x</p><div itemscope itemtype="https://schema.org/Product"><span itemprop="name">A <b>B</b> &amp; C</span><a itemprop="url" href="/u">t</a><link itemprop="x" href="/l"/>
      <div itemprop="offers" itemscope itemtype="http://schema.org/Offer"><meta itemprop=price content=3><time itemprop="until" datetime="2024">soon</time></i></div><em itemprop="note">open<div itemscope itemtype="T"><u itemprop="deep">d</u></div>"""
    assert m.microdata_of(html) == [
        ("", "Product", "name", "A B & C"), ("", "Product", "url", "/u"), ("", "Product", "x", "/l"), ("", "Product", "offers", None), ("offers", "Offer", "price", "3"), ("offers", "Offer", "until", "2024"),
        ("", "Product", "note", "open d"), ("", "T", "deep", "d"),
    ]
    assert m.microdata_of("") == [] and len(m.microdata_of("<div itemscope>" + "<i itemprop=a>" * 100)) == m.DEEPEST


def test_rules_by_source(spark):
    pages = spark.createDataFrame([(1, "a", "<h1>H</h1>" + ld(BOOK)), (2, "b", "<h1>H</h1>" + ld(BOOK)), (3, "none", "<h1>H</h1>"), (4, "a", None)], "id long, source string, html string")
    rules = spark.createDataFrame([("a", "title", 2, "element", "h1"), ("a", "title", 1, "meta", "og:title"), ("b", "title", 1, "json", "title"), ("b", "title", 2, "element", "h1"), ("b", "letter", 1, "pattern", "<h1>(.)")], x.RULES)
    assert {r.id: r.fields for r in x.extract_by_rules(pages, rules, ["id"]).collect()} == {1: {"title": "H"}, 2: {"title": "N", "letter": "H"}, 3: {}, 4: {}}


def test_sitemaps(spark):
    bodies = [
        '<?xml version="1.0"?><?xml-stylesheet href="x"?>\n<urlset xmlns="n" xmlns:image="i"><url><loc><![CDATA[http://a/?x=1&y=2]]></loc><image:image><image:loc>no</image:loc></image:image></url><url><loc> http://b/&#228;&amp;&#x41; </loc></url><url><lastmod>1</lastmod></url></urlset>',
        '<s:sitemapindex xmlns:s="n"><s:sitemap><s:loc>http://c/sitemap_product_1.xml</s:loc></s:sitemap></s:sitemapindex>', "<urlset><url><loc>u1</loc></url><url><loc>u2", "no xml <", "", None, "<urlset/>", "<html><p>x</p></html>",
        '<!DOCTYPE x [<!ENTITY e SYSTEM "file:///etc/passwd">]><urlset><url><loc>&e;</loc></url></urlset>',
    ]
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    assert [(r.kind, r.locs, r.broken) for r in x.sitemaps(df).orderBy("id").collect()] == [
        ("url", ["http://a/?x=1&y=2", "http://b/ä&A"], False), ("sitemap", ["http://c/sitemap_product_1.xml"], False), ("url", [], True), ("url", [], True), ("url", [], True), ("url", [], False), ("url", [], False), ("url", [], False), ("url", [], True),
    ]
    assert x.sitemap_urls(df).count() == 3
