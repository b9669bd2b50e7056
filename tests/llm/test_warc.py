"""Pages of odd markup: each found by hand, and all in linear time."""

import time

import pytest

from tomewatch.llm.warc import read_page, references, responses_of_pages, warc_derivatives


def test_references():
    assert references("&#233;&#xE9;&eacute;&Auml;&amp;lt;&nope;&#0;&#xD800;&amp") == "éééÄ&lt;&nope;&#0;&#xD800;&amp"


@pytest.mark.parametrize(
    "html, text",
    [
        ("", ""),
        ("plain < 3 & more", "plain < 3 & more"),
        ("<p>a<p>b<br>c</p>", "a\nb\nc"),
        ("a<b>b</b>\r\n c&nbsp;d", "ab c d"),
        ("x<!-- <p> hidden -->y<!-- open", "x y"),
        ("a<script>var t='</p>';</SCRIPT >b<style>c", "a b"),
        ("a<scripted>b</scripted>c<my-tag>d", "abcd"),
        ("a<p b", "a<p b"),
        ("a<p <b>c", "a\nc"),
        ("<p_x>a</p_x><p-y>b", "a\nb"),
    ],
)
def test_text(html, text):
    assert read_page(html).text == text


def test_fields():
    page = read_page(
        '<HTML lang=de><meta charset="utf-8"><title> A\n B</title><title>C</title><a href="/o\'neil">1</a><a href=/x>2</a>'
        "<a class=b href='/y'>3</a><a name=z>4</a><!-- <a href=/no> --><abbr href=/no>"
    )
    assert (page.title, page.lang, page.charset, page.links) == (" A B", "de", "utf-8", ["/o'neil", "/x", "/y"])


def test_fields_with_references_and_odd_attributes():
    page = read_page(
        '<html data-lang=xx xml:lang="pl-PL"><title>A &amp;amp; B&#10;&eacute;</title><a data-href="/no" title="href=/no" HREF = "/x?a=1&amp;b=2">'
        "<a href=' /y&#10;\n?c=1&amp;amp;d '><a hreflang=de><a href><a href=''><a\nhref=/z/?q&lt;1><a class='b'href=/w>"
    )
    assert (page.title, page.lang) == ("A &amp; B é", "pl-PL")
    assert page.links == ["/x?a=1&b=2", "/y?c=1&amp;d", "", "/z/?q<1", "/w"]


@pytest.mark.parametrize("unit", ["<p ", "<a href=", "<title", "<script", "<!--", "</script", "<html lang", "&#1", "< ", "<title>", "a", " ", "\n", "<script>", "  "])
def test_linear(unit):
    html = unit * (2_000_000 // len(unit))
    for page in (html, html + ">"):
        began = time.time()
        read_page(page)
        assert time.time() - began < 8


def test_clashing_and_extra_columns(spark):
    pages = spark.createDataFrame([(1, None, "<p>x", "k", "v"), (None, "u", None, None, None)], "page_id long, url string, html string, header string, block string")
    rows = warc_derivatives(responses_of_pages(pages), keys=("page_id",)).collect()
    assert sorted((r.page_id or 0, r.record_type, r.block if r.record_type == "conversion" else "") for r in rows) == [
        (0, "conversion", ""), (0, "metadata", ""), (1, "conversion", "x"), (1, "metadata", ""),
    ]
    assert all("sourceHeader: Content-Type: text/html\r\n" in r.block for r in rows if r.record_type == "metadata")
