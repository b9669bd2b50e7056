"""WARC derivatives: metadata and plain-text conversion records built from response records."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements whose content is no text, and elements that end a line.
HIDDEN = ("script", "style", "noscript", "template")
BLOCKS = (
    "address", "article", "aside", "blockquote", "body", "br", "dd", "div", "dl", "dt", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "table",
    "td", "th", "title", "tr", "ul",
)
_BLOCK = frozenset(BLOCKS)
_HIDDEN_END = {name: re.compile(f"</{name}", re.I) for name in HIDDEN}
_NAME = re.compile(r"[A-Za-z0-9_]*")
_TITLE_END = re.compile(r"</title", re.I)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_LANG = re.compile(r"[A-Za-z-]+")
_CHARSET = re.compile(r"""\bcharset\s*=\s*["']?([A-Za-z0-9_-]+)""", re.I)
_REFERENCE = re.compile(r"&(?:#([0-9]{1,7})|#[xX]([0-9A-Fa-f]{1,6})|([A-Za-z][A-Za-z0-9]*));")
_WHITE = re.compile(r"[ \t\r\n]+")
_SPACES = re.compile("[ \u00a0]{2,}|\u00a0")
_LINES = re.compile(" ?\n[ \n]*")
_LINE_BREAKS = dict.fromkeys(map(ord, "\t\r\n"))
_AS_SPACE = dict.fromkeys(map(ord, "\t\r\n\f"), " ")


@dataclass
class Page:
    """What one pass over a page finds."""

    title: str = ""
    lang: str = ""
    charset: str = ""
    links: list[str] = field(default_factory=list)
    text: str = ""


def _character(m: re.Match) -> str:
    if m[3]:
        return html5.get(m[3] + ";", m[0])
    code = int(m[1]) if m[1] else int(m[2], 16)
    return chr(code) if 0 < code < 0xD800 or 0xDFFF < code <= 0x10FFFF else m[0]


def references(text: str) -> str:
    """Numeric and named character references as characters, each decoded once; unknown ones stay as written."""
    return _REFERENCE.sub(_character, text) if "&" in text else text


def _attribute(html: str, at: int, end: int, *names: str) -> str | None:
    """The value of the first attribute of one of ``names`` in ``html[at:end]``, the inside of a tag; None without one."""
    for m in _ATTRIBUTE.finditer(html, at, end):
        if m.lastindex > 1 and m[1].lower() in names:
            return m[m.lastindex]
    return None


def read_page(html: str) -> Page:
    """Title, language, charset, links and visible text of a page, from one pass over its tags.

    Titles and links have their references decoded; a title's white space is collapsed then, and tabs and line breaks are
    taken out of a link and spaces off its ends, so each stays on its line. Attributes count by their whole name, so
    ``data-href`` is no link. The text has one line per block, collapsed spaces and decoded references; source line breaks count as
    spaces. A tag runs from ``<`` and a letter, ``/``, ``!`` or ``?`` to the next ``>``; without one it is text.
    Comments and hidden elements run to their end or, unclosed, to the end of the page. Every search goes on
    where the last one ended, so time is linear in the page whatever its markup.
    """
    page, out = Page(), []
    last = html.rfind(">")
    title_open = True
    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            out.append(html[at:lt].translate(_AS_SPACE))
        if lt == n:
            break
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            out.append(" ")
            at = n if end < 0 else end + 3
            continue
        closing = html.startswith("/", lt + 1)
        name = _NAME.match(html, lt + 1 + closing)[0].lower()
        if not closing and name in _HIDDEN_END:
            close = _HIDDEN_END[name].search(html, lt)
            out.append(" ")
            at = html.find(">", close.end()) + 1 if close and last >= close.end() else n
            continue
        first = html[lt + 1 : lt + 2]
        if lt > last or not (first in ("/", "!", "?") or first.isascii() and first.isalpha()):
            out.append("<")
            at = lt + 1
            continue
        gt = html.find(">", lt)
        if name in _BLOCK:
            out.append("\n")
        if not closing:
            if name == "a":
                if (href := _attribute(html, lt + 2, gt, "href")) is not None:
                    page.links.append(references(href).translate(_LINE_BREAKS).strip(" "))
            elif name == "title" and title_open:
                title_open = False
                if m := _TITLE_END.search(html, gt):
                    page.title = _WHITE.sub(" ", references(html[gt + 1 : m.start()]))
            elif name == "html" and not page.lang:
                page.lang = m[0] if (m := _LANG.match(_attribute(html, lt + 5, gt, "lang", "xml:lang") or "")) else ""
            elif name == "meta" and not page.charset:
                page.charset = m[1] if (m := _CHARSET.search(html, lt, gt)) else ""
        at = gt + 1
    text = _SPACES.sub(" ", references("".join(out)))
    page.text = _LINES.sub("\n", text).strip(" \n")
    return page


def record_urn(*parts: Column) -> Column:
    """A stable ``<urn:uuid:...>`` from the MD5 of ``parts``."""
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def responses_of_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records (record_id, target_uri, date, http_headers, body) of a table of fetched pages."""
    body = F.coalesce("html", F.lit(""))
    return pages.select(
        "page_id",
        record_urn(F.lit("response"), F.col("page_id"), F.col("url")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string")).alias("http_headers"),
        F.col("html").alias("body"),
    )


def _read_pages(digested: DataFrame) -> DataFrame:
    """``_body``, the first column, becomes ``_page``: title, lang, charset, links and text."""
    page = pa.struct([("title", pa.string()), ("lang", pa.string()), ("charset", pa.string()), ("links", pa.list_(pa.string())), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [vars(read_page(t or "")) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, page), *b.columns[1:]], ["_page", *b.schema.names[1:]])

    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in digested.schema.fields[1:])
    return digested.mapInArrow(run, f"_page struct<title: string, lang: string, charset: string, links: array<string>, text: string>, {rest}")


def warc_derivatives(responses: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """A ``metadata`` and a ``conversion`` record for every response record, linked to it.

    Input columns: record_id, target_uri, date, http_headers, body (HTML), and any ``keys`` to carry along.
    Output per record: the keys, record_type, record_id, refers_to (the response's id), target_uri, date,
    content_type, content_length (bytes of the block), block_digest (of the block), payload_digest (of the
    response's body, the same in both records), source_headers, header (the record's own header lines) and
    block. Metadata blocks are ``application/warc-fields``: the source's digest, length, status line and
    content type, every header line of the response as ``sourceHeader``, the page's title, language and
    charset, and one ``outlink`` line per link in order. Digests are labelled ``sha256:``. ``record_text`` joins
    header and block to a whole record.

    A map over rows: two output rows per input row, no shuffle, so skew and lost executors do not matter.
    Each body is read in one linear pass (``read_page``), also if it is very long or its markup is broken.
    A null or empty body gives an empty conversion block of length 0 (digest of the empty string); null
    headers, dates and target URIs are left out of the header lines. Repeated rows give repeated records
    with equal ids. Extra columns are ignored unless named in ``keys``, whatever their names.
    """
    body = F.coalesce("body", F.lit(""))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    filled = lambda name, value: F.when(value != "", line(name, value))
    headers = F.coalesce("http_headers", F.lit(""))
    own = [F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)]
    digested = responses.select(
        body.alias("_body"), F.octet_length(body).cast("string").alias("_length"), *own, "record_id", "target_uri", "date", "http_headers",
        F.concat(F.lit("sha256:"), F.sha2(body, 256)).alias("payload_digest"),
    )
    fields = F.concat_ws(
        "",
        line("sourceDigest", F.col("payload_digest")),
        line("sourceLength", F.col("_length")),
        filled("httpStatus", F.regexp_extract(headers, "\\AHTTP/[0-9.]+ ([0-9]{3})", 1)),
        filled("contentType", F.regexp_extract(headers, "(?i)Content-Type: *([^\\r\\n;]+)", 1)),
        F.array_join(F.transform(F.filter(F.split(headers, "\r\n"), lambda h: h != ""), lambda h: line("sourceHeader", h)), ""),
        filled("title", F.col("_page.title")),
        filled("language", F.col("_page.lang")),
        filled("charset", F.col("_page.charset")),
        F.array_join(F.transform("_page.links", lambda u: line("outlink", u)), ""),
    )
    both = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain").alias("content_type"), F.col("_page.text").alias("block")),
    )
    out = _read_pages(digested).withColumn("_r", F.explode(both)).select(
        *[F.col(f"_key_{i}").alias(k) for i, k in enumerate(keys)],
        F.col("_r.record_type").alias("record_type"),
        record_urn(F.col("_r.record_type"), F.col("record_id")).alias("new_id"),
        F.col("record_id").alias("refers_to"),
        "target_uri", "date",
        F.col("_r.content_type").alias("content_type"),
        F.octet_length("_r.block").cast("long").alias("content_length"),
        F.concat(F.lit("sha256:"), F.sha2(F.col("_r.block"), 256)).alias("block_digest"),
        "payload_digest",
        F.col("http_headers").alias("source_headers"),
        F.col("_r.block").alias("block"),
    ).withColumnRenamed("new_id", "record_id")
    present = lambda name, value: F.when(value.isNotNull(), line(name, value))
    header = F.concat_ws(
        "",
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.col("record_id")),
        present("WARC-Refers-To", F.col("refers_to")),
        present("WARC-Target-URI", F.col("target_uri")),
        present("WARC-Date", F.col("date")),
        line("WARC-Block-Digest", F.col("block_digest")),
        line("WARC-Payload-Digest", F.col("payload_digest")),
        line("Content-Type", F.col("content_type")),
        line("Content-Length", F.col("content_length").cast("string")),
    )
    return out.withColumn("header", header)


def record_text(header: Column, block: Column) -> Column:
    """A whole record as it stands in a WARC file."""
    return F.concat(header, F.lit("\r\n"), block, F.lit("\r\n\r\n"))
