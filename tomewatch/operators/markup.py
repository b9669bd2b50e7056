"""Reading markup in linear time, whatever is broken in it.

No pattern here can fail after a long scan and start again behind it: classes stop at the next ``<`` or marker, lazy scans
also end at the end of the page, quantifiers give nothing back. Only nested scopes need an open-element stack; they are read
by one small scanner in Arrow batches, everything else stays in built-in expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import once

#: Elements whose content is no markup, with it; an unclosed one takes the rest of the page.
RAW = r"(?is)<(?:script|style)\b.*?(?:</(?:script|style)\b[^<>]*>?|\z)"
SCRIPT = r"(?is)<script\b([^<>]*)>(.*?)(?:</script\b[^<>]*>?|\z)"
TAG = r"<[a-zA-Z/!?][^<>]*>"
#: An attribute with a value: its name, and the value with its quotes.
PAIR = r"""([^\s"'=<>/]{1,100}+)\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'=<>`]++)"""
REFERENCES = (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def tags(html: Column, name: str) -> Column:
    """The attribute strings of all start tags of a name, in order."""
    return F.regexp_extract_all(html, F.lit(rf"(?i)<{name}\b([^<>]*)>"), F.lit(1))


def attribute(attrs: Column, name: str) -> Column:
    """The value of the first attribute of a name, as written; null without one. ``data-href`` is no ``href``."""
    names = F.transform(F.regexp_extract_all(attrs, F.lit(PAIR), F.lit(1)), F.lower)
    at = F.array_position(names, F.lit(name))
    raw = F.try_element_at(F.regexp_extract_all(attrs, F.lit(PAIR), F.lit(2)), F.nullif(at.cast("int"), F.lit(0)))
    return F.regexp_replace(raw, """^["']|["']$""", "")


def first_attribute(html: Column, tag: str, name: str) -> Column:
    """An attribute of the first tag of its kind."""
    return attribute(F.regexp_extract(html, rf"(?i)<{tag}\b([^<>]*)>", 1), name)


def meta(html: Column, name: str) -> Column:
    """The content of the first ``meta`` of a property or name."""
    hit = F.filter(tags(html, "meta"), lambda a: F.coalesce(F.lower(attribute(a, "property")) == name, F.lit(False)) | F.coalesce(F.lower(attribute(a, "name")) == name, F.lit(False)))
    return attribute(F.try_element_at(hit, F.lit(1)), "content")


def element(html: Column, tag: str) -> Column:
    """What stands between the first start tag of a name and its end tag, or the page's end; empty without one."""
    return F.regexp_extract(html, rf"(?is)<{tag}\b[^<>]*>(.*?)(?:</{tag}\b|\z)", 1)


def bare(html: Column, references: tuple[tuple[str, str], ...] = REFERENCES) -> Column:
    """Text without tags, ``references`` decoded, white space collapsed; letter case kept."""
    t = F.regexp_replace(F.regexp_replace(html, RAW, " "), "<[^<>]+>", " ")
    for name, char in references:
        t = F.replace(t, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(t, r"[\s ]+", " "))


def sanitise(html: Column, allowed: tuple[str, ...] = ("p", "br", "b", "strong", "i", "em", "ul", "ol", "li")) -> Column:
    """Only the allowed tags, without attributes; a ``<`` that is left of a broken tag is escaped."""
    names = "|".join(allowed)
    t = F.regexp_replace(F.regexp_replace(html, RAW, ""), rf"(?i)<(/?)({names})\b[^<>]*>", "<$1$2>")
    return F.regexp_replace(F.regexp_replace(t, rf"(?i)<(?!/?(?:{names})>)[^<>]*>", ""), rf"(?i)<(?!/?(?:{names})>)", "&lt;")


#: Label and value markups: the tags that become marks, then the pattern over the marks (label, value).
_A, _B, _C, _D = "\u0001", "\u0002", "\u0003", "\u0004"
LABELS = {
    "table": (((r"(?i)<tr\b[^<>]*>", _D), (r"(?i)<t[hd]\b[^<>]*>", _A), (r"(?i)</t[hd]\b[^<>]*>", _C)), f"{_D}\\s*+{_A}([^{_A}-{_D}]*+){_C}\\s*+{_A}([^{_A}-{_D}]*+){_C}"),
    "definitions": (((r"(?i)<dt\b[^<>]*>", _A), (r"(?i)<dd\b[^<>]*>", _B), (r"(?i)</d[td]\b[^<>]*>", _C)), f"{_A}([^{_A}-{_D}]*+){_C}\\s*+{_B}([^{_A}-{_D}]*+){_C}"),
    "spans": (((r'(?i)<span class="label">', _A), (r'(?i)<span class="value">', _B), (r"(?i)</span\b[^<>]*>", _C)), f"{_A}([^{_A}-{_D}]*+){_C}\\s*+{_B}([^{_A}-{_D}]*+){_C}"),
    "list": (((r"(?i)<li\b[^<>]*>", _D), (r"(?i)<(?:b|strong)\b[^<>]*>", _A), (r"(?i)</(?:b|strong)\b[^<>]*>", _B), (r"(?i)</li\b[^<>]*>", _C)), f"{_D}\\s*+{_A}([^{_A}-{_D}]*+){_B}([^{_C}{_D}]*+){_C}"),
}


def labelled(html: Column, markup: str) -> Column:
    """An array of the labels and values of one markup, as text, in structs (k, v)."""
    marks, pattern = LABELS[markup]
    t = F.translate(html, _A + _B + _C + _D, "")
    for tag, mark in marks:
        t = F.regexp_replace(t, tag, mark)
    plain = lambda v: bare(F.translate(v, _A + _B + _C + _D, ""))
    found = lambda t, k: F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(k)), plain)
    return once(t, lambda t: F.arrays_zip(found(t, 1).alias("k"), found(t, 2).alias("v")))


def json_blocks(html: Column) -> Column:
    """The texts of all ``application/ld+json`` scripts, control characters blanked."""
    blocks = F.arrays_zip(F.regexp_extract_all(html, F.lit(SCRIPT), F.lit(1)).alias("a"), F.regexp_extract_all(html, F.lit(SCRIPT), F.lit(2)).alias("b"))
    ours = F.filter(blocks, lambda s: F.lower(F.trim(attribute(s["a"], "type"))) == "application/ld+json")
    return F.transform(ours, lambda s: F.regexp_replace(s["b"], r"[\x00-\x1f]", " "))


# Elements without an end tag, and where an item's property stands in an attribute.
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
VALUE_IN = {"a": "href", "area": "href", "link": "href", "img": "src", "audio": "src", "video": "src", "source": "src", "iframe": "src", "embed": "src", "object": "data", "time": "datetime", "data": "value", "meter": "value"}
#: Open properties within one another; deeper ones are not read, as their texts would repeat each other.
DEEPEST = 32
_SCAN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>")
_PAIR = re.compile(r"""([^\s"'=<>/]{1,100}+)(?:\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'=<>`]++))?""")
_RAW = re.compile(RAW.replace(r"\z", r"\Z"))


_HIDDEN = re.compile(_RAW.pattern + r"|<!--.*?(?:-->|\Z)|<![^<>]*>")


def _attrs(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _PAIR.findall(text):
        out.setdefault(name.lower(), unescape(value[1:-1] if value[:1] in "\"'" else value))
    return out


def scan(html: str) -> Iterator[tuple[bool, str, dict[str, str], str | None]]:
    """A page as (end tag, tag, attributes, None) and (False, "", {}, text) in order; scripts, styles and comments are left out."""
    page, at = _HIDDEN.sub("", html), 0
    for found in _SCAN.finditer(page):
        if found.start() > at:
            yield False, "", {}, unescape(page[at : found.start()])
        at = found.end()
        yield bool(found[1]), found[2].lower(), _attrs(found[3]) if found[3] and not found[1] else {}, None
    if at < len(page):
        yield False, "", {}, unescape(page[at:])


def microdata_of(html: str) -> list[tuple[str, str, str, str | None]]:
    """(scope, type, property, value) of a page in order of the start tags: a stack of open elements and one scan.

    ``scope`` is the path of property names from the outermost item, separated by dots; a nested item is a row of its
    own with a null value. An element that is never closed ends with the page. A stray end tag is ignored.
    """
    page = _RAW.sub(" ", html)
    rows: list[list] = []
    text: list[str] = []
    open_: list[tuple[str, int, int, bool]] = []  # tag, row that takes its text or -1, first piece of text, whether an item
    scopes: list[tuple[str, str]] = []  # path and type of the open items
    standing: dict[str, int] = {}
    props = at = 0

    def close() -> None:
        nonlocal props
        tag, row, start, item = open_.pop()
        standing[tag] -= 1
        if row >= 0:
            rows[row][3] = " ".join(unescape(" ".join(text[start:])).split())
            props -= 1
        if item:
            scopes.pop()

    for m in _SCAN.finditer(page):
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if standing.get(tag):
                while open_[-1][0] != tag:
                    close()
                close()
            continue
        attrs = _attrs(m[3]) if "item" in m[3].lower() else {}
        prop, item, row = attrs.get("itemprop", "").strip(), "itemscope" in attrs, -1
        path, kind = scopes[-1] if scopes else ("", "")
        if prop and scopes and props < DEEPEST:
            rows.append([path, kind, prop, None])
            if not item:
                given = attrs.get("content", attrs.get(VALUE_IN.get(tag, "content")))
                if given is not None:
                    rows[-1][3] = given.strip()
                elif tag not in VOID:
                    row, props = len(rows) - 1, props + 1
        if tag not in VOID and not m[3].endswith("/"):
            if item:
                scopes.append((f"{path}.{prop}" if path and prop else prop, attrs.get("itemtype", "").strip().rsplit("/", 1)[-1]))
            open_.append((tag, row, len(text), item))
            standing[tag] = standing.get(tag, 0) + 1
    if at < len(page):
        text.append(page[at:])
    while open_:
        close()
    return [tuple(r) for r in rows]


def microdata(df: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """Properties of all items of a page: the keys, position, scope, type, property, value. Pages without any go no further than a search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(k, p, *r) for k, page in enumerate(b.column(0).to_pylist()) for p, r in enumerate(microdata_of(page))]
            at = pa.array([f[0] for f in found], pa.int64())
            made = [pa.array([f[k] for f in found], t) for k, t in ((1, pa.int32()), (2, pa.string()), (3, pa.string()), (4, pa.string()), (5, pa.string()))]
            yield pa.RecordBatch.from_arrays([*[c.take(at) for c in b.columns[1:]], *made], [*keys, "position", "scope", "type", "property", "value"])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys)
    return df.where(F.col(html).contains("itemprop")).select(F.col(html), *keys).mapInArrow(run, f"{schema}, position int, scope string, type string, property string, value string")
