"""Structured rows out of fetched pages and feeds: rule tables over built-in expressions, Python only for Markdown."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import once, plain_text, price_text_cents
from . import markup as m
from .markup import bare, sanitise  # noqa: F401

@dataclass(frozen=True)
class Rule:
    """A field and what may give it, best first: patterns with one group, or functions of the page; ``strip`` leaves text only."""

    field: str
    patterns: tuple[str | Callable[[Column], Column], ...]
    strip: bool = True


def meta(name: str) -> Callable[[Column], Column]:
    return lambda html: m.meta(html, name)


def element(tag: str) -> Callable[[Column], Column]:
    return lambda html: m.element(html, tag)


PAGE_RULES = (
    Rule("title", (meta("og:title"), element("h1"), element("title"))),
    Rule("heading", (element("h1"),)),
    Rule("language", (lambda html: F.regexp_extract(m.first_attribute(html, "html", "lang"), "^[A-Za-z-]+", 0),), strip=False),
    Rule("image_url", (meta("og:image"),), strip=False),
    Rule("description", (meta("og:description"), meta("description"))),
)


def extract(df: DataFrame, rules: tuple[Rule, ...] = PAGE_RULES, html: str = "html", references: tuple[tuple[str, str], ...] = m.REFERENCES) -> DataFrame:
    """The fields of a rule table, one column each; the first pattern that yields text wins. ``references`` are those decoded in text."""

    def field(rule: Rule) -> Column:
        given = [F.regexp_extract(html, p, 1) if isinstance(p, str) else p(F.col(html)) for p in rule.patterns]
        return F.coalesce(*[F.nullif(bare(g, references) if rule.strip else g, F.lit("")) for g in given]).alias(rule.field)

    return df.select(*[c for c in df.columns if c != html], *[field(r) for r in rules])


def _text(v: Column, *paths: str) -> Column:
    """The first of some paths of a variant that holds text or a number; objects and lists are none."""
    held = [F.when(F.schema_of_variant(F.try_variant_get(v, p, "variant")).rlike("^(?:STRING|BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, p, "string")) for p in paths]
    return F.coalesce(*[F.nullif(F.trim(h), F.lit("")) for h in held])


def _several(v: Column, path: str) -> Column:
    """The members of a list, or the one value that stands in its place, as variants; null where there is neither."""
    one = F.try_variant_get(v, path, "variant")
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.when(one.isNotNull(), F.array(one)))


def json_nodes(df: DataFrame, html: str = "html") -> DataFrame:
    """One row for every node of a page's JSON-LD: members of lists and of ``@graph`` too. Adds position, node (variant), types.

    Broken blocks give nothing. A node's types are its ``@type``, one or several.
    """
    keys = [c for c in df.columns if c != html]
    blocks = df.select(*keys, F.posexplode(m.json_blocks(F.col(html))).alias("_p", "_b")).withColumn("_v", F.try_parse_json("_b"))
    tops = blocks.select(*keys, "_p", F.posexplode(_several(F.col("_v"), "$")).alias("_q", "_t"))
    inner = F.concat(F.array("_t"), F.coalesce(_several(F.col("_t"), "$['@graph']"), F.array().cast("array<variant>")))
    nodes = tops.select(*keys, "_p", "_q", F.posexplode(inner).alias("_r", "node"))
    types = F.filter(F.transform(_several(F.col("node"), "$['@type']"), lambda t: t.try_cast("string")), lambda t: t.isNotNull())
    return nodes.select(*keys, F.struct("_p", "_q", "_r").alias("position"), "node", F.coalesce(types, F.array().cast("array<string>")).alias("types"))


def _product(v: Column) -> dict[str, Column]:
    """The fields of a Product or Book node; people, images and offers may be text, an object or a list, of which the first counts."""
    first = lambda path: F.try_element_at(_several(v, path), F.lit(1))
    offer = first("$.offers")
    availability = _text(offer, "$.availability")
    return {
        "title": bare(_text(v, "$.name")), "description": _text(v, "$.description"), "author": F.coalesce(_text(first("$.author"), "$"), _text(first("$.author"), "$.name")),
        "publisher": F.coalesce(*[_text(first(p), x) for p in ("$.publisher", "$.brand") for x in ("$", "$.name")]), "isbn": _text(v, "$.gtin13", "$.isbn", "$.isRelatedTo.isbn"),
        "sku": F.coalesce(_text(v, "$.sku"), _text(offer, "$.sku")), "image_url": F.coalesce(_text(first("$.image"), "$"), _text(first("$.image"), "$.url")),
        "price_cents": price_text_cents(_text(offer, "$.price", "$.lowPrice")), "in_stock": availability.ilike("%InStock%"),
        "rating": _text(v, "$.aggregateRating.ratingValue").try_cast("decimal(3,2)"), "review_count": _text(v, "$.aggregateRating.reviewCount").try_cast("int"),
    }


def json_ld(df: DataFrame, html: str = "html") -> DataFrame:
    """Product and Book nodes of a page, one row each, in whatever block, list or graph they stand."""
    nodes = json_nodes(df, html).where(F.arrays_overlap("types", F.array(F.lit("Product"), F.lit("Book"))))
    return nodes.select(*[c for c in df.columns if c != html], *[v.alias(k) for k, v in _product(F.col("node")).items()], "types")


def page_data(df: DataFrame, html: str = "html") -> DataFrame:
    """One row a page with JSON-LD: of each field the first Product or Book that has it, all types, and the categories.

    Categories are the names along the page's last BreadcrumbList, top level first as it lists them. The other columns
    are the page's keys.
    """
    keys = [c for c in df.columns if c != html]
    nodes = json_nodes(df, html)
    product = F.arrays_overlap("types", F.array(F.lit("Product"), F.lit("Book")))
    fields = _product(F.col("node"))
    crumbs = F.transform(_several(F.col("node"), "$.itemListElement"), lambda e: bare(F.coalesce(_text(e, "$.name"), _text(e, "$.item.name"))))
    is_list = F.array_contains("types", "BreadcrumbList")
    wide = nodes.select(*keys, "position", "types", *[F.when(product, v).alias(k) for k, v in fields.items()], F.when(is_list, F.filter(F.coalesce(crumbs, F.array().cast("array<string>")), lambda c: c != "")).alias("_crumbs"))
    best = [F.min_by(k, F.when(F.col(k).isNotNull(), F.col("position"))).alias(k) for k in fields]
    types = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("position", "types"))), lambda s: s["types"]))
    return wide.groupBy(*keys).agg(*best, types.alias("types"), F.coalesce(F.max_by("_crumbs", F.when(F.col("_crumbs").isNotNull(), F.col("position"))), F.array().cast("array<string>")).alias("categories"))


def label_values(html: Column, markup: str) -> Column:
    """A map of label to value from one of the label markups; a repeated label keeps its first value."""
    return once(_keyed(m.labelled(html, markup)), lambda pairs: F.map_from_entries(_first_of(pairs, "k", "v")))


def _keyed(pairs: Column) -> Column:
    """Labels and values (k, v) with the labels as keys."""
    return F.transform(pairs, lambda e: F.struct(F.rtrim(plain_text(e["k"]), F.lit(": ")).alias("k"), e["v"].alias("v")))


def _first_of(pairs: Column, key: str, value: str) -> Column:
    """Structs (key, value) of an array, of a repeated key the first."""

    def first(keys: Column) -> Column:
        placed = F.transform(pairs, lambda e, i: F.struct(e[key].alias("key"), e[value].alias("value"), i.alias("i")))
        return F.transform(F.filter(placed, lambda e: F.array_position(keys, e["key"]) == e["i"] + 1), lambda e: F.struct(e["key"], e["value"]))

    return once(F.transform(pairs, lambda e: e[key]), first)


#: Rule tables as data: the rules of a source, by field and rank. Kinds: meta, element, label, pattern (one group) and json (a field of ``page_data``).
RULES = "source string, field string, rank int, kind string, argument string"


def extract_by_rules(df: DataFrame, rules: DataFrame, keys: list[str], source: str = "source", html: str = "html") -> DataFrame:
    """Pages read by the rule table of their source: the keys, the source and ``fields``, a map of field to text.

    A rule table is joined by source (a source's rules are few, so they travel as one array) and evaluated over that
    array; of a field's rules the first by rank that yields text wins, ties by kind and argument. A source without
    rules gives an empty map. Rules of kind ``json`` read the first value on a page of that field of Product and Book
    nodes; only sources that have such rules parse JSON. Pages are told apart by their keys.
    """
    ruled = rules.where("kind <> 'json'").groupBy(F.col("source").alias(source)).agg(F.array_sort(F.collect_list(F.struct("field", "rank", "kind", "argument"))).alias("_rules"))
    col = F.col(html)
    metas = F.transform(m.tags(col, "meta"), lambda a: F.struct(F.lower(F.coalesce(m.attribute(a, "property"), m.attribute(a, "name"))).alias("k"), m.attribute(a, "content").alias("v")))
    labels = F.flatten(F.array(*[_keyed(m.labelled(col, x)) for x in m.LABELS]))
    pages = df.join(ruled, source, "left").select(*keys, source, html, F.coalesce("_rules", F.array().cast("array<struct<field: string, rank: int, kind: string, argument: string>>")).alias("_rules"), metas.alias("_metas"), labels.alias("_labels"))
    held = lambda pairs, name: F.try_element_at(F.filter(pairs, lambda e: e["k"] == name), F.lit(1))["v"]

    def value(r: Column) -> Column:
        name = F.lower(r["argument"])
        opened = F.concat(F.lit(r"(?is)<"), r["argument"], F.lit(r"\b[^<>]*>(.*?)(?:</"), r["argument"], F.lit(r"\b|\z)"))
        kinds = {"meta": lambda: bare(held(F.col("_metas"), name)), "label": lambda: held(F.col("_labels"), name), "element": lambda: bare(F.call_function("regexp_extract", col, opened, F.lit(1))), "pattern": lambda: bare(F.call_function("regexp_extract", col, r["argument"], F.lit(1)))}
        out = F.lit(None).cast("string")
        for kind, make in kinds.items():
            out = F.when(r["kind"] == kind, make()).otherwise(out)
        return F.nullif(out, F.lit(""))

    given = F.transform("_rules", lambda r: F.struct(r["field"].alias("field"), r["rank"].alias("rank"), value(r).alias("value")))
    found = pages.select(*keys, source, F.filter(given, lambda g: g["value"].isNotNull()).alias("_given"))
    wanted = rules.where("kind = 'json'").select(F.col("source").alias(source), "field", "rank", "argument")
    # the array of one page is small: a rule each
    data = page_data(df.join(wanted.select(source).distinct(), source, "left_semi").select(*keys, source, html))
    texts = [F.struct(F.lit(k).alias("k"), F.col(k).cast("string").alias("v")) for k in ("title", "description", "author", "publisher", "isbn", "sku", "image_url", "price_cents", "in_stock", "rating", "review_count")]
    texts.append(F.struct(F.lit("category").alias("k"), F.try_element_at("categories", F.lit(-1)).alias("v")))
    json = data.select(*keys, source, F.explode(F.array(*texts)).alias("t")).where("t.v is not null").join(wanted.withColumnRenamed("argument", "_k"), [source]).where("t.k = _k")
    json = json.groupBy(*keys, source).agg(F.collect_list(F.struct("field", "rank", F.col("t.v").alias("value"))).alias("_json"))
    both = found.join(json, [*keys, source], "left") if keys else found
    every = F.array_sort(F.concat("_given", F.coalesce("_json", F.array().cast("array<struct<field: string, rank: int, value: string>>"))))
    return both.select(*keys, source, once(every, lambda rows: F.map_from_entries(_first_of(rows, "field", "value"))).alias("fields"))


def cards(df: DataFrame, marker: str, rules: tuple[Rule, ...], html: str = "html") -> DataFrame:
    """Listing cards: the page split before each ``marker``, the rules' fields of each piece, first card per URL kept."""
    pieces = df.select(*[c for c in df.columns if c != html], F.posexplode(F.split(html, f"(?={marker})")).alias("position", "piece")).where(F.col("position") > 0)
    found = extract(pieces, rules, "piece").where("url is not null")
    keys = [c for c in df.columns if c != html]
    from .windows import latest_per_key

    return latest_per_key(found, [*keys, "url"], [F.asc("position")])


def internal_links(df: DataFrame, known: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """New links of a page below its own scheme and host: resolved, without fragment, distinct, minus the known ones."""
    base = F.regexp_extract(url, "^([a-z]+://[^/?#]+)", 1)
    href = F.explode(F.array_distinct(F.transform(m.tags(F.col(html), "a"), lambda a: F.trim(F.substring_index(m.attribute(a, "href"), "#", 1)))))
    links = df.select(base.alias("base"), href.alias("href")).where("href <> ''")
    full = F.when(F.col("href").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.col("href")).when(F.col("href").startswith("/"), F.concat("base", "href")).otherwise(F.concat(F.col("base"), F.lit("/"), F.col("href")))
    return links.select("base", full.alias("url")).where(F.col("url").startswith(F.col("base"))).select("url").distinct().join(known.select("url"), "url", "left_anti")


def stock_signals(html: Column, window: int = 600) -> Column:
    """False if the page hides its price, disables the cart or leaves the price block empty; null if it says nothing."""
    t = F.regexp_replace(html, m.RAW, "")
    at = F.locate('class="price"', t)
    block = F.when(at > 0, F.substring(t, at, F.lit(window)))
    hidden = t.rlike(r"(?i)class=\"[^\"]*price-hidden|not-for-sale")
    disabled = F.exists(m.tags(t, "button"), lambda a: F.contains(F.lower(a), F.lit("add-to-cart")) & a.rlike(r"(?i)\bdisabled"))
    return F.when(hidden | disabled | (block.isNotNull() & ~block.rlike("[0-9]")), F.lit(False)).when(block.rlike("[0-9]"), F.lit(True))


def rating(text: Column) -> Column:
    """struct(rating, reviews, planned) from visible text."""
    return F.struct(
        F.replace(F.regexp_extract(text, r"([0-5](?:[.,][0-9]{1,2})?)\s*/\s*5", 1), F.lit(","), F.lit(".")).try_cast("decimal(3,2)").alias("rating"),
        F.regexp_extract(text, r"\(([0-9]+)\)", 1).try_cast("int").alias("reviews"),
        F.regexp_extract(text, r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1).try_cast("date").alias("planned"),
    )


def language_block(df: DataFrame, wanted: tuple[str, ...] = ("lt",), language: str = "language") -> DataFrame:
    """Records in another language are no products, with the reason."""
    other = F.col(language).isNotNull() & ~F.lower(language).isin(*wanted)
    return df.withColumn("is_book", F.col("is_book") & ~other).withColumn("block_reason", F.when(other, F.concat(F.lit("language:"), F.lower(language))))


def response_findings(df: DataFrame, html: str = "html", final_url: str = "url", smallest: int = 1024, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, url, issue): bodies below ``smallest`` bytes, and redirects to a top-level page."""
    top = F.col(final_url).rlike(r"^[a-z]+://[^/]+/?(?:[a-z]{2}/?)?(?:[?#].*)?$")
    issues = F.array_compact(F.array(F.when(F.octet_length(html) < smallest, "empty_response"), F.when(top, "redirect_to_homepage")))
    return df.select(*keys, F.col(final_url).alias("url"), F.explode(issues).alias("issue"))


# Tags of a store that tell the type, and vendors that are no author.
TAG_TYPES = {"ebook": ("EKNYGA", "E-KNYGA", "EBOOK"), "audio": ("AUDIOKNYGA", "AUDIO"), "non_book": ("DOVANOS", "ZAISLAI", "KANCELIARIJA"), "book": ("KNYGOS", "KNYGA", "BOOK")}
NO_AUTHOR = ("", "-", "N/A", "NAN", "KITA", "NEZINOMAS")


def store_type(tags: Column, vendor: Column) -> Column:
    """struct(type, author) from a store's tags (an array) and vendor."""
    up = F.transform(tags, lambda t: F.translate(F.upper(F.trim(t)), "ĄČĘĖĮŠŲŪŽ", "ACEEISUUZ"))
    kind = F.lit(None).cast("string")
    for name, marks in reversed(TAG_TYPES.items()):
        kind = F.when(F.arrays_overlap(up, F.array(*[F.lit(m) for m in marks])), name).otherwise(kind)
    return F.struct(kind.alias("type"), F.when(~F.upper(F.trim(vendor)).isin(*NO_AUTHOR), F.trim(vendor)).alias("author"))


def tag_list(tags: Column) -> Column:
    """Tags of a comma-separated string."""
    return F.filter(F.transform(F.split(tags, ","), lambda t: F.trim(t)), lambda t: t != "")


def feed_items(df: DataFrame, schema: str, path: str, body: str = "body") -> DataFrame:
    """Rows of the array at ``path`` of a JSON feed page; unreadable bodies give none."""
    parsed = F.from_json(body, schema)
    for part in path.split("."):
        parsed = parsed[part]
    return df.select(*[c for c in df.columns if c != body], F.inline(parsed))


SITEMAP = "url array<struct<loc: string>>, sitemap array<struct<loc: string>>, _broken string"
XML = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken", "ignoreNamespace": "true", "ignoreSurroundingSpaces": "true"}


def sitemaps(df: DataFrame, body: str = "body") -> DataFrame:
    """Sitemap bodies read as XML: adds kind (url, sitemap), locs (array) and broken in place of the body.

    The XML declaration is skipped. Namespaces, CDATA and character references are resolved; entities that a body declares itself are not. A body that is
    no well-formed XML is broken and holds nothing; a null body, another document and an empty list are not broken.
    """
    parsed = df.select(*[c for c in df.columns if c != body], F.from_xml(F.regexp_replace(body, r"^[\s\x{FEFF}]*<\?xml[^<>]*\?>", ""), SITEMAP, XML).alias("_x"))
    kind = F.when(F.col("_x.sitemap").isNotNull(), "sitemap").otherwise("url")
    locs = F.transform(F.coalesce(F.col("_x.sitemap"), F.col("_x.url"), F.array().cast("array<struct<loc: string>>")), lambda e: F.nullif(F.trim(e["loc"]), F.lit("")))
    return parsed.select(*[c for c in df.columns if c != body], kind.alias("kind"), F.array_compact(locs).alias("locs"), F.col("_x._broken").isNotNull().alias("broken"))


def sitemap_urls(df: DataFrame, body: str = "body") -> DataFrame:
    """The locations of a ``urlset``; of a ``sitemapindex`` the children to read next. Broken bodies give none.

    Returns the other columns plus ``kind`` (url, sitemap) and ``loc``.
    """
    return sitemaps(df, body).select(*[c for c in df.columns if c != body], "kind", F.explode("locs").alias("loc"))


def children(index: DataFrame, pages: DataFrame, mark: str = "sitemap_product", body: str = "body") -> DataFrame:
    """URL rows of the product children of sitemap indexes, found among the fetched pages."""
    wanted = index.where((F.col("kind") == "sitemap") & F.contains("loc", F.lit(mark))).select(F.col("loc").alias("url")).distinct()
    return sitemap_urls(pages.join(wanted, "url", "left_semi"), body)


ROLES = {"aut": "author", "trl": "translator", "ill": "illustrator", "nrt": "narrator", "edt": "editor"}
LIBRARY = "code string, title string, year string, isbns array<string>, languages array<string>, people array<struct<name: string, role: string, code: string>>"


def library_records(df: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(works, isbns, people) of library records: ISBNs typed by length, role codes named, places counted per role."""
    from pyspark.sql import Window

    from ..functions.isbn import normalize
    from ..functions.text import year_of

    r = df.select(F.from_json(body, LIBRARY).alias("r")).where("r.code is not null").select("r.*")
    works = r.select("code", "title", year_of(F.col("year")).alias("year"), "languages")
    isbns = r.select("code", F.explode("isbns").alias("i")).select("code", normalize(F.col("i")).alias("isbn")).distinct()
    isbns = isbns.withColumn("isbn_type", F.when(F.length("isbn") == 10, "isbn10").when(F.length("isbn") == 13, "isbn13").otherwise("unknown"))
    named = F.create_map(*[F.lit(x) for p in ROLES.items() for x in p])
    people = r.select("code", F.posexplode("people").alias("p", "who")).select("code", "p", F.col("who.name").alias("name"), F.coalesce(named[F.col("who.role")], F.lit("other")).alias("role"))
    people = people.groupBy("code", "name", "role").agg(F.min("p").alias("p"))
    place = F.row_number().over(Window.partitionBy("code", "role").orderBy("p")) - 1
    return works, isbns, people.select("code", "name", "role", place.alias("position"))


# Where a record is read, words of a carrier that is heard, and what bindings are called.
RECORD = "https://ibiblioteka.lt/metis-api/bibliographic-records/public/"
HEARD = ("mp3", "audio", "val.,", "min.,")
BINDINGS = (("Kieti viršeliai", ("kietais viršeliais", "kieti viršeliai")), ("Minkšti viršeliai", ("minkštais viršeliais", "minkšti viršeliai")))


def library_parts(df: DataFrame, body: str = "body") -> DataFrame:
    """The parts of multipart records, to be read next: (code, position, part_code, url); parts without a code are left out."""
    r = df.select(F.from_json(body, "code string, multipart string, parts array<struct<code: string>>").alias("r")).select("r.*")
    many = r.where(F.lower("multipart").isin("true", "1"))
    each = many.select("code", F.posexplode("parts").alias("position", "p")).where("coalesce(p.code, '') <> ''")
    return each.select("code", "position", F.col("p.code").alias("part_code"), F.concat(F.lit(RECORD), "p.code").alias("url"))


def carrier(publication: Column, physical: Column) -> Column:
    """struct(type, format) of a record: electronic ones are audio if their physical description says so, else e-books; others are books by binding."""
    text = F.lower(F.coalesce(physical, F.lit("")))
    holds = lambda words: F.greatest(*[F.contains(text, F.lit(w)) for w in words])
    electronic = F.coalesce(publication == "ELECTRONIC", F.lit(False))
    kind = F.when(electronic & holds(HEARD), "audio").when(electronic, "ebook").otherwise("book")
    bound = F.when(electronic, kind)
    for name, words in BINDINGS:
        bound = bound.when(holds(words), name)
    return F.struct(kind.alias("type"), bound.alias("format"))


def nested_product(df: DataFrame, body: str = "body") -> DataFrame:
    """A nested JSON product flattened: price pair, attribute list as a map, categories, language filter to come after."""
    schema = "id long, name string, price struct<final: string, regular: string>, attributes array<struct<label: string, value: string>>, categories array<struct<id: int, name: string>>, ld string"
    p = df.select(*[c for c in df.columns if c != body], F.from_json(body, schema).alias("p"))
    labels = F.map_from_entries(F.transform(F.col("p.attributes"), lambda a: F.struct(plain_text(a["label"]), a["value"])))
    ld = F.try_parse_json("p.ld")
    return p.select(
        *[c for c in df.columns if c != body], F.col("p.id").alias("id"), F.col("p.name").alias("title"), price_text_cents(F.col("p.price.final")).alias("price_cents"),
        F.coalesce(price_text_cents(F.col("p.price.regular")), price_text_cents(F.col("p.price.final"))).alias("original_cents"), labels.alias("properties"),
        F.coalesce(labels["isbn"], _text(ld, "$.isbn")).alias("isbn"), F.transform(F.col("p.categories"), lambda c: c["name"]).alias("categories"),
    )


def category_names(df: DataFrame, names: DataFrame, ids: str = "category_ids") -> DataFrame:
    """Arrays of category ids as arrays of names, in their order; unknown ids drop out."""
    keys = [c for c in df.columns if c != ids]
    each = df.select(*keys, F.posexplode_outer(ids).alias("_p", "_id")).join(names.select(F.col("id").alias("_id"), F.col("name").alias("_name")), "_id", "left")
    listed = F.sort_array(F.collect_list(F.when(F.col("_name").isNotNull(), F.struct("_p", "_name"))))
    return each.groupBy(*keys).agg(F.transform(listed, lambda s: s["_name"]).alias("categories"))


class _Markdown:
    """Turns description markup into Markdown, tag by tag."""

    MARK = {"b": "**", "strong": "**", "i": "*", "em": "*"}
    #: Levels of indentation of lists; deeper ones stay at the last, as indentation would outgrow the text.
    DEEPEST = 16

    def __init__(self):
        self.out: list[str] = []
        self.lists: list[list] = []
        self.href = ""
        self.cells: list[str] | None = None
        self.cell = -1
        self.rows = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "div", "table"):
            self.out.append("\n\n")
        elif tag == "br":
            self.out.append("\n")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.out.append("\n")
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.out.append("\n" + "  " * min(len(self.lists) - 1, self.DEEPEST) + (f"{kind[1]}. " if kind[0] == "ol" else "- "))
        elif tag[0] == "h" and tag[1:].isdigit():
            self.out.append("\n\n" + "#" * int(tag[1:]) + " ")
        elif tag in self.MARK:
            self.out.append(self.MARK[tag])
        elif tag == "a":
            self.href = attrs.get("href", "")
            self.out.append("[")
        elif tag == "tr":
            self.cells = []
        elif tag in ("td", "th"):
            self.cell = len(self.out)

    def handle_endtag(self, tag):
        if tag in self.MARK:
            self.out.append(self.MARK[tag])
        elif tag == "a":
            self.out.append(f"]({self.href})" if self.href else "]")
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self.out.append("\n")
        elif tag in ("td", "th") and self.cells is not None and self.cell >= 0:
            self.cells.append("".join(self.out[self.cell :]).strip())
            del self.out[self.cell :]
            self.cell = -1
        elif tag == "tr" and self.cells is not None:
            self.out.append("\n| " + " | ".join(self.cells) + " |")
            if self.rows == 0:
                self.out.append("\n|" + " --- |" * len(self.cells))
            self.rows, self.cells = self.rows + 1, None
        elif tag == "table":
            self.rows = 0
            self.out.append("\n\n")
        elif tag in ("p", "div") or tag[0] == "h" and tag[1:].isdigit():
            self.out.append("\n\n")

    def handle_data(self, data):
        self.out.append(" ".join(data.replace(" ", " ").split(" ")) if "\n" not in data else " ".join(data.split()))


def to_markdown(html: str | None) -> str | None:
    if html is None or "<" not in html:
        return html
    parser = _Markdown()
    for end, tag, attrs, data in m.scan(html):
        if data is not None:
            parser.handle_data(data)
        elif end:
            parser.handle_endtag(tag)
        else:
            parser.handle_starttag(tag, attrs)
    lines = [re.sub(r" {2,}(?=\S)", " ", line).rstrip() if not line.startswith("  ") else line.rstrip() for line in "".join(parser.out).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def markdown(df: DataFrame, html: str, keep: list[str]) -> DataFrame:
    """Descriptions as Markdown, in Arrow batches: the one extraction that built-in expressions cannot give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([to_markdown(h) for h in b.column(0).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], made], [*keep, "markdown"])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(F.col(html), *keep).mapInArrow(run, f"{schema}, markdown string")
