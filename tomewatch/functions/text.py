"""Text expressions: folding, tokens, slugs and their mismatches, names, formats and numbers in text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with marks and their base letters; keywords of non-book goods.
MARKED = "ąčęėįšųūžáàâäãåāăćçďéèêëēěíìîïīĺľńňñóòôöõōőŕřśşťţúùûüůűýÿźżģķļņ"
PLAIN = "aceeisuuzaaaaaaaaccdeeeeeeiiiiillnnnooooooorrssttuuuuuuyyzzgkln"
LOCAL_MARKS = "[ąčęėįšųūžĄČĘĖĮŠŲŪŽ]"
NON_BOOK_WORDS = ("zaisl", "zaidim", "delion", "sasiuvin", "kortel", "zemelap", "rastin", "hobio", "mokyklin", "popier", "lavinam", "stalo zaid")
NON_BOOK_TITLE = (
    r"(?i)\((DVD|Blu[-\s]?ray|CD|MP3|VHS|USB|Vinyl)\)|\b(rinkinys|komplektas|set|bundle)\b"
    r"|kompaktine|audioknyga|audio kasete|garsine knyga"
)
AUTHOR_SPLIT = r"(?i),\s|;|\s&\s|\s/\s|\s+and\s+|\s+ir\s+"
COVERS = ("hardcover", "paperback", "ebook", "audiobook", "cd", "dvd", "book")
ENTITIES = {"&nbsp;": " ", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&lt;": "<", "&gt;": ">", "&amp;": "&"}


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once a row, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def fold_ascii(value: Column) -> Column:
    """Lower case without combining marks or the marks of precomposed Latin letters."""
    return F.regexp_replace(F.translate(F.lower(value), MARKED, PLAIN), r"\p{Mn}", "")


def tokenize(value: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(fold_ascii(F.coalesce(value, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


def slug_from_url(url: Column) -> Column:
    return F.substring_index(F.rtrim(url, F.lit("/")), "/", -1)


def slug_mismatch(slug: Column, title: Column) -> Column:
    """No word in common, also trying the slug's words without trailing digits; never for empty sides."""
    s, t = tokenize(slug), tokenize(title)
    more = F.transform(F.filter(s, lambda w: w.rlike("^[a-z]{2,}[0-9]+$")), lambda w: F.regexp_replace(w, "[0-9]+$", ""))
    return F.coalesce((F.size(s) > 0) & (F.size(t) > 0) & ~F.arrays_overlap(F.concat(s, more), t), F.lit(False))


def diacritic_loss(slug: Column, title: Column) -> Column:
    """Whether neighbouring pieces of the slug spell a word of the title that a marked letter cut apart."""
    marked = F.filter(F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(r"\p{L}+"), F.lit(0)), lambda w: w.rlike(LOCAL_MARKS))
    targets = F.filter(F.transform(marked, fold_ascii), lambda w: F.length(w) >= 4)
    clean = F.regexp_replace(F.trim(F.lower(F.coalesce(slug, F.lit(""))), F.lit("/")), "-[0-9]+$", "")
    pieces = F.filter(F.split(clean, "-"), lambda p: p.rlike(r"^\p{L}+$"))
    places = F.sequence(F.lit(1), F.greatest(F.size(pieces), F.lit(1)))
    spells = lambda w: F.exists(places, lambda i: F.exists(places, lambda j: (j > i) & (F.array_join(F.slice(pieces, i, F.greatest(j - i + 1, F.lit(1))), "") == w)))
    found = F.exists(targets, lambda w: ~F.array_contains(pieces, w) & spells(w))
    cut = F.coalesce(title, F.lit("")).rlike(r"(?:…|\.\.\.)\s*$")
    return F.when(cut | (F.size(pieces) < 2), F.lit(False)).otherwise(found)


def non_book_title(title: Column) -> Column:
    return F.coalesce(title.rlike(NON_BOOK_TITLE), F.lit(False))


def non_book_categories(categories: Column) -> Column:
    """Any keyword of non-book goods in an array of category names."""
    return F.coalesce(fold_ascii(F.array_join(categories, " | ")).rlike("|".join(NON_BOOK_WORDS)), F.lit(False))


def plain_text(value: Column) -> Column:
    """Common references decoded, lower case, white space collapsed."""
    for name, char in ENTITIES.items():
        value = F.replace(value, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(F.lower(value), r"[\s ]+", " "))


def cover_format(cover: Column) -> Column:
    """The first comma-separated part that names a binding; dimensions name none."""

    def one(part: Column) -> Column:
        low = F.lower(F.trim(part))
        bare = fold_ascii(low)
        size = low.rlike(r"^\s*\d+\s*[xX×]\s*\d+(\s*(mm|cm))?\s*$")
        return (
            F.when((low == "") | size, F.lit(None).cast("string"))
            .when(low.isin(*COVERS), low)
            .when(bare.rlike(r"puskie|kiet|\bketi\b"), "hardcover")
            .when(bare.contains("minkst"), "paperback")
        )

    return F.get(F.filter(F.transform(F.split(cover, ","), one), lambda f: f.isNotNull()), F.lit(0))


def split_authors(raw: Column) -> Column:
    parts = F.filter(F.transform(F.split(raw, AUTHOR_SPLIT), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.coalesce(F.trim(raw), F.lit("")) == "", F.array().cast("array<string>")).when(F.size(parts) > 0, parts).otherwise(F.array(F.trim(raw)))


def author_key(name: Column) -> Column:
    """The key of a source's author: lower case, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(F.trim(name)), r"\s+", " "))


def canonical_author_key(name: Column) -> Column:
    return F.trim(F.replace(F.lower(name), F.lit(","), F.lit("")))


def is_decimal(value: Column) -> Column:
    return F.trim(value).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")


def price_text_cents(value: Column) -> Column:
    """Cents of a price in text such as ``1 234,50 €``; null without a number."""
    number = F.regexp_extract(F.translate(value, "  ", ""), r"([0-9]+(?:[.,][0-9]{1,2})?)", 1)
    return F.when(number != "", F.round(F.replace(number, F.lit(","), F.lit(".")).try_cast("decimal(12,2)") * 100).cast("long"))


def year_of(value: Column) -> Column:
    """A plausible year at the start of the text, else the first 18xx, 19xx or 20xx in it."""
    head = F.regexp_extract(value, r"^\s*([0-9]{4})", 1).try_cast("int")
    inside = F.regexp_extract(value, r"(?<![0-9])(1[89][0-9]{2}|20[0-9]{2})(?![0-9])", 1).try_cast("int")
    return F.when(head.between(1500, 2100), head).otherwise(inside)


def pages_of(value: Column) -> Column:
    return F.regexp_extract(value, r"([0-9]+)\s*(?:p\b|psl|pages|s\b)", 1).try_cast("int")


def minutes_of(value: Column) -> Column:
    """Minutes of a duration such as ``2 h 05 min`` or ``1:30:00``."""
    part = lambda p: F.coalesce(F.regexp_extract(value, p, 1).try_cast("int"), F.lit(0))
    clock = value.rlike(r"^\s*[0-9]+:[0-9]{2}")
    return F.when(clock, part(r"^\s*([0-9]+):") * 60 + part(r"^\s*[0-9]+:([0-9]{2})")).when(
        value.rlike(r"[0-9]+\s*(h|val|min)"), part(r"([0-9]+)\s*(?:h|val)") * 60 + part(r"([0-9]+)\s*min")
    )


def typed_text(value: Column, kind: str) -> Column:
    """An attribute value as text by its source type: True/False, floats with a decimal point, arrays as JSON."""
    if kind == "boolean":
        return F.when(value, "True").when(~value, "False")
    if kind == "double":
        text = value.cast("string")
        return F.when(F.isnan(value), "nan").when(text == "Infinity", "inf").when(text == "-Infinity", "-inf").otherwise(text)
    return F.to_json(value) if kind == "array" else value.cast("string")
