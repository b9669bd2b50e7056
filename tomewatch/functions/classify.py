"""Book or not: points, reasons, blocks and the type of a parsed record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import isbn
from .text import once, plain_text

# Category names of books, words of other goods, titles of games and toys, formats by type.
BOOK_CATEGORIES = ("negrožinė literatūra", "grožinė literatūra", "knygos vaikams ir jaunimui", "knygos anglų kalba", "audioknygos")
OTHER_CATEGORIES = "žaisl|album"
TOY_TITLE = r"(?U)^stalo\s+žaidim|^kort[ųu]\s+žaidim|^edukacinis\s+žaidim|^dėlion|\bpuzzle\b|\blego\b|^žaislas\b"
AUDIO, EBOOK, BOOK = ("audiobook", "audio", "audiobookas"), ("ebook", "e-book", "eknyga", "e-knyga", "elektroninė knyga"), ("book", "hardcover", "paperback")
METADATA = ("pages", "cover_type", "year", "translator", "narrator", "duration", "format")
POINTS = {"book_categories": 3, "valid_isbn": 3, "author_present": 2, "book_metadata": 2, "game_toy_title": -3, "non_book_categories": -4}


def _filled(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")) != "", F.lit(False))


def classify(title: Column, categories: Column, isbn_: Column, author: Column, metadata: list[Column]) -> Column:
    """struct(score, is_book, primary, reasons array<struct<key, points>>) of a record."""
    names = F.transform(F.coalesce(categories, F.array().cast("array<string>")), plain_text)
    kinds = once(names, lambda n: F.struct(F.exists(n, lambda c: c.isin(*BOOK_CATEGORIES)).alias("book"), F.exists(n, lambda c: c.rlike(OTHER_CATEGORIES)).alias("other")))
    valid, writer = isbn.is_valid(isbn_), _filled(author)
    described = F.lit(False)
    for m in metadata:
        described = described | F.coalesce(m.cast("string") != "", F.lit(False))
    toy = plain_text(title).rlike(TOY_TITLE)
    none = F.struct(F.lit(0).alias("score"), F.lit(False).alias("is_book"), F.lit(False).alias("primary"), F.array(_reason("no_title", F.lit(0))).alias("reasons"))
    signs = F.struct(kinds.alias("kinds"), valid.alias("valid"), writer.alias("writer"), described.alias("described"), toy.alias("toy"))
    verdict = once(signs, lambda s: _verdict(s["kinds"]["book"], s["valid"], s["writer"], s["described"], s["toy"], s["kinds"]["other"]))
    return F.when(_filled(title), verdict).otherwise(none)


def _reason(key: str, points: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), points.cast("int").alias("points"))


def _verdict(book: Column, valid: Column, writer: Column, described: Column, toy: Column, other: Column) -> Column:
    """What the signs of a record, in the order of ``POINTS``, say."""
    fired = dict(zip(POINTS, (book, valid, writer, described, toy, other), strict=True))
    given = {k: F.when(hit, POINTS[k]).otherwise(0) for k, hit in fired.items()}
    score = sum(given.values(), F.lit(0))
    reasons = F.array(*[_reason(k, p) for k, p in given.items()])
    by_category = other & ~(book | valid | writer)
    by_title = toy & ~(book | valid | described)
    primary = (book | valid | (writer & described)) & ~by_category & ~by_title
    add = lambda key: F.concat(reasons, F.array(_reason(key, F.lit(0))))
    return F.struct(
        score.alias("score"),
        ((score >= 3) & primary).alias("is_book"),
        primary.alias("primary"),
        F.when(by_category, add("blocked_non_book_category")).when(by_title, add("blocked_game_toy_title")).otherwise(reasons).alias("reasons"),
    )


def rejects(verdict: Column, type_: Column) -> Column:
    """A card that is no book: said so, or blocked by a reason."""
    return F.coalesce(type_ == "non_book", F.lit(False)) | F.exists(verdict["reasons"], lambda r: r["key"].startswith("blocked_"))


def infer_type(format_: Column, categories: Column, verdict: Column) -> Column:
    names = F.transform(F.coalesce(categories, F.array().cast("array<string>")), plain_text)
    by_format = lambda f: F.when(f.isin(*AUDIO), "audio").when(f.isin(*EBOOK), "ebook").when(f.isin(*BOOK), "book")
    by_name = lambda n: F.when(F.exists(n, lambda c: c.rlike("audiokny")), "audio").when(F.exists(n, lambda c: c.rlike("e-knyg|eknyg|elektronin")), "ebook")
    return F.coalesce(once(plain_text(F.coalesce(format_, F.lit(""))), by_format), once(names, by_name), F.when(verdict["is_book"], "book").otherwise("non_book"))
