"""Linking listings of many sources to canonical works by ISBN, and making works for unowned ISBNs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.isbn import normalize

DEFAULT_TRUST = 50


def isbn_match(listings: DataFrame, isbns: DataFrame) -> DataFrame:
    """Link unlinked listings whose normalised ISBN a work owns; an ISBN has one owner, so rows do not multiply."""
    owner = isbns.groupBy(F.col("isbn").alias("_isbn")).agg(F.min("book_id").alias("_book"))
    key = F.when(F.col("book_id").isNull(), F.nullif(normalize(F.col("isbn")), F.lit("")))
    key = F.coalesce(key, F.concat(F.lit("no isbn "), F.col("id").cast("string")))  # null keys would all meet in one task
    joined = listings.withColumn("_isbn", key).join(owner, "_isbn", "left").drop("_isbn")
    hit = F.col("_book").isNotNull()
    return (
        joined.withColumn("match_status", F.when(hit, "matched").otherwise(F.col("match_status")))
        .withColumn("match_method", F.when(hit, "isbn"))
        .withColumn("book_id", F.coalesce("book_id", "_book"))
        .drop("_book")
    )


def author_backfill(listing_authors: DataFrame, book_authors: DataFrame, listings: DataFrame) -> DataFrame:
    """Canonical author of each source-side author: the smallest one at the same place of a linked work, if still null.

    ``listing_authors`` has shop_book_id, position, author_id, canonical_id.
    """
    linked = listings.where("book_id is not null").select(F.col("id").alias("shop_book_id"), "book_id")
    wrote = book_authors.where("role = 'author'").select("book_id", "position", F.col("author_id").alias("_canon"))
    found = listing_authors.join(linked, "shop_book_id").join(wrote, ["book_id", "position"]).groupBy("author_id").agg(F.min("_canon").alias("_canon"))
    return listing_authors.join(found, "author_id", "left").withColumn("canonical_id", F.coalesce("canonical_id", "_canon")).drop("_canon")


def isbn_gaps(listings: DataFrame, isbns: DataFrame) -> DataFrame:
    """Normalised ISBNs that no work owns."""
    own = listings.select(F.nullif(normalize(F.col("isbn")), F.lit("")).alias("isbn")).where("isbn is not null").distinct()
    return own.join(isbns.select("isbn"), "isbn", "left_anti")


def trust(shops: DataFrame) -> DataFrame:
    return shops.select(F.col("id").alias("shop_id"), F.coalesce("trust", F.lit(DEFAULT_TRUST)).alias("trust"))


def synthesise(listings: DataFrame, isbns: DataFrame, shops: DataFrame) -> DataFrame:
    """A work per unowned ISBN: fields of the most trusted source (smallest id on ties), the publisher of the earliest
    listing that names one.

    Listings are read once and reduced to a row an ISBN before that meets the owned ones; those without an ISBN go no further.
    """
    own = F.nullif(normalize(F.col("isbn")), F.lit(""))
    rows = listings.select("id", "shop_id", "title", "author", "year", "publisher", "first_seen_at", own.alias("isbn")).where("isbn is not null").join(trust(shops), "shop_id")
    earliest = F.struct(F.col("first_seen_at").isNull().alias("n"), "first_seen_at", "id")
    best = rows.groupBy("isbn").agg(
        F.min_by(F.struct("title", "author", "year", "shop_id"), F.struct((-F.col("trust")).alias("t"), "id")).alias("_top"),
        F.min_by("publisher", F.when(F.col("publisher").isNotNull(), earliest)).alias("publisher"),
    )
    kind = F.when(F.length("isbn") == 10, "isbn10").otherwise("isbn13")
    return best.join(isbns.select("isbn"), "isbn", "left_anti").select("isbn", "_top.*", "publisher", kind.alias("isbn_type"), F.lit("shop_inferred").alias("data_source"))


@dataclass
class Matching:
    """Listings with their works, works made for unowned ISBNs, source-side authors, and one row of counts."""

    listings: DataFrame
    works: DataFrame
    authors: DataFrame | None
    counts: DataFrame


def run_matching(
    listings: DataFrame, isbns: DataFrame, shops: DataFrame, first_id: int, listing_authors: DataFrame | None = None, book_authors: DataFrame | None = None, synthesis: bool = True
) -> Matching:
    """ISBN match, author backfill of the listings linked so far and, with ``synthesis``, works for what is left and the match again.

    Ids of new works come from a hash of the ISBN, from ``first_id`` up, so they do not depend on a global order.
    ``counts`` has books_linked, authors_linked and books_synthesised.
    """
    once = isbn_match(listings, isbns)
    authors = None if listing_authors is None else author_backfill(listing_authors, book_authors, once)
    works = synthesise(once, isbns, shops).withColumn("id", F.lit(first_id).cast("long") + F.pmod(F.xxhash64("isbn"), F.lit(1 << 52)))
    works = works if synthesis else works.where(F.lit(False))
    more = isbns.select("book_id", "isbn").union(works.select(F.col("id").alias("book_id"), "isbn"))
    twice = isbn_match(once.withColumnRenamed("match_method", "_first"), more).withColumn("match_method", F.coalesce("_first", "match_method")).drop("_first")
    counts = twice.agg(F.count("match_method").alias("books_linked")).join(works.agg(F.count("*").alias("books_synthesised")))
    if authors is not None:
        was = listing_authors.where("canonical_id is not null").select("author_id")
        new = authors.where("canonical_id is not null").select("author_id").join(was, "author_id", "left_anti").distinct()
        counts = counts.join(new.agg(F.count("*").alias("authors_linked")))
    return Matching(twice, works, authors, counts)


def match_keys(df: DataFrame, owner: bool) -> DataFrame:
    """Rows exploded to the keys on which a 10- and a 13-digit number agree.

    A number meets its equal, or the other length by the nine significant digits; two 13-digit numbers of
    different prefixes never meet.
    """
    body = F.when(F.length("isbn") == 13, F.substring("isbn", 4, 9)).otherwise(F.substring("isbn", 1, 9))
    thirteen, ten = ("X10:", "X13:") if owner else ("X13:", "X10:")
    cross = F.when(F.length("isbn") == 13, F.concat(F.lit(thirteen), body)).when(F.length("isbn") == 10, F.concat(F.lit(ten), body))
    keys = F.filter(F.array(F.concat(F.lit("R:"), F.col("isbn")), cross), lambda k: k.isNotNull())
    return df.withColumn("_key", F.explode(keys))


def drifted_pairs(listings: DataFrame, isbns: DataFrame) -> DataFrame:
    """(book_id, isbn) of linked listings, each once, where the ISBN is none of the work's, in either length; works without
    ISBNs drift from nothing."""
    pairs = listings.where("book_id is not null and isbn is not null").select("book_id", "isbn").distinct()
    owned = match_keys(isbns.select("book_id", "isbn"), owner=True).select("book_id", "_key")
    same = match_keys(pairs, owner=False).join(owned, ["book_id", "_key"], "left_semi").select("book_id", "isbn")
    return pairs.join(same, ["book_id", "isbn"], "left_anti").join(isbns.select("book_id"), "book_id", "left_semi")


def isbn_drift(listings: DataFrame, isbns: DataFrame) -> DataFrame:
    """Linked listings whose ISBN has drifted from their work's; listings of one id are judged apart."""
    return listings.join(drifted_pairs(listings, isbns), ["book_id", "isbn"], "left_semi")


def top_isbn(isbns: DataFrame) -> DataFrame:
    """A work's ISBN of the latest type in declared order."""
    order = F.expr("case isbn_type when 'isbn10' then 0 when 'isbn13' then 1 when 'ebook' then 2 when 'audio' then 3 else 4 end")
    return isbns.groupBy("book_id").agg(F.max_by("isbn", F.struct(order, "isbn")).alias("top_isbn"))


def unlink(listings: DataFrame, ids: DataFrame) -> DataFrame:
    """Listings named in ``ids`` lose their work."""
    gone = ids.select("id").distinct().withColumn("_gone", F.lit(True))
    out = listings.join(gone, "id", "left")
    return out.withColumn("book_id", F.when(F.col("_gone").isNull(), F.col("book_id"))).withColumn(
        "match_status", F.when(F.col("_gone").isNull(), F.col("match_status")).otherwise("unmatched")
    ).drop("_gone")
