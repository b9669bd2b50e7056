"""Ingest of parsed records: gate and rewrite, upsert with change capture, URL state, canonical works, item folds.

A batch is reduced to one row per key before it is merged, so a change log is per batch. ``now`` and ``run`` are given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import isbn as isbns_
from ..functions import text
from ..sources.tables import merge

MIN_YEAR, MAX_YEAR = 1800, 2030
TAG = r"<[a-zA-Z/][^>]*>"
TRACKED = ("url", "title", "author", "sku", "isbn", "publisher", "year", "format", "description")


def split_properties(df: DataFrame, typed: list[str], raw: str = "raw", properties: str = "properties") -> DataFrame:
    """A raw map into typed columns and a map of the rest; explicit properties win over top-level entries."""
    rest = F.map_filter(raw, lambda k, v: ~k.isin(*typed))
    held = F.coalesce(properties, F.create_map().cast("map<string,string>"))
    own = F.map_filter(rest, lambda k, v: ~F.map_contains_key(held, k))
    return df.select("*", *[F.col(raw)[c].alias(c) for c in typed], F.map_concat(own, held).alias("_props")).drop(raw, properties).withColumnRenamed("_props", properties)


def _issue(name: str, field: str, raw: Column | None = None) -> Column:
    value = F.lit(None).cast("string") if raw is None else raw.cast("string")
    return F.struct(F.lit(name).alias("issue"), F.lit(field).alias("field"), value.alias("raw_value"))


def validate_items(df: DataFrame, allowed: list[str] | None = None, enums: dict[str, list[str]] | None = None, patterns: dict[str, str] | None = None) -> DataFrame:
    """Gate and rewrite of items: price, original price, title, author, publisher, year, pages, isbn, url (all text).

    Returns the items with typed values, ``reject`` (null if admitted) and ``findings``. Checks run in a fixed
    order and stop at the first rejection: unreadable price, missing title, URL that is not http(s). A bad
    original price, year or ISBN becomes null; a year out of range swaps with the pages if they are in range.
    Attributes are held against the allowed keys, value lists and full-match patterns.
    """
    price, orig = F.trim("price"), F.trim("price_original")
    sold_out = F.coalesce(~F.col("in_stock"), F.lit(False))
    no_title = F.coalesce(F.col("title"), F.lit("")) == ""
    in_range = lambda c: F.coalesce(c.between(MIN_YEAR, MAX_YEAR), F.lit(False))
    # emptied text becomes null
    tidy = lambda c: F.nullif(F.trim(c), F.lit(""))
    # what several checks read is a column first, so that it is worked out once a row
    parsed = df.withColumns({
        "_bad_price": F.col("price").isNotNull() & ~text.is_decimal(F.col("price")), "_bad_orig": F.col("price_original").isNotNull() & ~text.is_decimal(F.col("price_original")),
        "_bad_url": ~F.coalesce(F.col("url").rlike("^https?://"), F.lit(False)), "_good_isbn": isbns_.is_valid(F.col("isbn")), "_title": tidy("title"), "_author": tidy("author"),
        "_year": F.when(F.col("year").rlike(r"^\s*[+-]?[0-9]+(\.[0-9]*)?\s*$"), F.trim("year").try_cast("double").cast("int")),
        "_pages": F.when(F.col("properties")["pages"].isNotNull(), F.col("properties")["pages"]).otherwise(F.col("pages")).try_cast("int"),
    })
    year, pages, bad_price, bad_orig, bad_url, good_isbn = (F.col(f"_{c}") for c in ("year", "pages", "bad_price", "bad_orig", "bad_url", "good_isbn"))
    parsed = parsed.withColumns({"_p": price.try_cast("double"), "_o": F.when(~bad_orig, orig.try_cast("double")), "_swap": F.col("year").isNotNull() & year.isNotNull() & ~in_range(year) & in_range(pages)})
    p, o, swap = (F.col(c) for c in ("_p", "_o", "_swap"))
    parsed = parsed.withColumn("_new_year", F.when(in_range(year), year).when(swap, pages))
    new_year, title, author = (F.col(c) for c in ("_new_year", "_title", "_author"))
    size = F.length(title)
    first = F.filter(
        F.array(
            F.when(bad_price, _issue("invalid_price", "price", F.col("price"))),
        ),
        lambda i: i.isNotNull(),
    )
    second = F.array(
        F.when(bad_orig, _issue("invalid_price_original", "price_original", F.col("price_original"))),
        F.when(F.col("price").isNull() & ~sold_out, _issue("missing_price", "price")),
        F.when((p == 0) & ~sold_out, _issue("zero_price", "price", price)),
        F.when((o > 0) & (p > o), _issue("price_higher_than_original", "price", F.concat(price, F.lit(">"), orig))),
        F.when(no_title, _issue("missing_title", "title")),
    )
    third = F.array(
        F.when(F.col("year").isNotNull() & new_year.isNull(), _issue("invalid_year", "year", F.col("year"))),
        F.when(swap, _issue("year_pages_swap", "year", F.col("year"))),
        F.when(F.col("isbn").isNotNull() & ~good_isbn, _issue("invalid_isbn", "isbn", F.col("isbn"))),
        F.when(bad_url, _issue("invalid_url", "url", F.col("url"))),
    )
    paged, spoken = F.map_contains_key("properties", F.lit("pages")), F.map_contains_key("properties", F.lit("duration"))
    fourth = F.array(
        F.when(title.rlike(TAG), _issue("html_in_text", "title", F.substring(title, 1, 100))),
        F.when(author.rlike(TAG), _issue("html_in_text", "author", F.substring(author, 1, 100))),
        F.when(size < 2, _issue("suspicious_title", "title", title)),
        F.when(size > 300, _issue("suspicious_title", "title", F.concat(F.lit("len="), size.cast("string")))),
        F.when((F.col("format") == "audiobook") & paged, _issue("format_mismatch", "format", F.lit("audiobook with pages"))),
        F.when(F.col("format").isin("book", "hardcover", "paperback") & spoken, _issue("format_mismatch", "format", F.concat(F.col("format"), F.lit(" with duration")))),
    )
    attributes = F.array().cast("array<struct<issue:string,field:string,raw_value:string>>")
    if allowed is not None:
        attributes = F.flatten(F.transform(F.map_entries("properties"), lambda e: _attribute(e, allowed, enums or {}, patterns or {})))
    keep = lambda a: F.filter(a, lambda i: i.isNotNull())
    title_ok, url_ok = ~no_title, ~no_title & ~bad_url
    none = F.array().cast("array<struct<issue:string,field:string,raw_value:string>>")
    found = F.concat(
        first, F.when(bad_price, none).otherwise(keep(second)), F.when(~bad_price & title_ok, keep(third)).otherwise(none),
        F.when(~bad_price & url_ok, F.concat(keep(fourth), keep(attributes))).otherwise(none),
    )
    reject = F.when(bad_price, F.concat(F.lit("Invalid price: "), F.col("price"))).when(no_title, "Missing title").when(bad_url, F.concat(F.lit("Invalid URL: "), F.coalesce("url", F.lit(""))))
    swapped = F.when(swap & F.col("properties")["pages"].isNotNull(), F.map_concat(F.map_filter("properties", lambda k, v: k != "pages"), F.create_map(F.lit("pages"), year.cast("string"))))
    rest = [c for c in df.columns if c not in ("price", "price_original", "title", "author", "publisher", "year", "pages", "isbn", "properties")]
    return parsed.select(
        *rest,
        F.when(~bad_price, price).try_cast("decimal(10,2)").alias("price"), F.when(~bad_orig, orig).try_cast("decimal(10,2)").alias("price_original"),
        title.alias("title"), author.alias("author"), tidy("publisher").alias("publisher"), new_year.alias("year"),
        F.when(swap & F.col("properties")["pages"].isNull(), year).otherwise(F.col("pages").try_cast("int")).alias("pages"),
        F.when(good_isbn, isbns_.normalize(F.col("isbn"))).alias("isbn"), F.coalesce(swapped, F.col("properties")).alias("properties"),
        reject.alias("reject"), found.alias("findings"),
    )


def _attribute(entry: Column, allowed: list[str], enums: dict[str, list[str]], patterns: dict[str, str]) -> Column:
    key, value = entry["key"], entry["value"]
    named = lambda name, raw: F.struct(F.lit(name).alias("issue"), F.when(F.lit(name) == "attribute_unknown_key", F.lit("properties")).otherwise(key).alias("field"), raw.alias("raw_value"))
    unknown = ~key.isin(*allowed)
    wrong = [F.when(unknown, named("attribute_unknown_key", F.concat(key, F.lit("="), F.coalesce(value, F.lit("null")))))]
    for k, options in enums.items():
        wrong.append(F.when(~unknown & (key == k) & ~value.isin(*options), named("attribute_invalid_value", F.concat(F.lit("not in enum: "), value))))
    for k, pattern in patterns.items():
        wrong.append(F.when(~unknown & (key == k) & ~value.rlike(f"^(?:{pattern})$"), named("attribute_invalid_value", F.concat(F.lit("pattern mismatch: "), value))))
    return F.array(*wrong)


def fold_batch(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key: the last non-null value of every column in order of arrival."""
    rest = [c for c in df.columns if c not in (*keys, order)]
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in rest]
    return df.groupBy(*keys).agg(*last)


def locate(batch: DataFrame, listings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(batch with ``id`` of its listing or null, ids whose SKU moves away): by SKU within the source, else by URL.

    If the SKU's and the URL's owner differ, the URL's owner takes the row and the other loses its SKU.
    """
    by_sku = listings.where("sku is not null").select("shop_id", "sku", F.col("id").alias("_sku_id"))
    by_url = listings.select("shop_id", "url", F.col("id").alias("_url_id"))
    found = batch.join(by_sku, ["shop_id", "sku"], "left").join(by_url, ["shop_id", "url"], "left")
    detached = found.where("_sku_id is not null and _url_id is not null and _sku_id <> _url_id").select(F.col("_sku_id").alias("id")).distinct()
    return found.withColumn("id", F.coalesce("_url_id", "_sku_id")).drop("_sku_id", "_url_id"), detached


def upsert_listings(target: DataFrame, batch: DataFrame, now: Column, run: Column) -> DataFrame:
    """Listings after a batch of one row per (shop_id, url): nulls never clobber, URL and title always overwrite.

    Seen rows become active; in_stock defaults to true. ``created`` tells new rows; ids come from the key's hash.
    """
    stocked = F.coalesce("in_stock", F.lit(True)) if "in_stock" in batch.columns else F.lit(True)
    seen = batch.withColumn("is_active", F.lit(True)).withColumn("in_stock", stocked).withColumn("last_seen_at", now).withColumn("last_run_id", run)
    seen = seen.withColumn("first_seen_at", now).withColumn("id", F.xxhash64("shop_id", "url")).withColumn("match_status", F.lit("unmatched"))
    columns = [c for c in seen.columns if c in target.columns]
    return merge(target, seen.select(*columns), ["shop_id", "url"], overwrite=["title", "is_active", "in_stock", "last_seen_at", "last_run_id"], keep=["id", "first_seen_at", "match_status"])


def diff(old: DataFrame, new: DataFrame, now: Column, run: Column, key: str = "id", fields: tuple[str, ...] = TRACKED, scope: tuple[str, ...] = ()) -> DataFrame:
    """Field-level changes of rows on both sides: null to value and back are changes. ``scope`` names the columns within which the key is unique."""
    had = old.select(key, *scope, *[F.col(f).cast("string").alias(f"_o_{f}") for f in fields])
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_o_{f}").alias("old_value"), F.col(f).cast("string").alias("new_value")) for f in fields])
    moved = F.filter(each, lambda c: ~c["old_value"].eqNullSafe(c["new_value"]))
    return new.join(had, [key, *scope]).select(F.col(key).alias("shop_book_id"), F.inline(moved)).withColumn("changed_at", now).withColumn("run_id", run)


def field_updates(table: DataFrame, changes: DataFrame) -> DataFrame:
    """Last change of every (listing, field)."""
    return table.unionByName(changes.select("shop_book_id", "field", F.col("changed_at").alias("updated_at"))).groupBy("shop_book_id", "field").agg(F.max("updated_at").alias("updated_at"))


def guard_drift(listings: DataFrame, isbns: DataFrame) -> DataFrame:
    """A linked listing whose ISBN its work does not own is unlinked."""
    owned = isbns.select("book_id", "isbn", F.lit(True).alias("_own")).distinct()
    out = listings.join(owned, ["book_id", "isbn"], "left")
    lost = F.col("book_id").isNotNull() & F.col("isbn").isNotNull() & F.col("_own").isNull()
    return out.withColumn("match_status", F.when(lost, "unmatched").otherwise(F.col("match_status"))).withColumn("book_id", F.when(~lost, F.col("book_id"))).drop("_own")


def price_rows(batch: DataFrame, now: Column, run: Column) -> DataFrame:
    """An observation for every row with a price, changed or not."""
    from ..functions.present import discount_percent

    kept = batch.where("price is not null").withColumn("discount_pct", discount_percent(F.col("price"), F.col("price_original")))
    return kept.select(F.col("id").alias("shop_book_id"), "price", "price_original", "discount_pct", "in_stock", run.alias("run_id"), now.alias("observed_at"))


def merge_attributes(table: DataFrame, batch: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Attributes upserted by key; absent keys stay. ``scope`` names the columns within which a listing's id is unique."""
    keys = [*scope, "shop_book_id", "key"]
    new = batch.select(*scope, F.col("id").alias("shop_book_id"), F.explode("properties")).groupBy(*keys).agg(F.max("value").alias("value"))
    return merge(table, new, keys, overwrite=["value"]).drop("created")


def sync_authors(batch: DataFrame, authors: DataFrame, bridge: DataFrame, scope: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(authors, bridge) after a batch (id, author): names found or made by key, the bridge of touched listings replaced.

    ``scope`` names the columns within which a listing's id is unique.
    """
    own = [*scope, "shop_book_id"]
    listed = batch.select(*scope, F.col("id").alias("shop_book_id"), F.posexplode_outer(text.split_authors(F.col("author"))).alias("p", "name"))
    named = listed.where("name is not null").withColumn("normalized_name", text.author_key(F.col("name"))).where("normalized_name <> ''")
    made = named.groupBy("normalized_name").agg(F.min("name").alias("name")).join(authors.select("normalized_name"), "normalized_name", "left_anti")
    all_authors = authors.unionByName(made.withColumn("id", F.xxhash64("normalized_name")).select("id", "name", "normalized_name"))
    first = named.groupBy(*own, "normalized_name").agg(F.min("p").alias("p")).join(all_authors.select(F.col("id").alias("author_id"), "normalized_name"), "normalized_name")
    place = F.row_number().over(Window.partitionBy(*own).orderBy("p")) - 1
    new = first.select(*own, "author_id", place.alias("position"))
    kept = bridge.join(batch.select(*scope, F.col("id").alias("shop_book_id")), own, "left_anti")
    return all_authors, kept.unionByName(new)


def link_urls(urls: DataFrame, linked: DataFrame) -> DataFrame:
    """URL types after listings were stored: ``linked`` (shop_id, normalized_url, complete).

    unknown, unreachable and partial rise to product when complete, else to partial; nothing is demoted, and
    failures are reset.
    """
    hit = linked.groupBy("shop_id", "normalized_url").agg(F.bool_or("complete").alias("_c"))
    out = urls.join(hit, ["shop_id", "normalized_url"], "left")
    rises = F.col("_c").isNotNull() & F.col("type").isin("unknown", "unreachable", "partial")
    state = F.when(rises & F.col("_c"), "product").when(rises, "partial").otherwise(F.col("type"))
    return out.withColumn("type", state).withColumn("fail_count", F.when(F.col("_c").isNotNull(), 0).otherwise(F.col("fail_count"))).drop("_c")


def mark_non_product(urls: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Judged URLs become non-product unless they are products, and count as checked without failures.

    Columns ``last_http_status``, ``last_checked_at`` and ``last_seen_at`` are set where ``urls`` and ``verdicts`` (at) have them.
    """
    moment = F.max("at").alias("_at") if "at" in verdicts.columns else F.lit(None).cast("timestamp").alias("_at")
    hit = verdicts.groupBy("shop_id", "normalized_url").agg(F.lit(True).alias("_hit"), moment)
    out = urls.join(hit, ["shop_id", "normalized_url"], "left").withColumn("type", F.when(F.col("_hit") & (F.col("type") != "product"), "non_product").otherwise(F.col("type")))
    for column, value in (("fail_count", F.lit(0)), ("last_http_status", F.lit(200)), ("last_checked_at", F.col("_at")), ("last_seen_at", F.col("_at"))):
        if column in urls.columns:
            out = out.withColumn(column, F.when(F.col("_hit") & value.isNotNull(), value).otherwise(F.col(column)).cast(urls.schema[column].dataType))
    return out.drop("_hit", "_at")


def classifications(urls: DataFrame, verdicts: DataFrame) -> DataFrame:
    """What is stored with the verdicts (shop_id, normalized_url, score, reasons, at), the latest of a URL: one row a known URL.

    ``reasons`` is an array of structs (key, points), stored as JSON.
    """
    last = verdicts.groupBy("shop_id", "normalized_url").agg(F.max_by(F.struct("score", "reasons", "at"), F.struct("at", "score")).alias("v"))
    known = urls.select(F.col("id").alias("discovered_url_id"), "shop_id", "normalized_url").join(last, ["shop_id", "normalized_url"])
    return known.select("discovered_url_id", F.col("v.score").alias("book_score"), F.lit(False).alias("is_book_product"), F.to_json("v.reasons").alias("reasons"), F.col("v.at").alias("classified_at"))


def record_failures(urls: DataFrame, failures: DataFrame, limit: int = 3) -> tuple[DataFrame, DataFrame]:
    """(urls, ids of listings to deactivate): failures add up; at ``limit`` a URL is unreachable, unless non-product."""
    n = failures.groupBy("shop_id", "normalized_url").agg(F.count("*").alias("_n"))
    out = urls.join(n, ["shop_id", "normalized_url"], "left").withColumn("fail_count", (F.col("fail_count") + F.coalesce("_n", F.lit(0))).cast("int"))
    dead = F.col("_n").isNotNull() & (F.col("fail_count") >= limit) & (F.col("type") != "non_product")
    lost = out.where(dead).where("shop_book_id is not null").select(F.col("shop_book_id").alias("id")).distinct()
    return out.withColumn("type", F.when(dead, "unreachable").otherwise(F.col("type"))).drop("_n"), lost


def upsert_works(works: DataFrame, isbns: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(works, isbns) after library records (libis_code, title, year, publisher, isbns).

    A record finds its work by any of its ISBNs in either length, else by its library code, else it is new.
    Records of one work apply in order of their codes: non-null fields overwrite, the publisher only fills, so its first
    one stands. Inferred works become library works, and ownership of the record's ISBNs moves to it, in both lengths.
    """
    forms = lambda i: F.filter(F.array(isbns_.normalize(i), isbns_.to_isbn13(i), isbns_.to_isbn10(i)), lambda x: x.isNotNull() & (x != ""))
    own = records.select("libis_code", F.explode("isbns").alias("_i")).select("libis_code", F.explode(F.array_distinct(forms(F.col("_i")))).alias("isbn")).distinct()
    by_isbn = own.join(isbns.select("isbn", "book_id"), "isbn").groupBy("libis_code").agg(F.min("book_id").alias("_a"))
    by_code = works.where("libis_code is not null").select("libis_code", F.col("id").alias("_b"))
    keyed = records.join(by_isbn, "libis_code", "left").join(by_code, "libis_code", "left")
    keyed = keyed.withColumn("id", F.coalesce("_a", "_b", F.xxhash64("libis_code"))).drop("_a", "_b")
    said = lambda c: F.when(F.col(c).isNotNull(), F.col("libis_code"))
    last = [F.max_by(c, said(c)).alias(c) for c in ("libis_code", "title", "year")]
    one = keyed.groupBy("id").agg(*last, F.min_by("publisher", said("publisher")).alias("publisher")).withColumn("data_source", F.lit("library"))
    after = merge(works, one, ["id"], keep=["publisher"]).drop("created")
    moved = own.join(keyed.select("libis_code", F.col("id").alias("book_id")), "libis_code").groupBy("isbn").agg(F.min("book_id").alias("book_id"))
    moved = moved.withColumn("isbn_type", F.when(F.length("isbn") == 10, "isbn10").otherwise("isbn13"))
    return after, merge(isbns, moved, ["isbn"], overwrite=["book_id"], keep=["isbn_type"]).drop("created")


def merge_authors(authors: DataFrame, named: DataFrame) -> DataFrame:
    """Canonical authors after (name, code): by library code, else by key; a missing code is filled."""
    keyed = named.withColumn("normalized_name", text.canonical_author_key(F.col("name"))).groupBy("normalized_name").agg(F.min("name").alias("name"), F.max("code").alias("code"))
    by_code = authors.where("code is not null").select("code", F.col("normalized_name").alias("_n"))
    keyed = keyed.join(by_code, "code", "left").withColumn("normalized_name", F.coalesce("_n", "normalized_name")).drop("_n")
    keyed = keyed.groupBy("normalized_name").agg(F.min("name").alias("name"), F.max("code").alias("code"))
    out = merge(authors, keyed, ["normalized_name"], keep=["name", "code"]).drop("created")
    return out.withColumn("id", F.coalesce("id", F.xxhash64("normalized_name")))


def find_or_create(dim: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    new = names.select(name).where(F.col(name).isNotNull()).distinct().join(dim.select(name), name, "left_anti")
    return dim.unionByName(new.withColumn("id", F.xxhash64(name)).select(*dim.columns))


def add_works(requests: DataFrame, isbns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): new works whose ISBN, in either length, nobody owns; of requests for one ISBN the first wins."""
    keys = requests.withColumn("isbn13", isbns_.to_isbn13(F.col("isbn")))
    owned = isbns.select(isbns_.to_isbn13(F.col("isbn")).alias("isbn13")).where("isbn13 is not null").distinct().withColumn("_own", F.lit(True))
    first = F.row_number().over(Window.partitionBy(F.coalesce("isbn13", F.concat(F.lit("r:"), F.col("id").cast("string")))).orderBy("id"))
    judged = keys.join(owned, "isbn13", "left").withColumn("_ok", F.col("_own").isNull() & (first == 1))
    return judged.where("_ok").drop("_own", "_ok"), judged.where("not _ok").drop("_own", "_ok")


def fold_items(events: DataFrame) -> DataFrame:
    """The state of work items (run_id, url) from their events (kind, at, reason): enqueue, claim, done, failed, aborted.

    The earliest final event wins: a late response never reopens an item.
    """
    final = F.col("kind").isin("done", "failed", "aborted")
    out = events.groupBy("run_id", "url").agg(
        F.min_by(F.struct("kind", "reason"), F.when(final, F.struct("at", "kind"))).alias("_f"), F.max(F.when(F.col("kind") == "claim", F.col("at"))).alias("claimed_at"),
        F.min(F.when(final, F.col("at"))).alias("finished_at"), F.count_if(F.col("kind") == "claim").alias("attempts"), F.count_if(F.col("kind") == "retry").alias("retry_count"),
    )
    status = F.when(F.col("_f").isNotNull(), F.col("_f.kind")).when(F.col("claimed_at").isNotNull(), "processing").otherwise("pending")
    return out.select("run_id", "url", status.alias("status"), F.col("_f.reason").alias("reason"), "attempts", "retry_count", "finished_at")


def retry_items(items: DataFrame, latest: DataFrame, reason: str | None, http_status: int | None) -> DataFrame:
    """Failed items whose latest failure has this reason and status, null being a value, reset for another try."""
    hit = latest.where(F.col("error_reason").eqNullSafe(F.lit(reason)) & F.col("http_status").eqNullSafe(F.lit(http_status))).select("run_id", "item_id")
    return items.where("status = 'failed'").join(hit, ["run_id", "item_id"], "left_semi").withColumn("status", F.lit("pending"))


def retryable_items(items: DataFrame, reasons: tuple[str, ...] = ("timeout", "connection_error", "http_5xx"), attempts: int = 3) -> DataFrame:
    return items.where((F.col("status") == "failed") & (F.col("attempts") < attempts) & F.col("reason").isin(*reasons))


def kind_of() -> Column:
    return F.when(F.col("canonical"), "canonical").when(F.col("title").isNull() & F.col("price").isNull(), "url").when(~F.col("is_book"), "non_product").otherwise("book")


def route(df: DataFrame) -> DataFrame:
    """The kind of each parsed item, and where it goes."""
    return df.withColumn("kind", kind_of())


def admit_cards(cards: DataFrame, base: str, pattern: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(items, URLs) of listing cards: every URL is recorded; items need a title, a price and no rejection."""
    from ..functions.urls import absolute

    known = cards.where("coalesce(url, '') <> ''").withColumn("url", absolute(base, F.col("url")))
    known = known if pattern is None else known.where(F.col("url").rlike(pattern))
    items = known.where(~F.coalesce("rejected", F.lit(False)) & F.col("title").isNotNull() & F.col("price").isNotNull())
    return items.withColumn("in_stock", F.coalesce("in_stock", F.lit(True))), known.select("url").distinct()


def merge_urls(urls: DataFrame, seen: DataFrame, now: Column, run: Column) -> DataFrame:
    """Known URLs after a batch (shop_id, url, shop_book_id or null), by normalised URL: new ones are added as unknown,
    sight and run are refreshed, and unknown URLs that a listing stands on become products."""
    from ..functions.urls import normalize_url

    batch = seen.withColumn("normalized_url", normalize_url(F.col("url"))).groupBy("shop_id", "normalized_url").agg(F.min("url").alias("url"), F.max("shop_book_id").alias("shop_book_id"))
    batch = batch.withColumn("last_seen_at", now).withColumn("first_seen_at", now).withColumn("last_run_id", run).withColumn("type", F.lit("unknown"))
    batch = batch.withColumn("fail_count", F.lit(0)).withColumn("id", F.xxhash64("shop_id", "normalized_url"))
    columns = [c for c in batch.columns if c in urls.columns]
    out = merge(urls, batch.select(*columns), ["shop_id", "normalized_url"], overwrite=["last_seen_at", "last_run_id"], keep=["id", "url", "first_seen_at", "type", "fail_count"])
    return out.withColumn("type", F.when((F.col("type") == "unknown") & F.col("shop_book_id").isNotNull(), "product").otherwise(F.col("type")))


def apply_retries(items: DataFrame, retries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items with added retry counts, one event row per retry): retries (run_id, item_key, attempt, reason, at)."""
    n = retries.groupBy("run_id", "item_key").agg(F.count("*").alias("_n"))
    out = items.join(n, ["run_id", "item_key"], "left").withColumn("retry_count", (F.coalesce("retry_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("int")).drop("_n")
    events = retries.select("run_id", F.lit("request_retry").alias("event_type"), F.to_json(F.struct("item_key", "attempt", "reason")).alias("payload"), F.col("at").alias("created_at"))
    return out, events


def latest_failures(items: DataFrame, failures: DataFrame, reason: str | None = None) -> DataFrame:
    """Items with their latest failure; only those of a reason if one is given."""
    from .windows import latest_per_key

    last = latest_per_key(failures, ["run_id", "item_id"], [F.desc("failed_at"), F.desc("id")]).select("run_id", "item_id", "error_reason", "http_status")
    return items.join(last, ["run_id", "item_id"], "left") if reason is None else items.join(last.where(F.col("error_reason") == reason), ["run_id", "item_id"])
