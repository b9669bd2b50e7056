"""Detail views: one listing's, work's or URL's rows of several tables brought together, for all of them at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.present import severity
from .filters import matches_text
from .windows import top_k_per_group

#: Checks of a URL that its history shows.
HISTORY = 20


def url_history(urls: DataFrame, items: DataFrame, runs: DataFrame, limit: int = HISTORY) -> DataFrame:
    """The last finished checks of every URL, newest run first: (url_id, k, run_id, http_status, check_state, started_at, finished_at).

    A check is an error if its status is 400 or more, or unknown. Runs that started together come by id, then by item.
    """
    done = items.where("status in ('done', 'failed')").select("shop_book_id", "run_id", "item_key", "http_status", "finished_at")
    begun = runs.select(F.col("id").alias("run_id"), "started_at")
    checked = done.join(begun, "run_id").join(urls.select(F.col("id").alias("url_id"), "shop_book_id"), "shop_book_id")
    last = top_k_per_group(checked, ["url_id"], [F.desc("started_at"), F.desc("run_id"), F.desc("item_key")], limit)
    state = F.when(F.col("http_status").isNull() | (F.col("http_status") >= 400), "error").otherwise("ok")
    return last.select("url_id", F.col("rank").alias("k"), "run_id", "http_status", state.alias("check_state"), "started_at", "finished_at")


def attach_listing(items: DataFrame, listings: DataFrame) -> DataFrame:
    """Items with the id and title of the listing of their URL in their source, if there is one: adds shop_book_id, title."""
    own = listings.select("shop_id", "url", F.col("id").alias("shop_book_id"), "title")
    return items.drop("shop_book_id", "title").join(own, ["shop_id", "url"], "left")


def decorate_books(books: DataFrame, isbns: DataFrame, book_authors: DataFrame, authors: DataFrame, listings: DataFrame) -> DataFrame:
    """Works with their ISBNs, authors in order, and the number and lowest price of their listings: adds isbns, names, listings, min_cents.

    Each side is reduced to one row a work before it is joined; a work without any keeps nulls.
    """
    owned = isbns.groupBy(F.col("book_id").alias("id")).agg(F.array_sort(F.collect_list("isbn")).alias("isbns"))
    named = book_authors.where("role = 'author'").join(authors.select(F.col("id").alias("author_id"), "name"), "author_id")
    names = named.groupBy(F.col("book_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "name"))), lambda a: a["name"]).alias("names"))
    sold = listings.where("book_id is not null").groupBy(F.col("book_id").alias("id")).agg(F.count("*").alias("listings"), F.min("price_cents").alias("min_cents"))
    return books.join(owned, "id", "left").join(names, "id", "left").join(sold, "id", "left")


def rescrape_urls(issues: DataFrame, urls: DataFrame, issue: str, states: tuple[str, ...] = ("new",)) -> DataFrame:
    """The product URLs of every source that has a finding of this type in one of these states: (shop_id, url), each once."""
    wanted = issues.where((F.col("issue") == issue) & F.col("lifecycle_state").isin(*states)).select("shop_id").distinct()
    return urls.where("type = 'product'").join(wanted, "shop_id", "left_semi").select("shop_id", "url").distinct()


# The kind of source that a discovery phase reads.
PHASE_TO_SOURCE = {"discover_sitemap": "sitemap", "discover_categories": "category", "discover_full_crawl": "full_crawl"}


def run_urls(runs: DataFrame, items: DataFrame, listings: DataFrame, failures: DataFrame, urls: DataFrame) -> DataFrame:
    """The URLs of every run: its items, or where those are gone, what a discovery run saw last.

    A run with items shows them with their listing and, if they failed, the reason of their latest failure. One without
    shows, if it was a discovery, the URLs whose last sight it was, of the kind that its phase reads; an unknown phase
    reads all kinds. Returns run_id, origin (item, history), id, url, url_type, status, title, error_reason, http_status, at.
    """
    from .windows import latest_per_key

    last = latest_per_key(failures, ["run_id", "item_key"], [F.desc("failed_at"), F.desc("id")]).select("run_id", "item_key", F.col("error_reason").alias("_reason"))
    live = attach_listing(items, listings).join(last, ["run_id", "item_key"], "left")
    none = lambda kind: F.lit(None).cast(kind)
    shown = live.select("run_id", F.lit("item").alias("origin"), F.col("item_key").alias("id"), "url", none("string").alias("url_type"), "status", "title", F.when(F.col("status") == "failed", F.col("_reason")).alias("error_reason"), none("int").alias("http_status"), F.col("finished_at").alias("at"))
    gone = runs.where("phase like 'discover%'").join(items.select(F.col("run_id").alias("id")).distinct(), "id", "left_anti")
    kind = F.create_map(*[F.lit(x) for pair in PHASE_TO_SOURCE.items() for x in pair])[F.col("phase")]
    seen = urls.join(gone.select(F.col("id").alias("last_seen_run_id"), "phase"), "last_seen_run_id").where(kind.isNull() | (F.col("source") == kind))
    history = seen.select(F.col("last_seen_run_id").alias("run_id"), F.lit("history").alias("origin"), "id", "url", F.col("type").alias("url_type"), none("string").alias("status"), none("string").alias("title"), none("string").alias("error_reason"), F.col("last_http_status").cast("int").alias("http_status"), F.col("last_checked_at").alias("at"))
    return shown.unionByName(history)


def close_reasons(runs: DataFrame, issues: DataFrame) -> DataFrame:
    """Runs with the reason for their end: completed with or without errors, the latest failure finding of a failed one, else 'failed'; null while open."""
    failed = issues.where("issue = 'scrape_run_failed'").groupBy("run_id").agg(F.max_by("raw_value", "id").alias("_why"))
    out = runs.drop("close_reason").join(failed.withColumnRenamed("run_id", "id"), "id", "left")
    done = F.when(F.col("error_count") > 0, "completed_with_errors").otherwise("completed_ok")
    return out.withColumn("close_reason", F.when(F.col("status") == "completed", done).when(F.col("status") == "failed", F.coalesce(F.nullif("_why", F.lit("")), F.lit("failed")))).drop("_why")


def run_detail(runs: DataFrame, issues: DataFrame) -> DataFrame:
    """Every run with its close reason and its findings by field and issue, most frequent first."""
    counts = issues.groupBy("run_id", "field", "issue").agg(F.count("*").alias("n"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "field", "issue"))), lambda i: F.struct(i["field"].alias("field"), i["issue"].alias("issue"), (-i["o"]).alias("n")))
    return close_reasons(runs, issues).join(counts.groupBy(F.col("run_id").alias("id")).agg(listed.alias("findings")), "id", "left")


# Where the library shows a record, and where its records are read.
LIBRARY_PAGE, LIBRARY_RECORD = "https://ibiblioteka.lt/metis/publication/", "https://ibiblioteka.lt/metis-api/bibliographic-records/public/"


def source_links(books: DataFrame, library: str = "ibiblioteka") -> DataFrame:
    """Works with the record they were read from and the page that shows it: adds scraped_url, page_url.

    A library work with a code has both by its code (a stored source URL stays); any other has the page only if its
    source URL ends in a number.
    """
    code = F.when((F.col("data_source") == library) & (F.coalesce("libis_code", F.lit("")) != ""), F.col("libis_code"))
    last = F.regexp_extract(F.col("source_url"), "([^/]*)/*$", 1)
    number = F.when(last.rlike("^[0-9]+$"), last)
    return books.withColumn("scraped_url", F.coalesce("source_url", F.concat(F.lit(LIBRARY_RECORD), code))).withColumn("page_url", F.concat(F.lit(LIBRARY_PAGE), F.coalesce(code, number)))


def book_listings(listings: DataFrame, shops: DataFrame) -> DataFrame:
    """(id of the work, shop_listings): the listings of every work with their source, by source, then listing."""
    sold = listings.where("book_id is not null").join(shops.select(F.col("id").alias("shop_id"), F.col("name").alias("shop")), "shop_id")
    columns = [c for c in ("url", "price_cents", "in_stock", "is_active", "match_status", "title", "author", "year", "isbn", "publisher", "format", "first_seen_at", "last_seen_at") if c in listings.columns]
    return sold.groupBy(F.col("book_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("shop", F.col("id").alias("shop_book_id"), *columns))).alias("shop_listings"))


def book_detail(books: DataFrame, listings: DataFrame, shops: DataFrame, book_authors: DataFrame, authors: DataFrame) -> DataFrame:
    """Every work with its authors by role, in their order, and its sources: (id, title, authors, translators, first_seen, sources, listings, min_cents).

    ``source_links`` and ``book_listings`` give the rest of the view.
    """
    named = book_authors.join(authors.select(F.col("id").alias("author_id"), "name"), "author_id")
    by_role = lambda role: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("position", "name")))), lambda a: a["name"]), ", ")
    people = named.groupBy(F.col("book_id").alias("id")).agg(by_role("author").alias("authors"), by_role("translator").alias("translators"))
    sold = listings.where("book_id is not null").join(shops.select(F.col("id").alias("shop_id"), F.col("name").alias("shop")), "shop_id")
    sources = sold.groupBy(F.col("book_id").alias("id")).agg(
        F.min("first_seen_at").alias("first_seen"), F.array_join(F.array_sort(F.collect_set("shop")), ",").alias("sources"), F.count("*").alias("listings"), F.min("price_cents").alias("min_cents")
    )
    return books.select("id", "title").join(people, "id", "left").join(sources, "id", "left")


def issue_detail(issues: DataFrame, listings: DataFrame, urls: DataFrame, runs: DataFrame, shops: DataFrame, books: DataFrame, isbns: DataFrame) -> DataFrame:
    """Findings with their source, run, listing and URL, and with the linked work if the finding is that its ISBN drifted.

    A finding without a listing takes that of its URL in its source, the one of the smallest id.
    """
    by_url = urls.groupBy("shop_id", "url").agg(F.min(F.struct("id", "shop_book_id")).alias("_u"))
    found = issues.join(by_url, ["shop_id", "url"], "left").withColumn("shop_book_id", F.coalesce("shop_book_id", "_u.shop_book_id"))
    found = found.withColumn("_listing", F.coalesce(F.col("shop_book_id").cast("string"), F.concat(F.lit("no listing "), F.col("id").cast("string"))))
    owned = isbns.groupBy("book_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("isbn_type", "isbn")))).alias("_isbns"))
    works = books.select(F.col("id").alias("book_id"), F.col("title").alias("_work")).join(owned, "book_id", "left").select(F.col("book_id").cast("string").alias("_key"), "_work", "_isbns")
    # listings meet their works, not the wider findings; null keys would all meet in one task
    key = F.coalesce(F.col("book_id").cast("string"), F.concat(F.lit("no work "), F.col("id").cast("string")))
    book = listings.select("id", "title", "isbn", "book_id", key.alias("_key")).join(works, "_key", "left").select(F.col("id").cast("string").alias("_listing"), "title", "isbn", "book_id", "_work", "_isbns")
    out = (
        found.join(book, "_listing", "left")
        .join(shops.select(F.col("id").alias("shop_id"), F.col("name").alias("shop")), "shop_id", "left")
        .join(runs.select(F.col("id").alias("run_id"), F.col("status").alias("run_status"), "phase"), "run_id", "left")
    )
    drift = lambda c: F.when((F.col("issue") == "match_isbn_drift") & F.col("book_id").isNotNull(), c)
    return out.select(
        "id", "issue", "url", "lifecycle_state", "shop", "run_id", "run_status", "phase", "shop_book_id", F.col("_u.id").alias("discovered_url_id"), "title",
        drift(F.col("isbn")).alias("listing_isbn"), drift(F.col("book_id")).alias("book_id"), drift(F.col("_work")).alias("book_title"),
        drift(F.array_join(F.transform("_isbns", lambda i: i["isbn"]), ",")).alias("book_isbns"),
    )


def listing_extras(listings: DataFrame, attributes: DataFrame, urls: DataFrame, classifications: DataFrame) -> DataFrame:
    """(id, attributes, classification): a listing's attributes by key, and the verdict on its first URL if that has one.

    Attributes are empty where there are none; of a repeated key the largest value stands. The verdict is a struct of
    score, whether it is a book, the reasons as structs (key, points), and when.
    """
    one = attributes.groupBy("shop_book_id", "key").agg(F.max("value").alias("value"))
    held = one.groupBy(F.col("shop_book_id").alias("id")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("_held"))
    first = urls.where("shop_book_id is not null").groupBy(F.col("shop_book_id").alias("id")).agg(F.min(F.col("id")).alias("discovered_url_id"))
    reasons = F.coalesce(F.from_json("reasons", "array<struct<key: string, points: int>>"), F.array().cast("array<struct<key: string, points: int>>"))
    verdict = F.struct("book_score", "is_book_product", reasons.alias("reasons"), "classified_at")
    judged = classifications.select("discovered_url_id", F.when(F.col("book_score").isNotNull(), verdict).alias("classification"))
    out = listings.select("id").join(held, "id", "left").join(first, "id", "left").join(judged, "discovered_url_id", "left")
    return out.select("id", F.coalesce("_held", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("attributes"), "classification")


def listing_detail(listings: DataFrame, issues: DataFrame, changes: DataFrame, urls: DataFrame, prices: DataFrame, limit: int = HISTORY, scope: tuple[str, ...] = ()) -> DataFrame:
    """Every listing with its findings, latest changes and their runs, price series and first URL, as arrays.

    ``issues`` are by state and newest first, ``changes`` the ``limit`` latest, ``runs`` those of the changes and the listing's own
    last run, ``prices`` in order of time. ``scope`` names the columns of ``changes`` within which a listing's id is unique: each
    has its own latest. Several URLs of the first id make a row each.
    """
    found = issues.groupBy(F.col("shop_book_id").alias("id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("lifecycle_state", (-F.col("id")).alias("o"), "issue", "field"))), lambda i: F.struct((-i["o"]).alias("id"), i["issue"].alias("issue"), i["field"].alias("field"), i["lifecycle_state"].alias("lifecycle_state"))).alias("issues")
    )
    last = top_k_per_group(changes, [*scope, "shop_book_id"], [F.desc("changed_at"), F.desc("run_id"), F.asc("field")], limit)
    changed = last.groupBy(F.col("shop_book_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", "field", "old_value", "new_value", "changed_at"))).alias("changes"), F.collect_set("run_id").alias("_runs"))
    series = prices.groupBy(F.col("shop_book_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("observed_at", "price_cents"))).alias("prices"))
    known = urls.groupBy(F.col("shop_book_id").alias("id")).agg(F.count("*").alias("url_count"), F.min("id").alias("_url_id"))
    known = known.join(urls.select(F.col("id").alias("_url_id"), F.struct("url", "type", "fail_count").alias("_u")), "_url_id", "left").drop("_url_id")
    out = listings.join(found, "id", "left").join(changed, "id", "left").join(series, "id", "left").join(known, "id", "left")
    own = F.array(F.col("last_run_id")) if "last_run_id" in listings.columns else F.array().cast("array<bigint>")
    runs = F.array_sort(F.filter(F.array_distinct(F.concat(F.coalesce("_runs", F.array().cast("array<bigint>")), own)), lambda r: r.isNotNull()))
    return out.select(
        "id", "title", "issues", "changes", runs.alias("runs"), "prices", F.coalesce("url_count", F.lit(0)).alias("url_count"),
        F.col("_u.url").alias("discovery_url"), F.col("_u.type").alias("url_status"), F.coalesce("_u.fail_count", F.lit(0)).alias("url_fail_count"),
    )


# Ingest failures that are critical unless the server answered with an error.
CRITICAL_FAILURES = ("request_error", "anti_bot_detected", "schema_drift")
SORTS = {"id": "id", "type": "issue", "shop": "shop", "book": "title", "sev": "severity_rank"}


def unified_inbox(issues: DataFrame, failures: DataFrame, listings: DataFrame, urls: DataFrame, shops: DataFrame, runs: DataFrame) -> DataFrame:
    """Findings and ingest failures in one list of a common shape, with their source, listing, URL and severity.

    A finding belongs to its run's source and has its listing's title and type and its URL's type; a failure has the
    listing of its URL. ``severity_rank`` is 1 for critical, 2 for all others.
    """
    named = shops.select(F.col("id").alias("shop_id"), F.col("name").alias("shop"))
    of_run = runs.select(F.col("id").alias("run_id"), F.col("shop_id").alias("_run_shop"), F.col("started_at").alias("_started"))
    # a product that the optimizer does not fold: a constant would not be dealt by
    book = listings.select(F.col("id").alias("shop_book_id"), "title", F.col("type").alias("book_type"), (F.col("id") * 0).alias("_spread"))
    typed = urls.groupBy("shop_id", "url").agg(F.min_by("type", "id").alias("url_type"))
    # findings without a listing go by their own id, else they would all meet in one task; runs come after the wide join with listings
    keyed = issues.drop("shop_id").withColumn("_spread", F.when(F.col("shop_book_id").isNull(), F.col("id")).otherwise(0))
    finding = keyed.join(book, ["shop_book_id", "_spread"], "left").join(of_run, "run_id").withColumn("shop_id", F.col("_run_shop")).join(typed, ["shop_id", "url"], "left")
    critical = severity(F.col("issue"))
    findings = finding.select(
        F.lit("validation").alias("kind"), "id", "url", "field", "issue", F.col("raw_value").cast("string").alias("raw_value"), F.lit(None).cast("string").alias("error_reason"), F.lit(None).cast("int").alias("http_status"),
        "run_id", "shop_book_id", "title", "shop_id", "url_type", "book_type", "lifecycle_state", critical.alias("severity"), F.col("_started").alias("added_at"),
    )
    own = listings.select("shop_id", "url", F.col("id").alias("shop_book_id"), "title")
    served = F.coalesce(F.col("http_status").between(400, 599), F.lit(False))
    grave = F.coalesce(F.col("error_reason").rlike(f"^(?:{'|'.join(CRITICAL_FAILURES)})"), F.lit(False)) & ~served
    failed = failures.join(own, ["shop_id", "url"], "left").select(
        F.lit("scrape_failure").alias("kind"), "id", "url", F.lit("response").alias("field"), F.coalesce("error_reason", F.lit("unknown")).alias("issue"), F.col("http_status").cast("string").alias("raw_value"), "error_reason", "http_status",
        "run_id", "shop_book_id", "title", "shop_id", F.lit(None).cast("string").alias("url_type"), F.lit(None).cast("string").alias("book_type"), "lifecycle_state", F.when(grave, "critical").otherwise("warning").alias("severity"),
        F.col("failed_at").alias("added_at"),
    )
    both = findings.unionByName(failed).join(named, "shop_id", "left")
    return both.withColumn("severity_rank", F.when(F.col("severity") == "critical", 1).otherwise(2))


def inbox_page(
    inbox: DataFrame, kind: str = "", state: str = "open", shop_id: int | None = None, issue: str = "", run_id: int | None = None, search: str = "", severity: str = "",
    url_type: str | None = None, book_type: str | None = None, sort: str = "added", descending: bool = True, page: int = 1, per_page: int = 50,
) -> DataFrame:
    """One page of the unified inbox: filters, order (ties by id, findings first) and the page's rows.

    ``open`` are new findings and failures that are not acknowledged; URL and listing types only hold for findings.
    """
    out = inbox
    for column, value in (("kind", kind), ("shop_id", shop_id), ("run_id", run_id), ("severity", severity)):
        if value not in ("", None):
            out = out.where(F.col(column) == value)
    if issue:
        out = out.where(F.when(F.col("kind") == "validation", F.col("issue")).otherwise(F.col("error_reason")) == issue)
    finding = F.col("kind") == "validation"
    for column, value in (("url_type", url_type), ("book_type", book_type)):
        if value is not None:
            out = out.where(~finding | (F.col(column) == value))
    if state == "open":
        out = out.where(F.when(finding, F.col("lifecycle_state") == "new").otherwise(F.col("lifecycle_state") != "acknowledged"))
    elif state:
        out = out.where(F.col("lifecycle_state") == state)
    if search:
        out = out.where(matches_text(search, "url", "title"))
    order = F.desc if descending else F.asc
    return out.orderBy(order(SORTS.get(sort, "added_at")), order("id"), F.desc("kind")).offset((page - 1) * per_page).limit(per_page)
