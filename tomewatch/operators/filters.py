"""Row selection over listings, works, URLs, runs, findings and work items. ``now`` is always given, never read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINAL_STATES = ("completed", "failed")


def live(df: DataFrame, in_stock: bool = False) -> DataFrame:
    """The one gate of all quality rules: active listings, in stock too when asked."""
    return df.where("is_active and in_stock") if in_stock else df.where("is_active")


def matches_text(term: str, *cols: str) -> Column:
    """Case-insensitive containment in any of ``cols``; ``%`` and ``_`` in the term stay wildcards."""
    out = F.lit(False)
    for c in cols:
        out = out | F.coalesce(F.col(c).ilike(f"%{term}%"), F.lit(False))
    return out


def filter_listings(
    df: DataFrame, shop: int | None = None, search: str | None = None, category: str | None = None, type: str | None = None,
    format: str | None = None, missing: str | None = None, active: bool | None = None, has_isbn: bool | None = None,
    linked: bool | None = None, unreachable: DataFrame | None = None,
) -> DataFrame:
    """Listings by any mix of conditions; ``format='none'`` is null, ``missing='any'`` any of the optional fields."""
    fields = ("author", "publisher", "year", "isbn", "price_cents", "format")
    if shop is not None:
        df = df.where(F.col("shop_id") == shop)
    if search:
        df = df.where(matches_text(search, "title", "author", "isbn"))
    if category:
        df = df.where(F.col("category") == category)
    if type:
        df = df.where(F.col("type") == type)
    if format:
        df = df.where(F.col("format").isNull() if format == "none" else F.col("format") == format)
    if missing:
        columns = fields if missing == "any" else (missing,)
        gone = F.lit(False)
        for c in columns:
            gone = gone | F.col(c).isNull()
        df = df.where(gone)
    for wanted, held in ((active, F.col("is_active")), (has_isbn, F.col("isbn").isNotNull()), (linked, F.col("book_id").isNotNull())):
        if wanted is not None:
            df = df.where(held if wanted else ~held)
    if unreachable is not None:
        bad = unreachable.where("type = 'unreachable'").select(F.col("shop_book_id").alias("id"))
        df = df.join(bad, "id", "left_semi")
    return df


def filter_books(
    books: DataFrame, isbns: DataFrame, listings: DataFrame, source: str | None = None, year: int | None = None, has_isbn: bool | None = None,
    listed: tuple[int | None, int | None] | None = None, conflicts: DataFrame | None = None, search: str | None = None,
) -> DataFrame:
    """Works by source, year, ISBN, number of listings, conflicts, or a term that is an ISBN or text.

    A minimum of 0 listings still leaves out works without any.
    """
    if source:
        books = books.where(F.col("data_source") == source)
    if year is not None:
        books = books.where(F.col("year") == year)
    if has_isbn is not None:
        own = isbns.select(F.col("book_id").alias("id"))
        books = books.join(own, "id", "left_semi" if has_isbn else "left_anti")
    if listed:
        n = listings.where("book_id is not null").groupBy(F.col("book_id").alias("id")).agg(F.count("*").alias("_n"))
        low, high = listed
        n = n if low is None else n.where(F.col("_n") >= low)
        n = n if high is None else n.where(F.col("_n") <= high)
        books = books.join(n, "id", "left_semi")
    if conflicts is not None:
        books = books.join(conflicts.select(F.col("book_id").alias("id")), "id", "left_semi")
    if search:
        digits = search.replace("-", "").replace(" ", "")
        if len(digits) in (10, 13) and digits[:-1].isdigit():
            books = books.join(isbns.where(F.col("isbn") == digits).select(F.col("book_id").alias("id")), "id", "left_semi")
        else:
            books = books.where(matches_text(search, "title"))
    return books


def filter_urls(df: DataFrame, shop: int | None = None, type: str | None = None, search: str | None = None, failing: bool | None = None, listed: bool | None = None) -> DataFrame:
    """Known URLs; failing means three failures or more."""
    if shop is not None:
        df = df.where(F.col("shop_id") == shop)
    if type:
        df = df.where(F.col("type") == type)
    if search:
        df = df.where(matches_text(search, "url"))
    if failing is not None:
        df = df.where(F.col("fail_count") >= 3 if failing else F.col("fail_count") < 3)
    if listed is not None:
        df = df.where(F.col("shop_book_id").isNotNull() if listed else F.col("shop_book_id").isNull())
    return df


def filter_runs(df: DataFrame, now: str, phase: str | None = None, status: str | None = None, shop: int | None = None, since: str | None = None, search: str | None = None) -> DataFrame:
    """Runs by class of phase (``crawls``: all but validate; ``discover``: its family; exact; unknown: none) and age."""
    spans = {"1h": 1, "24h": 24, "7d": 24 * 7, "30d": 24 * 30}
    if phase == "crawls":
        df = df.where("phase <> 'validate'")
    elif phase == "discover":
        df = df.where(F.col("phase").startswith("discover"))
    elif phase:
        df = df.where(F.col("phase") == phase)
    if status:
        df = df.where(F.col("status") == status)
    if shop is not None:
        df = df.where(F.col("shop_id") == shop)
    if since:
        df = df.where(F.col("started_at") >= F.lit(now).cast("timestamp") - F.expr(f"interval {spans[since]} hours"))
    if search:
        df = df.where(F.col("id") == int(search) if search.isdigit() else matches_text(search, "phase", "close_reason"))
    return df


def filter_issues(df: DataFrame, severities: DataFrame | None = None, severity: str | None = None, state: str | None = None, shop: int | None = None, run: int | None = None, search: str | None = None) -> DataFrame:
    """Findings by state (``open`` is new or acknowledged), source, run, severity or text."""
    if state == "open":
        df = df.where(F.col("lifecycle_state").isin("new", "acknowledged"))
    elif state:
        df = df.where(F.col("lifecycle_state") == state)
    if shop is not None:
        df = df.where(F.col("shop_id") == shop)
    if run is not None:
        df = df.where(F.col("run_id") == run)
    if severity:
        df = df.join(F.broadcast(severities.where(F.col("severity") == severity).select("issue")), "issue", "left_semi")
    if search:
        df = df.where(matches_text(search, "url", "issue", "field"))
    return df


def filter_pattern(df: DataFrame, pattern: str, url: str = "url") -> tuple[DataFrame, DataFrame]:
    """(rows whose URL matches, one row with the number dropped)."""
    return df.where(F.col(url).rlike(pattern)), df.agg(F.count_if(~F.col(url).rlike(pattern)).alias("filtered"))


def due_urls(df: DataFrame, now: str, mode: str = "full", limit: int | None = None) -> DataFrame:
    """URLs to refresh: no non-product, fewer than 3 failures or last checked over 7 days ago or never; oldest first."""
    old = F.col("last_checked_at").isNull() | (F.col("last_checked_at") < F.lit(now).cast("timestamp") - F.expr("interval 7 days"))
    df = df.where((F.col("type") != "non_product") & ((F.col("fail_count") < 3) | old))
    if mode == "delta":
        df = df.where("type <> 'product'")
    df = df.orderBy(F.col("last_checked_at").asc_nulls_first(), "id")
    return df if limit is None else df.limit(limit)


def stable_urls(df: DataFrame, now: str) -> DataFrame:
    """URLs of a settled type checked within 7 days."""
    return df.where(F.col("type").isin("product", "non_product") & (F.col("last_checked_at") >= F.lit(now).cast("timestamp") - F.expr("interval 7 days")))


def resumable_runs(runs: DataFrame, items: DataFrame) -> DataFrame:
    """Running runs, or failed ones not lost by heartbeat, that still have pending items; latest first."""
    pending = items.where("status = 'pending'").select(F.col("run_id").alias("id"))
    can = (F.col("status") == "running") | ((F.col("status") == "failed") & ~F.col("close_reason").eqNullSafe("heartbeat_timeout"))
    return runs.where(can).join(pending, "id", "left_semi").orderBy(F.desc("started_at"), F.desc("id"))


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page of a total order; callers end ``order`` with the id."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_count(df: DataFrame, size: int) -> DataFrame:
    """(total, pages), at least one page."""
    return df.agg(F.count("*").alias("total")).select("total", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("total") / size)).alias("pages"))


def sort_column(name: str, allowed: tuple[str, ...], descending: bool = False) -> Column:
    """A whitelisted sort column, nulls last either way."""
    if name not in allowed:
        raise ValueError(f"cannot sort by {name}")
    return F.col(name).desc_nulls_last() if descending else F.col(name).asc_nulls_last()


def ranked(col: str, order: tuple[str, ...]) -> Column:
    """The place of a value in a declared order, unknown values last."""
    out = F.lit(len(order))
    for k, v in reversed(list(enumerate(order))):
        out = F.when(F.col(col) == v, k).otherwise(out)
    return out
