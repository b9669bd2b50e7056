"""Presentation expressions: durations, ages, timestamps, prices, and the severity of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The severity of every finding type.
SEVERITY = {
    "critical": (
        "active_no_price", "discover_empty_first_page", "discover_zero_yield", "field_cleared", "in_stock_no_price", "invalid_price", "invalid_price_original", "missing_price",
        "missing_title", "price_higher_than_original", "price_zero", "scrape_run_failed", "zero_price",
    ),
    "warning": (
        "attribute_invalid_value", "attribute_unknown_key", "book_no_metadata", "discover_backend_5xx", "discover_fetch_failed", "empty_response", "format_mismatch",
        "html_in_text", "invalid_isbn", "invalid_url", "invalid_year", "isbn_duplicate", "match_isbn_drift", "no_price_history", "non_book_has_isbn", "redirect_to_homepage",
        "stale_active", "suspicious_title", "title_author_duplicate", "unreachable_active", "year_out_of_range", "year_pages_swap",
    ),
    "info": (
        "book_no_signals", "duplicate_sitemap_url", "format_is_dimensions", "non_product_active", "orphan_no_url", "product_url_non_book", "slug_diacritic_loss",
        "slug_title_mismatch", "unmatched_has_isbn", "url_aliases", "url_pattern_filtered",
    ),
}
DASH = "—"


def severities(spark: SparkSession) -> DataFrame:
    """(issue, severity): a dimension of 46 rows."""
    return spark.createDataFrame([(i, s) for s, names in SEVERITY.items() for i in names], "issue string, severity string")


def severity(issue: Column) -> Column:
    out = F.lit("warning")
    for s in ("critical", "info"):
        out = F.when(issue.isin(*SEVERITY[s]), s).otherwise(out)
    return out


def failure_severity(reason: Column, status: Column) -> Column:
    """Parser faults without an HTTP error are critical, other failures warnings."""
    http = F.coalesce(status.between(400, 599), F.lit(False))
    return F.when(F.coalesce(reason.startswith("parse"), F.lit(False)) & ~http, "critical").otherwise("warning")


def discount_percent(price: Column, original: Column) -> Column:
    """Per cent below the original price; null without one, and where it does not fit three digits."""
    p, o = price.cast("decimal(12,2)"), original.cast("decimal(12,2)")
    return F.when(o > 0, F.round((1 - p / o) * 100, 2).try_cast("decimal(5,2)"))


def duration_text(seconds: Column) -> Column:
    s = F.greatest(seconds, F.lit(0)).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    text = lambda a, unit: F.concat(a.cast("string"), F.lit(unit))
    pair = lambda a, ua, b, ub: F.when(b > 0, F.concat_ws(" ", text(a, ua), text(b, ub))).otherwise(text(a, ua))
    return F.when(seconds.isNull(), DASH).when(h > 0, pair(h, "h", m, "m")).when(m > 0, pair(m, "m", r, "s")).otherwise(text(r, "s"))


def age_text(seconds: Column) -> Column:
    """``5m ago`` and the like, by the largest unit that fits."""
    s = F.greatest(seconds, F.lit(0)).cast("long")
    ago = lambda n, unit: F.concat(F.floor(n).cast("long").cast("string"), F.lit(f"{unit} ago"))
    day = F.floor(s / 86400)
    return (
        F.when(seconds.isNull(), DASH).when(s < 60, "just now").when(s < 3600, ago(s / 60, "m")).when(s < 86400, ago(s / 3600, "h"))
        .when(day < 7, ago(day, "d")).when(day < 35, ago(day / 7, "w")).when(day < 360, ago(day / 30, "mo")).otherwise(ago(day / 365, "y"))
    )


def iso_text(ts: Column) -> Column:
    """ISO time in UTC, with microseconds only where there are any."""
    whole = F.date_trunc("second", ts) == ts
    return F.when(whole, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"))


def euro_text(cents: Column) -> Column:
    return F.when(cents.isNull(), DASH).otherwise(F.concat(F.lit("€"), F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0")))


def json_flag(payload: Column, path: str) -> Column:
    return F.coalesce(F.get_json_object(payload, path).try_cast("boolean"), F.lit(False))


def present_listing(df: DataFrame) -> DataFrame:
    """Price text, author or a dash, and the state a reader sees."""
    state = F.when(~F.col("is_active"), "delisted").when(~F.col("in_stock"), "out").otherwise("active")
    return df.select("id", "title", F.coalesce("author", F.lit(DASH)).alias("author"), euro_text(F.col("price_cents")).alias("price"), state.alias("state"))


def present_runs(df: DataFrame, now: str) -> DataFrame:
    """Phase split, progress, elapsed and age of runs."""
    found = F.col("phase").startswith("discover_")
    kind = F.when(found, "discover").when(F.col("phase").isin("match", "validate"), F.col("phase")).otherwise("scan")
    mode = F.when(found, F.substring_index("phase", "_", -1)).when(F.col("phase").isin("match", "validate"), "").otherwise("delta")
    share = F.least(F.lit(99).cast("long"), F.floor(F.col("urls_processed") * 100 / F.col("urls_total")).cast("long"))
    progress = F.when(F.col("status") == "completed", 100).when(F.coalesce("urls_total", F.lit(0)) <= 0, 0).otherwise(share)
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("started_at")
    return df.select(
        "id", kind.alias("phase_type"), mode.alias("phase_mode"), progress.cast("long").alias("progress"), duration_text(F.col("seconds")).alias("elapsed"),
        age_text(age).alias("started_ago"), iso_text(F.col("started_at")).alias("started_at"),
    )
