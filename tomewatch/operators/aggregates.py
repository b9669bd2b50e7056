"""Aggregates behind the read models: one pass where possible, sides pre-aggregated before they are joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tenths(part: Column, whole: Column) -> Column:
    """A percentage to one decimal, half up; null without a whole."""
    return F.when(whole > 0, F.floor(part * F.lit(1000.0) / whole + 0.5) / F.lit(10.0))


def overview_counts(listings: DataFrame, prices: DataFrame) -> DataFrame:
    n = listings.agg(F.count("*").alias("listings"), F.count_if("is_active").alias("active"), F.count("isbn").alias("with_isbn"))
    return n.join(F.broadcast(prices.agg(F.count("*").alias("observations"))))


def completeness(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, pct) of non-null values; no rows when the table is empty."""
    counts = df.agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in fields]).where("n > 0")
    return counts.unpivot("n", fields, "field", "present").select("field", tenths(F.col("present"), F.col("n")).alias("pct"))


def field_stats(df: DataFrame, fields: list[str], by: str = "shop_id") -> DataFrame:
    """(source, field, missing, present)."""
    counts = df.groupBy(by).agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in fields])
    return counts.unpivot([by, "n"], fields, "field", "present").select(by, "field", (F.col("n") - F.col("present")).alias("missing"), "present")


def shop_stats(shops: DataFrame, listings: DataFrame, urls: DataFrame, prices: DataFrame, issues: DataFrame) -> DataFrame:
    """Per source: listings, active, URLs, observations and new findings, zero-filled."""
    own = listings.groupBy("shop_id").agg(F.count("*").alias("listings"), F.count_if("is_active").alias("active"))
    known = urls.groupBy("shop_id").agg(F.count("*").alias("urls"))
    seen = prices.join(listings.select(F.col("id").alias("shop_book_id"), "shop_id"), "shop_book_id").groupBy("shop_id").agg(F.count("*").alias("observations"))
    new = issues.where("lifecycle_state = 'new'").groupBy("shop_id").agg(F.count("*").alias("new_issues"))
    out = shops.select(F.col("id").alias("shop_id"), "name")
    for side in (own, known, seen, new):
        out = out.join(side, "shop_id", "left")
    return out.fillna(0, ["listings", "active", "urls", "observations", "new_issues"])


def issue_groups(issues: DataFrame, by: list[str]) -> DataFrame:
    """Findings by key with a count per state."""
    states = ("new", "acknowledged", "snoozed", "resolved")
    return issues.groupBy(*by).agg(F.count("*").alias("total"), *[F.count_if(F.col("lifecycle_state") == s).alias(s) for s in states])


def issue_summary(issues: DataFrame, state: str) -> DataFrame:
    return issues.where(F.col("lifecycle_state") == state).groupBy("issue").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "issue")


def conflicts(listings: DataFrame) -> DataFrame:
    """Works whose listings disagree on title, author, year or publisher, letter case aside."""
    tell = [F.lower("title"), F.lower("author"), F.col("year"), F.lower("publisher")]
    found = listings.where("book_id is not null").groupBy("book_id").agg(*[F.count_distinct(c).alias(f"_{k}") for k, c in enumerate(tell)])
    return found.where("_0 > 1 or _1 > 1 or _2 > 1 or _3 > 1").select("book_id")


def price_span(listings: DataFrame) -> DataFrame:
    return listings.where("book_id is not null").groupBy("book_id").agg(
        F.count("*").alias("n"), F.min("price_cents").alias("min_cents"), F.max("price_cents").alias("max_cents")
    )


def book_stats(books: DataFrame, listings: DataFrame) -> DataFrame:
    """Works in all, from the library (and share), with several and with one source, mean listings, conflicts."""
    per = listings.where("book_id is not null").groupBy("book_id").agg(F.count_distinct("shop_id").alias("sources"), F.count("*").alias("n"))
    counts = per.agg(F.count_if(F.expr("sources > 1")).alias("multi_source"), F.count_if(F.expr("sources = 1")).alias("single_source"), F.sum("n").alias("_n"), F.count("*").alias("_b"))
    totals = books.agg(F.count("*").alias("total"), F.count_if(F.expr("data_source = 'library'")).alias("enriched"))
    clash = conflicts(listings).agg(F.count("*").alias("conflicts"))
    out = totals.join(F.broadcast(counts)).join(F.broadcast(clash))
    mean = F.when(F.col("_b") > 0, F.floor(F.col("_n") * F.lit(10.0) / F.col("_b") + 0.5) / F.lit(10.0))
    return out.select("total", "enriched", tenths(F.col("enriched"), F.col("total")).alias("enriched_pct"), "multi_source", "single_source", mean.alias("avg_listings"), "conflicts")


def years(books: DataFrame) -> DataFrame:
    return books.select("year").where("year is not null").distinct().orderBy(F.desc("year"))


def daily_price(prices: DataFrame, listings: DataFrame, now: str, days: int = 30, book: int | None = None) -> DataFrame:
    """Highest price per work, source and day of the last ``days`` days."""
    linked = listings.where("book_id is not null").select(F.col("id").alias("shop_book_id"), "shop_id", "book_id")
    linked = linked if book is None else linked.where(F.col("book_id") == book)
    recent = prices.where(F.col("observed_at") >= F.lit(now).cast("timestamp") - F.expr(f"interval {days} days"))
    return recent.join(linked, "shop_book_id").groupBy("book_id", "shop_id", F.date_trunc("day", "observed_at").alias("day")).agg(F.max("price_cents").alias("price_cents"))


def run_breakdown(items: DataFrame, statuses: tuple[str, ...] = ("pending", "processing", "done", "failed")) -> DataFrame:
    """Items of each run by status, zero-filled, and how many are final."""
    out = items.groupBy("run_id").pivot("status", list(statuses)).count().fillna(0)
    return out.withColumn("terminal", F.col("done") + F.col("failed"))


def run_counts(runs: DataFrame, changes: DataFrame, created: DataFrame) -> DataFrame:
    """Per run: listings created (``created`` has run_id) and distinct listings changed."""
    added = created.groupBy("run_id").agg(F.count("*").alias("added"))
    updated = changes.groupBy("run_id").agg(F.count_distinct("shop_book_id").alias("updated"))
    out = runs.select(F.col("id").alias("run_id")).join(added, "run_id", "left").join(updated, "run_id", "left")
    return out.fillna(0, ["added", "updated"])


def changed_fields(changes: DataFrame) -> DataFrame:
    return changes.groupBy("run_id", "shop_book_id").agg(F.array_join(F.array_sort(F.collect_set("field")), ", ").alias("fields"))


def run_kpis(runs: DataFrame, now: str) -> DataFrame:
    recent = F.col("started_at") >= F.lit(now).cast("timestamp") - F.expr("interval 24 hours")
    return runs.agg(
        F.count_if(F.expr("status = 'running'")).alias("running"), F.count_if(recent).alias("day_total"), F.count_if(recent & (F.col("status") == "completed")).alias("day_ok"),
        F.count_if(recent & (F.col("status") == "failed")).alias("day_failed"), F.count("*").alias("all_time"),
    )


def listing_kpis(listings: DataFrame, urls: DataFrame) -> DataFrame:
    n = listings.agg(
        F.count("*").alias("total"), F.count_if("is_active").alias("active"), F.count_if(F.col("isbn").isNull()).alias("missing_isbn"), F.count_if(F.col("price_cents").isNull()).alias("missing_price")
    )
    bad = urls.where("type = 'unreachable'").select(F.col("shop_book_id").alias("id"))
    return n.join(F.broadcast(listings.join(bad, "id", "left_semi").agg(F.count("*").alias("unreachable"))))


def url_kpis(urls: DataFrame) -> DataFrame:
    return urls.agg(
        F.count("*").alias("total"), F.count("shop_book_id").alias("with_listing"), F.count_if(F.col("shop_book_id").isNull()).alias("without"), F.count_if(F.expr("fail_count >= 3")).alias("failed")
    )


def run_findings(issues: DataFrame) -> DataFrame:
    return issues.groupBy("run_id", "field", "issue").agg(F.count("*").alias("n")).orderBy("run_id", F.desc("n"), "field", "issue")


def calendar(spark, now: str, days: int) -> DataFrame:
    """The last ``days`` days up to that of ``now``, one row each."""
    last = F.lit(now).cast("timestamp").cast("date")
    return spark.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))


def activity(runs: DataFrame, now: str, days: int = 14) -> DataFrame:
    """Items of completed runs per day, dense."""
    done = runs.where("status = 'completed'").groupBy(F.to_date("started_at").alias("day")).agg(F.sum("urls_processed").alias("items"))
    return F.broadcast(calendar(runs.sparkSession, now, days)).join(done, "day", "left").fillna(0, ["items"])


def issue_trend(issues: DataFrame, now: str, days: int = 7, state: str | None = None) -> DataFrame:
    """Findings per type and day, dense over the types that occur."""
    kept = issues if state is None else issues.where(F.col("lifecycle_state") == state)
    daily = kept.groupBy("issue", F.to_date("first_seen_at").alias("day")).agg(F.count("*").alias("n"))
    last = F.lit(now).cast("timestamp").cast("date")
    dense = kept.select("issue").distinct().select("issue", F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))
    return dense.join(daily, ["issue", "day"], "left").fillna(0, ["n"]).groupBy("issue").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("day", "n"))), lambda s: s["n"]).alias("counts")
    )


def zero_yield_runs(runs: DataFrame, now: str) -> DataFrame:
    recent = F.col("started_at") >= F.lit(now).cast("timestamp") - F.expr("interval 24 hours")
    return runs.where(F.col("phase").startswith("discover") & (F.col("status") == "completed") & recent & (F.col("urls_processed") == 0)).agg(F.count("*").alias("n"))


def failed_runs(runs: DataFrame, start: str, end: str, limit: int = 100) -> DataFrame:
    return runs.where(F.col("status") == "failed").where(F.col("started_at").between(start, end)).orderBy(F.col("started_at").desc_nulls_first(), F.desc("id")).limit(limit)


def pipeline_health(runs: DataFrame, now: str, last: int = 24) -> DataFrame:
    """Per phase: results of 24 hours, success of 30 days, mean seconds, and the last statuses, oldest first."""
    from pyspark.sql import Window

    at = F.lit(now).cast("timestamp")
    day, month = F.col("started_at") >= at - F.expr("interval 24 hours"), F.col("started_at") >= at - F.expr("interval 30 days")
    ok, bad = F.col("status") == "completed", F.col("status") == "failed"
    stats = runs.groupBy("phase").agg(
        F.count_if(day & ok).alias("ok_24h"), F.count_if(day & bad).alias("failed_24h"), F.count_if(day).alias("total_24h"),
        F.count_if(month & ok).alias("_ok"), F.count_if(month & (ok | bad)).alias("_all"), F.floor(F.avg(F.when(ok, F.col("seconds")))).alias("mean_seconds"),
    )
    rank = F.row_number().over(Window.partitionBy("phase").orderBy(F.desc("started_at"), F.desc("id")))
    recent = runs.withColumn("_r", rank).where(F.col("_r") <= last).groupBy("phase").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_r")).alias("o"), "status"))), lambda s: s["status"]), ",").alias("recent")
    )
    return stats.join(recent, "phase").select("phase", "ok_24h", "failed_24h", "total_24h", tenths(F.col("_ok"), F.col("_all")).alias("success_30d"), "mean_seconds", "recent")


def duplicate_urls(df: DataFrame, url: str = "url") -> DataFrame:
    return df.agg((F.count(url) - F.count_distinct(url)).alias("duplicates"))


def zero_yield(found: DataFrame, known: DataFrame) -> DataFrame:
    """Sources that had URLs and found none now: (shop_id, known)."""
    return known.groupBy("shop_id").agg(F.count("*").alias("known")).join(found.select("shop_id").distinct(), "shop_id", "left_anti")


def settings_map(settings: DataFrame) -> DataFrame:
    return settings.groupBy("shop_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("settings"))


def run_issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("run_id").agg(F.count("*").alias("findings"))


def restart_depth(events: DataFrame, kind: str = "restarted") -> DataFrame:
    return events.where(F.col("event_type") == kind).groupBy("run_id").agg(F.count("*").alias("restarts"))
