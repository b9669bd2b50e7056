"""The life of a finding: merge of a run's findings, resolution of what is gone, and moves by command."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN = ("new", "acknowledged", "snoozed")
STATES = ("new", "acknowledged", "snoozed", "resolved")
KEY = ["shop_id", "entity", "field", "issue"]


def resolve_entities(issues: DataFrame, listings: DataFrame, known: DataFrame) -> DataFrame:
    """Add ``entity``: the listing with exactly that URL, else the known URL it normalises to, else the URL itself."""
    from ..functions.urls import normalize_url

    own = listings.select("shop_id", "url", F.concat(F.lit("b:"), F.col("id").cast("string")).alias("_b")).dropDuplicates(["shop_id", "url"])
    urls = known.select("shop_id", F.col("normalized_url").alias("_n"), F.concat(F.lit("u:"), F.col("id").cast("string")).alias("_u")).dropDuplicates(["shop_id", "_n"])
    out = issues.withColumn("_n", normalize_url(F.col("url"))).join(own, ["shop_id", "url"], "left").join(urls, ["shop_id", "_n"], "left")
    return out.withColumn("entity", F.coalesce("_b", "_u", F.concat(F.lit("l:"), F.col("url")))).drop("_n", "_b", "_u")


def merge_findings(table: DataFrame, found: DataFrame, run: Column, now: Column, resolve: bool = True) -> DataFrame:
    """The findings table after a run.

    ``table``: KEY, url, raw_value, first_run, last_run, run_count, state, snoozed_until, acknowledged_at,
    resolved_at. ``found``: KEY, url, raw_value, initial_state. Found again: counted, value refreshed; resolved
    ones reopen in their initial state, expired snoozes become new, others keep their state. Open ones not found
    are resolved if ``resolve`` (a quality run), else left (an ingest batch). Keys are reduced to one finding first.
    """
    new = found.groupBy(*KEY).agg(F.min_by(F.struct("url", "raw_value", "initial_state"), F.struct("raw_value", "url")).alias("_f"))
    new = new.select(*KEY, F.col("_f.url").alias("f_url"), F.col("_f.raw_value").alias("f_raw"), F.col("_f.initial_state").alias("f_state"), F.lit(True).alias("_found"))
    old = table.withColumn("_held", F.lit(True))
    both = old.join(new, KEY, "full")
    held, hit = F.col("_held").isNotNull(), F.col("_found").isNotNull()
    back = held & hit & (F.col("state") == "resolved")
    woken = held & hit & (F.col("state") == "snoozed") & (F.col("snoozed_until") <= now)
    gone = held & ~hit & F.col("state").isin(*OPEN) & F.lit(resolve)
    state = F.when(~held | back, F.col("f_state")).when(woken, "new").when(gone, "resolved").otherwise(F.col("state"))
    acked = F.when((~held | back) & (F.col("f_state") == "acknowledged"), now).otherwise(F.col("acknowledged_at"))
    return both.select(
        *KEY,
        F.coalesce("url", "f_url").alias("url"),
        F.when(hit, F.col("f_raw")).otherwise(F.col("raw_value")).alias("raw_value"),
        F.coalesce(F.col("first_run"), run).alias("first_run"),
        F.when(hit, run).otherwise(F.col("last_run")).alias("last_run"),
        (F.coalesce("run_count", F.lit(0)) + hit.cast("int")).alias("run_count"),
        state.alias("state"),
        "snoozed_until",
        acked.alias("acknowledged_at"),
        F.when(back, None).when(gone, now).otherwise(F.col("resolved_at")).alias("resolved_at"),
    )


def ingest_findings(table: DataFrame, issues: DataFrame, listings: DataFrame, known: DataFrame, run: Column, now: Column) -> DataFrame:
    """The findings table after an ingest batch: ``issues`` (shop_id, url, field, issue, raw_value) get their entities and are merged.

    Empty values count as none; open findings that the batch does not name stay as they are.
    """
    batch = issues.withColumn("raw_value", F.nullif("raw_value", F.lit(""))).withColumn("initial_state", F.lit("new"))
    return merge_findings(table, resolve_entities(batch, listings, known), run, now, resolve=False)


def apply_commands(table: DataFrame, commands: DataFrame, now: Column) -> DataFrame:
    """Bulk moves: ``commands`` (issue, shop_id or null for all, state, snooze_days), one command per (issue, source)."""
    all_shops = commands.where("shop_id is null").select("issue", F.struct("state", "snooze_days").alias("_any"))
    one_shop = commands.where("shop_id is not null").select("issue", "shop_id", F.struct("state", "snooze_days").alias("_own"))
    joined = table.join(one_shop, ["issue", "shop_id"], "left").join(all_shops, "issue", "left")
    c = F.coalesce("_own", "_any")
    moved = c.isNotNull() & (F.col("state") != "resolved")
    snoozed = F.when(moved, F.when(c["state"] == "snoozed", now + F.make_interval(days=c["snooze_days"]))).otherwise(F.col("snoozed_until"))
    acked = F.when(moved & (c["state"] == "acknowledged"), now).when(moved & (c["state"] == "new"), None).otherwise(F.col("acknowledged_at"))
    out = joined.withColumn("snoozed_until", snoozed).withColumn("acknowledged_at", acked).withColumn("state", F.when(moved, c["state"]).otherwise(F.col("state")))
    return out.select(*table.columns)


def acknowledge_failures(failures: DataFrame, groups: DataFrame) -> DataFrame:
    """Acknowledge failures of the given (error_reason, http_status), null being a value."""
    g = groups.select(F.col("error_reason").alias("_r"), F.col("http_status").alias("_s")).distinct().withColumn("_hit", F.lit(True))
    joined = failures.join(g, F.col("error_reason").eqNullSafe(F.col("_r")) & F.col("http_status").eqNullSafe(F.col("_s")), "left")
    return joined.withColumn("acknowledged", F.col("acknowledged") | F.col("_hit").isNotNull()).select(*failures.columns)


def run_failure_findings(runs: DataFrame, table: DataFrame) -> DataFrame:
    """One ``scrape_run_failed`` finding for every failed run that has none yet."""
    failed = runs.where("status = 'failed'").select("shop_id", F.concat(F.lit("run:"), F.col("id").cast("string")).alias("url"), F.col("close_reason").alias("raw_value"))
    out = failed.join(table.where("issue = 'scrape_run_failed'").select("url"), "url", "left_anti")
    return out.select("shop_id", "url", F.lit("status").alias("field"), F.lit("scrape_run_failed").alias("issue"), "raw_value", F.lit("new").alias("initial_state"))


def inbox(issues: DataFrame, failures: DataFrame) -> DataFrame:
    """Findings and ingest failures in one list with a common shape."""
    from ..functions.present import failure_severity, severity

    a = issues.select(F.lit("finding").alias("kind"), "id", "run_id", "issue", F.col("lifecycle_state").alias("state"), severity(F.col("issue")).alias("severity"), F.col("first_seen_at").alias("seen_at"))
    b = failures.select(
        F.lit("failure").alias("kind"), "id", "run_id", F.coalesce("error_reason", F.lit("unknown")).alias("issue"), F.when(F.col("acknowledged"), "acknowledged").otherwise("new").alias("state"),
        failure_severity(F.col("error_reason"), F.col("http_status")).alias("severity"), F.col("failed_at").alias("seen_at"),
    )
    return a.unionByName(b)
