"""Ranked and lagged views: price steps and movers, latest and top rows of a group, streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def price_steps(prices: DataFrame, since: str) -> DataFrame:
    """Each observation with the one before it, within the time range: the range's first has none.

    The filter stands below the window on purpose: moved above it, the first step would change.
    """
    order = Window.partitionBy("shop_book_id").orderBy("observed_at", "price_cents")
    return prices.where(F.col("observed_at") >= F.lit(since).cast("timestamp")).withColumn("previous_cents", F.lag("price_cents").over(order))


def price_movers(prices: DataFrame, since: str) -> DataFrame:
    """Changes of price, each (listing, before, after) once with its latest time, largest first."""
    steps = price_steps(prices, since).where("previous_cents <> price_cents")
    latest = steps.groupBy("shop_book_id", "previous_cents", "price_cents").agg(F.max("observed_at").alias("observed_at"))
    moved = latest.withColumn("change_cents", F.col("price_cents") - F.col("previous_cents"))
    return moved.orderBy(F.abs("change_cents").desc(), F.desc("observed_at"), "shop_book_id")


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``."""
    return top_k_per_group(df, keys, order, 1).drop("rank")


def top_k_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def job_metrics(runs: DataFrame, sample: int = 30) -> DataFrame:
    """Per (source, phase): the last final status, and mean seconds of the latest completed runs."""
    newest = [F.desc("started_at"), F.desc("id")]
    keys = ["shop_id", "phase"]
    final = latest_per_key(runs.where("status in ('completed', 'failed')"), keys, newest).select(*keys, F.col("status").alias("last_status"))
    done = top_k_per_group(runs.where("status = 'completed'"), keys, newest, sample).groupBy(*keys).agg(F.sum("seconds").alias("_s"), F.count("*").alias("sampled"))
    return final.join(done, keys, "left").select(*keys, "last_status", F.expr("_s div sampled").alias("mean_seconds"), "sampled")


def repeated_failures(runs: DataFrame, n: int = 3) -> DataFrame:
    """(source, phase, reason) whose last ``n`` final runs all failed with one known reason."""
    last = top_k_per_group(runs.where("status in ('completed', 'failed')"), ["shop_id", "phase"], [F.col("started_at").desc_nulls_last(), F.desc("id")], n)
    found = last.groupBy("shop_id", "phase").agg(F.count_if(F.expr("status = 'failed'")).alias("_f"), F.count("close_reason").alias("_r"), F.collect_set("close_reason").alias("_set"))
    return found.where((F.col("_f") == n) & (F.col("_r") == n) & (F.size("_set") == 1)).select("shop_id", "phase", F.col("_set")[0].alias("close_reason"))


def stall_streak(events: DataFrame, value: str, depth: int = 8) -> DataFrame:
    """How many of a run's newest snapshots equal the newest, counted back to a change or null, ``depth`` at most."""
    newest = Window.partitionBy("run_id").orderBy(F.desc("created_at"), F.desc("id"))
    seen = events.withColumn("_r", F.row_number().over(newest)).withColumn("_top", F.first(value).over(newest)).where(F.col("_r") <= depth)
    broken = F.min(F.when(~(F.col(value) == F.col("_top")) | F.col(value).isNull(), F.col("_r")))
    return seen.groupBy("run_id").agg((F.coalesce(broken, F.count("*") + 1) - 1).alias("streak"))


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.groupBy("shop_id").agg(F.max_by(F.struct("id", "status"), F.struct("started_at", "id")).alias("_r")).select("shop_id", "_r.id", "_r.status")


def last_success(runs: DataFrame) -> DataFrame:
    return runs.where("status = 'completed'").groupBy("shop_id", "phase").agg(F.max("started_at").alias("last_success"))


def failure_groups(failures: DataFrame, show_acked: bool = False) -> DataFrame:
    """Failed items of a run by the reason and status of their latest failure; nulls are values."""
    latest = latest_per_key(failures, ["run_id", "item_id"], [F.desc("failed_at"), F.desc("id")])
    groups = latest.groupBy("run_id", "error_reason", "http_status").agg(F.count_if(~F.col("acknowledged")).alias("unacked"), F.count_if("acknowledged").alias("acked"))
    return groups if show_acked else groups.where("unacked > 0")


def failure_recurrence(failures: DataFrame, previous: int = 5) -> DataFrame:
    """For each group of a run, in how many of the ``previous`` runs of its source the same group occurred."""
    groups = failures.select("shop_id", "run_id", "error_reason", "http_status").distinct()
    own = Window.partitionBy("shop_id").orderBy("run_id")
    numbered = failures.select("shop_id", "run_id").distinct().withColumn("_n", F.row_number().over(own))
    at = groups.join(numbered, ["shop_id", "run_id"])
    frame = Window.partitionBy("shop_id", "error_reason", "http_status").orderBy("_n").rangeBetween(-previous, -1)
    return at.withColumn("recurrence", F.count("*").over(frame)).drop("_n")


def top_failures(failures: DataFrame, k: int = 3) -> DataFrame:
    latest = latest_per_key(failures, ["run_id", "item_id"], [F.desc("failed_at"), F.desc("id")])
    return top_k_per_group(latest, ["run_id", "error_reason", "http_status"], [F.desc("failed_at"), F.desc("id")], k)
