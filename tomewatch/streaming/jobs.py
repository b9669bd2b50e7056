"""Streaming forms: continuous ingest, rates, timeouts, streaks and online price steps, each with its batch twin."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def ingest_stream(stream: DataFrame, ingest: Callable[[DataFrame, int], None], checkpoint: str):
    """Run ``ingest`` on every micro-batch; it gets the batch's number, so that repeating a batch can be made idempotent."""
    return stream.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_once(df: DataFrame, batch: int, path: str) -> None:
    """Append a batch under its own number: writing it again replaces it."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def rate(events: DataFrame, at: str = "ts", size: str = "60 seconds", step: str = "10 seconds", late: str = "2 minutes") -> DataFrame:
    """Events per sliding window, in batch or (with a watermark) in a stream."""
    if events.isStreaming:
        events = events.withWatermark(at, late)
    return events.groupBy(F.window(at, size, step)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def trailing_rate(events: DataFrame, now: str, seconds: int = 60, at: str = "ts") -> DataFrame:
    end = F.lit(now).cast("timestamp")
    return events.where((F.col(at) > end - F.expr(f"interval {seconds} seconds")) & (F.col(at) <= end)).agg(F.count("*").alias("n"))


def eta_minutes(pending: DataFrame, done: DataFrame) -> DataFrame:
    """Minutes left per run: pending (run_id, pending) over the last minute's (run_id, n), 1 at least, null without a rate."""
    left = pending.join(done, "run_id", "left")
    return left.select("run_id", F.when(F.col("n") > 0, F.greatest(F.lit(1).cast("long"), F.ceil(F.col("pending") / F.col("n")))).alias("eta_minutes"))


def silent(events: DataFrame, now: str, seconds: int, key: str = "user_id", at: str = "ts") -> DataFrame:
    """Keys whose last event is older than ``seconds``: the batch form of the timeout."""
    last = events.groupBy(key).agg(F.max(at).alias("last_seen"))
    return last.where(F.col("last_seen") < F.lit(now).cast("timestamp") - F.expr(f"interval {seconds} seconds"))


def silent_stream(events: DataFrame, seconds: int, key: str = "user_id", at: str = "ts", late: str = "1 minute") -> DataFrame:
    """Keys silent for ``seconds`` of event time: one row when it happens, on the watermark's clock."""

    def watch(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({key: [k[0]], "last_seen": [pd.Timestamp(last, unit="ms")]})
            return
        newest = state.get[0] if state.exists else 0
        for b in batches:
            newest = max(newest, int(b[at].max().timestamp() * 1000))
        state.update((newest,))
        state.setTimeoutTimestamp(max(newest + seconds * 1000, state.getCurrentWatermarkMs() + 1))

    kept = events.withWatermark(at, late).select(key, at)
    return kept.groupBy(key).applyInPandasWithState(watch, f"{key} long, last_seen timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


# Seconds without a sign of life after which runs end, by status, with the reason; and for claimed items.
DEAD_RUNS = {"running": (60, "heartbeat_timeout"), "stopping": (60, "stop_timeout"), "paused": (604_800, "paused_timeout")}
STUCK_ITEM, RESUMABLE = 120, 604_800


def reap_runs(runs: DataFrame, now: str) -> DataFrame:
    """Runs after a sweep: those silent for too long fail with a reason (``reaped``), failed ones stop being resumable after a week.

    A run's last sign of life is its heartbeat, else its start; one without either is left alone.
    """
    moment = F.lit(now).cast("timestamp")
    last = F.coalesce("last_heartbeat", "started_at")
    seconds, reason = F.lit(None).cast("int"), F.lit(None).cast("string")
    for status, (after, why) in DEAD_RUNS.items():
        seconds = F.when(F.col("status") == status, after).otherwise(seconds)
        reason = F.when(F.col("status") == status, why).otherwise(reason)
    dead = F.coalesce(last < moment - F.make_dt_interval(secs=seconds), F.lit(False))
    out = runs.withColumn("reaped", dead).withColumn("close_reason", F.when(F.col("reaped"), reason).otherwise(F.col("close_reason")))
    out = out.withColumn("status", F.when(F.col("reaped"), "failed").otherwise(F.col("status")))
    if "finished_at" in runs.columns:
        out = out.withColumn("finished_at", F.when(F.col("reaped"), moment).otherwise(F.col("finished_at")))
        if "resumable_after_failure" in runs.columns:
            old = (F.col("status") == "failed") & (F.col("finished_at") < moment - F.make_dt_interval(secs=F.lit(RESUMABLE)))
            out = out.withColumn("resumable_after_failure", F.col("resumable_after_failure") & ~F.coalesce(old, F.lit(False)))
    return out


def stuck_items(items: DataFrame, runs: DataFrame, now: str) -> DataFrame:
    """Failures of items that are still being processed: their run has ended, or they were claimed too long ago."""
    moment = F.lit(now).cast("timestamp")
    held = items.where("status = 'processing'").join(runs.select(F.col("id").alias("run_id"), F.col("status").alias("_run")), "run_id")
    live = F.col("_run").isin("running", "paused")
    lost = ~live | (F.col("claimed_at") < moment - F.make_dt_interval(secs=F.lit(STUCK_ITEM)))
    return held.where(lost).withColumn("error_reason", F.when(live, "stuck_in_processing").otherwise("run_aborted")).withColumn("failed_at", moment).drop("_run")


def failure_streaks(events: DataFrame, key: str = "user_id", order: tuple[str, ...] = ("ts", "event_id"), failed: str = "failed") -> DataFrame:
    """Current run of failures of each key: those after its last success."""
    success = F.max(F.when(~F.col(failed), F.struct(*order))).over(Window.partitionBy(key))
    after = F.col("_success").isNull() | (F.struct(*order) > F.col("_success"))
    counted = events.withColumn("_success", success).groupBy(key).agg(F.count_if(F.col(failed) & after).alias("streak"))
    return counted.select(key, "streak", (F.col("streak") >= 3).alias("unreachable"))


def failure_streak_stream(events: DataFrame, key: str = "user_id", order: tuple[str, ...] = ("ts", "event_id"), failed: str = "failed") -> DataFrame:
    """The streak of each key after every micro-batch that touches it."""

    def count(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(list(order))
        for bad in rows[failed]:
            streak = streak + 1 if bad else 0
        state.update((streak,))
        yield pd.DataFrame({key: [k[0]], "streak": [streak], "unreachable": [streak >= 3]})

    kept = events.select(key, *order, failed)
    return kept.groupBy(key).applyInPandasWithState(count, f"{key} long, streak long, unreachable boolean", "streak long", "update", GroupStateTimeout.NoTimeout)


def price_step_stream(prices: DataFrame, key: str = "shop_book_id", at: str = "observed_at", price: str = "price_cents", late: str = "30 days", idle_days: int = 400) -> DataFrame:
    """Price changes as they arrive: the last price of each listing is state, rows later than the watermark are dropped.

    A listing without a price for ``idle_days`` of event time is forgotten; its next price starts anew, as no change.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, seen = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches), ignore_index=True).sort_values([at, price])
        when = rows[at].astype("datetime64[ms]").astype("int64")
        rows, when = rows[when >= seen], when[when >= seen]
        before = rows[price].shift()
        if len(rows):
            before.iloc[0] = last
            last, seen = int(rows[price].iloc[-1]), int(when.iloc[-1])
        changed = rows[before.notna() & (before != rows[price])]
        state.update((last, seen))
        state.setTimeoutTimestamp(max(seen + idle_days * 86_400_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: k[0], at: changed[at], "previous_cents": before[changed.index].astype("int64"), price: changed[price]})

    kept = prices.withWatermark(at, late).select(key, at, price)
    return kept.groupBy(key).applyInPandasWithState(step, f"{key} long, {at} timestamp, previous_cents long, {price} long", "last long, seen long", "append", GroupStateTimeout.EventTimeTimeout)


def fold_runs(events: DataFrame) -> DataFrame:
    """Runs from their events (run_id, at, kind, reason): first final event wins, its reason stands."""
    final = F.col("kind").isin("completed", "failed", "stopped")
    return events.groupBy("run_id").agg(
        F.min("at").alias("started_at"), F.min(F.when(final, F.col("at"))).alias("finished_at"),
        F.coalesce(F.min_by("kind", F.when(final, F.struct("at", "kind"))), F.lit("running")).alias("status"), F.min_by("reason", F.when(final, F.struct("at", "kind"))).alias("close_reason"),
    )


def aborted_items(items: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, failures): items still processing when their run ended become failed, with a failure row each."""
    done = runs.where("status <> 'running'").select(F.col("run_id"), F.col("finished_at").alias("_end"))
    out = items.join(done, "run_id", "left")
    lost = F.col("_end").isNotNull() & (F.col("status") == "processing")
    failures = out.where(lost).select("run_id", "item_key", F.lit("run_aborted").alias("error_reason"), F.col("_end").alias("failed_at"))
    return out.withColumn("status", F.when(lost, "failed").otherwise(F.col("status"))).drop("_end"), failures


def in_flight(items: DataFrame, now: str, limit: int = 50) -> DataFrame:
    """The oldest processing items with their age in seconds."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("started_at")
    return items.where("status = 'processing'").select("*", age.alias("age_seconds")).orderBy(F.desc("age_seconds"), "item_key").limit(limit)
