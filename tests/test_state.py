"""Streaks with rows out of order over micro-batches, and keys that are forgotten."""

import datetime as dt
import random

import pytest

from tomewatch.sources import tables
from tomewatch.streaming import jobs
from tomewatch.streaming.state import ROCKSDB, failure_streaks_in_order

SCHEMA = "event_id long, ts timestamp, user_id long, failed boolean"


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    yield
    spark.conf.set(name, before)


def run(spark, tmp_path, files):
    out, folder = [], str(tmp_path / "in")
    for rows in files:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    made = failure_streaks_in_order(tables.stream_table(spark, folder, SCHEMA), late="40 minutes", idle_ms=86_400_000)
    q = made.writeStream.outputMode("append").foreachBatch(lambda b, n: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    return out, [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]


def test_order_and_expiry(spark, tmp_path, rocksdb):
    rng, at = random.Random(5), dt.datetime(2024, 1, 1)
    rows = [(k, at + dt.timedelta(seconds=30 * k), rng.randrange(6), rng.random() < 0.6) for k in range(240)]
    mixed = sorted(rows, key=lambda r: r[0] + rng.randrange(60))  # at most half an hour out of place
    end = [(1000, at + dt.timedelta(hours=4), 50, True)]
    gone = [(2000, at + dt.timedelta(days=3), 60, True)]
    out, state = run(spark, tmp_path, [mixed[k : k + 60] for k in range(0, 240, 60)] + [end, gone])
    last = {}
    for r in sorted(out, key=lambda r: r["at"]):
        last[r.user_id] = r.streak
    want = {r.user_id: r.streak for r in jobs.failure_streaks(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {k: v for k, v in last.items() if k < 50} == want and last[50] == 1
    assert max(state) > 20 and state[-1] <= 6  # only the last key is left, with its timer


def test_a_forgotten_key_starts_anew(spark, tmp_path, rocksdb):
    at = dt.datetime(2024, 1, 1)
    days = [[(k, at + dt.timedelta(days=d, minutes=k), 1, True) for k in range(2)] for d in (0, 5)]
    out, _ = run(spark, tmp_path, [days[0], [(90, at + dt.timedelta(days=3), 2, False)], days[1], [(91, at + dt.timedelta(days=6), 2, False)]])
    assert [r.streak for r in sorted(out, key=lambda r: r["at"]) if r.user_id == 1][-1] == 2
