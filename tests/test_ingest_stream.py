"""Bucketed upserts and the ingest of item batches: untouched files, repeats, breaks between any two sinks, stream and batch twins."""

import datetime as dt
import hashlib
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tomewatch.operators import ingest as g
from tomewatch.sources import tables
from tomewatch.sources.buckets import BucketedTable
from tomewatch.streaming.ingest import ISSUES, ITEM, KINDS, SINKS, Catalogue, judged, kind_metrics


def digests(folder):
    return {str(p): hashlib.md5(p.read_bytes()).hexdigest() for p in Path(folder).rglob("*.parquet")}


def rules(old, new):
    return tables.merge(old, new, ["k"], overwrite=["v"], keep=["w"])


def test_untouched_files_stay(spark, tmp_path):
    table = BucketedTable(str(tmp_path / "t"), ("k",), "k long, v string, w string", 32)
    first = spark.range(1000).select(F.col("id").alias("k"), F.lit("a").alias("v"), F.when(F.col("id") % 2 == 0, "x").alias("w"))
    table.create(first)
    before = digests(table.path)
    batch = spark.createDataFrame([(3, None, "y"), (4, "b", "y"), (5000, "c", None)], "k long, v string, w string")
    want = sorted(map(tuple, rules(first, batch).drop("created").select("k", "v", "w").collect()))
    for number in (0, 0, 1):  # again under its number, and again as another batch
        table.upsert(batch, number, rules)
        assert sorted(map(tuple, table.read(spark).collect())) == want
    after = digests(table.path)
    hit = table.touched(batch)
    changed = {p for p in before.keys() | after.keys() if before.get(p) != after.get(p)}
    assert 1 <= len(hit) <= 3 and changed and all(any(f"/bucket={b}/" in p for b in hit) for p in changed)
    assert len(before.keys() & after.keys()) == len(before) - len(hit)
    scan = table.read(spark, hit)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in scan and "bucket" in scan
    table.upsert(batch.limit(0), 2, rules)
    assert digests(table.path) == after


def test_broken_apply_is_repeated(spark, tmp_path):
    """A bucket that an interrupted move has lost comes back when the batch is run again."""
    table = BucketedTable(str(tmp_path / "t"), ("k",), "k long, v string, w string", 4)
    first = spark.range(40).select(F.col("id").alias("k"), F.lit("a").alias("v"), F.lit("x").alias("w"))
    table.create(first)
    batch = spark.createDataFrame([(k, "b", None) for k in range(10)], "k long, v string, w string")
    table.prepare(batch, 7, rules)
    gone = Path(table.path) / f"bucket={table.touched(batch)[0]}"
    gone.rename(tmp_path / "lost")
    table.upsert(batch, 7, rules)
    assert sorted(map(tuple, table.read(spark).collect())) == sorted(map(tuple, rules(first, batch).select("k", "v", "w").collect()))


def item(n, day, **over):
    base = {"item_id": f"{n}-{day}", "at": dt.datetime(2024, 1, day, n % 24), "shop_id": n % 2, "url": f"https://s/{n % 7}", "title": f" T{n} ", "price": f"{n}.50", "year": "2001", "is_book": True, "canonical": False, "properties": {}}
    return tuple((base | over).get(c.split()[0]) for c in ITEM.split(", "))


BATCHES = [
    [item(n, 1) for n in range(20)] + [item(40, 1, price="x"), item(41, 1, title=""), item(42, 1, price=None), item(43, 1, url="ftp://x"), item(44, 1, isbn="123", title="<b>x</b>"), item(45, 1, is_book=False), item(46, 1, canonical=True), item(47, 1, title=None, price=None)],
    [item(n, 2, title=f"New {n}", author="A" if n % 3 else None) for n in range(0, 20, 3)] + [item(3, 2, title="New 3"), item(60, 2, url="https://s/fresh")],
    [item(n, 3, price=None if n % 2 else "9", publisher="P") for n in range(4)],
]


def state(spark, catalogue):
    """Everything that the sinks hold, without the batch's paths."""
    out = {}
    for name in SINKS:
        if name != "prepared":
            rows = catalogue.sink(spark, name)
            rows = rows.drop("properties") if "properties" in rows.columns else rows
            out[name] = sorted(repr(sorted(r.asDict(recursive=True).items())) for r in rows.collect())
    return out


@pytest.fixture(scope="module")
def twin(spark, tmp_path_factory):
    """The batches one after the other, without stream or break."""
    catalogue = Catalogue(str(tmp_path_factory.mktemp("twin") / "c"), 8).create(spark)
    for n, rows in enumerate(BATCHES):
        catalogue.ingest(spark.createDataFrame(list({r[0]: r for r in reversed(rows)}.values()), ITEM), n)
    return catalogue


def test_batch(spark, twin):
    got = state(spark, twin)
    books = [r for b in BATCHES for r in b]
    urls = {(r[2], r[3]) for r in books if r[3].startswith("http") and r[4] not in (None, "") if (r[11] or "0") != "x" and r[18] and not r[19]}
    listings = twin.sink(spark, "listings").collect()
    assert {(r.shop_id, r.url) for r in listings} == urls and len(listings) == len(urls)
    assert all(r.is_active and r.in_stock and r.first_seen_at <= r.last_seen_at for r in listings)
    fresh = {(r.shop_id, r.url): r for r in listings}
    assert fresh[(0, "https://s/fresh")].last_run_id == 1 and str(fresh[(0, "https://s/0")].price) == "9.00" and fresh[(0, "https://s/0")].publisher == "P"
    changes = Counter((r.field, r.run_id) for r in twin.sink(spark, "changes").collect())
    assert changes[("publisher", 2)] == 4 and all(run > 0 for _, run in changes)
    assert len(got["prices"]) == sum(r[11] not in (None, "x") and r[3].startswith("http") and r[4] not in (None, "") and r[18] and not r[19] for b in BATCHES for r in {x[0]: x for x in b}.values())
    assert {"invalid_price", "missing_title", "invalid_url", "missing_price", "invalid_isbn", "html_in_text"} <= {r.issue for r in twin.sink(spark, "findings").collect()}


def test_counts_equal_an_aggregate(spark, twin):
    for n, rows in enumerate(BATCHES):
        want = judged(spark.createDataFrame(list({r[0]: r for r in rows}.values()), ITEM)).agg(*kind_metrics()).first().asDict()
        assert {r["name"]: r["n"] for r in twin.sink(spark, "counts").where(f"batch = {n}").collect()} == {k: v or 0 for k, v in want.items()}
    assert want.keys() == {"items", "rejected", *(f"kind_{k}" for k in KINDS), *(f"issue_{i}" for i in ISSUES)}


def stream_of(spark, tmp_path):
    folder = str(tmp_path / "in")
    for rows in BATCHES:
        spark.createDataFrame(rows, ITEM).coalesce(1).write.mode("append").parquet(folder)
    return tables.stream_table(spark, folder, ITEM)


def test_stream_equals_batch(spark, tmp_path, twin):
    catalogue = Catalogue(str(tmp_path / "c"), 8).create(spark)
    q = catalogue.stream(stream_of(spark, tmp_path), str(tmp_path / "cp"))
    q.awaitTermination(300)
    assert q.exception() is None and state(spark, catalogue) == state(spark, twin)
    seen = [p["observedMetrics"]["arrived"] for p in q.recentProgress if p["numInputRows"]]
    counts = {r["name"]: r["n"] for r in catalogue.sink(spark, "counts").groupBy("name").agg(F.sum("n").alias("n")).collect()}
    for k in ("items", *(f"kind_{x}" for x in KINDS)):
        assert sum(s[k] for s in seen) == counts[k]


@pytest.mark.parametrize("sink", ["items", "prepared", "findings"])
def test_broken_and_restarted(spark, tmp_path, twin, sink):
    """The stream dies after a sink of its second batch; a new one from the same checkpoint ends like the twin."""
    catalogue, stream, told = Catalogue(str(tmp_path / "c"), 8).create(spark), stream_of(spark, tmp_path), []

    def die(done):
        told.append(done)
        if done == sink and told.count(done) == 2:
            raise RuntimeError("killed")

    q = catalogue.stream(stream, str(tmp_path / "cp"), after=die)
    with pytest.raises(Exception, match="killed"):
        q.awaitTermination(300)
    catalogue.stream(stream, str(tmp_path / "cp")).awaitTermination(300)
    assert state(spark, catalogue) == state(spark, twin)


def test_upsert_keeps_what_a_batch_lacks(spark):
    old = spark.createDataFrame([(1, 0, "https://s/1", "T", "A")], "id long, shop_id long, url string, title string, author string")
    new = spark.createDataFrame([(0, "https://s/1", "U", None)], "shop_id long, url string, title string, author string")
    r = g.upsert_listings(old, new, F.lit(None).cast("timestamp"), F.lit(1)).first()
    assert (r.id, r.title, r.author) == (1, "U", "A")


def test_a_bucket_is_written_by_several_tasks(spark, tmp_path):
    """A bucket was one task's; now rows dealt for the join by key are written where they are, and tasks hold rows of one bucket."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        table = BucketedTable(str(tmp_path / "t"), ("k",), "k long, v string, w string", 4)
        table.create(spark.range(2000).select(F.col("id").alias("k"), F.lit("a").alias("v"), F.lit("x").alias("w")))
        table.upsert(spark.range(1000, 3000).select(F.col("id").alias("k"), F.lit("b").alias("v"), F.lit(None).cast("string").alias("w")), 1, rules)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    files = Counter(p.parent.name for p in Path(f"{table.path}.next").rglob("*.parquet"))
    assert len(files) == 4 and all(n == 3 for n in files.values())
    assert table.read(spark).groupBy("v", "w").count().orderBy("v", "w").collect() == [("a", "x", 1000), ("b", None, 1000), ("b", "x", 1000)]
    assert table.read(spark).count() == table.read(spark).select("k").distinct().count() == 3000


def test_an_ingest_joins_its_batch_once(spark, tmp_path, monkeypatch):
    plans, prepare = [], BucketedTable.prepare

    def watched(self, batch, number, rules):
        plans.append(rules(self.read(spark), batch)._jdf.queryExecution().optimizedPlan().toString())
        return prepare(self, batch, number, rules)

    monkeypatch.setattr(BucketedTable, "prepare", watched)
    row = {"item_id": "1", "at": dt.datetime(2001, 8, 1), "shop_id": 1, "url": "https://a/1", "title": "T", "price": "5", "is_book": True, "canonical": False, "properties": {}}
    Catalogue(str(tmp_path), 4).create(spark).ingest(spark.createDataFrame([row], ITEM), 0)
    assert [p.count("Join") for p in plans] == [1]
