"""Ingest of item batches end to end: route and validate, merge into the listings, append changes, prices and findings.

A batch goes to five sinks under its number. The items themselves come first, in one pass that also counts them; the
listings' touched buckets are prepared next, then what follows from old and new rows, and the listings are replaced last.
Each sink after the items is written once and found complete when the batch is run again, so a run that breaks off between any two of
them and starts anew ends as if it had not.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest as g
from ..sources.buckets import BucketedTable, is_complete, write_once
from ..sources.tables import SCHEMAS

KINDS = ("url", "non_product", "canonical", "book")
ISSUES = (
    "invalid_price", "invalid_price_original", "missing_price", "zero_price", "price_higher_than_original", "missing_title", "invalid_year", "year_pages_swap", "invalid_isbn", "invalid_url",
    "html_in_text", "suspicious_title", "format_mismatch", "attribute_unknown_key", "attribute_invalid_value",
)
#: An item as it arrives; all that validation reads is text.
ITEM = (
    "item_id string, at timestamp, shop_id long, url string, title string, author string, publisher string, format string, type string, sku string, isbn string, price string, price_original string, year string,"
    " pages string, description string, image_url string, in_stock boolean, is_book boolean, canonical boolean, properties map<string,string>"
)
SINKS = ("items", "counts", "prepared", "changes", "prices", "findings", "listings")


def kind_metrics() -> list[Column]:
    """Items per kind, rejected ones, and findings per issue, as aggregates over ``judged`` items."""
    kinds = [F.count_if(F.col("kind") == k).alias(f"kind_{k}") for k in KINDS]
    times = lambda i: F.size(F.filter("findings", lambda f: f["issue"] == i))
    issues = [F.coalesce(F.sum(times(i)), F.lit(0)).alias(f"issue_{i}") for i in ISSUES]
    return [F.count("*").alias("items"), *kinds, F.count_if(F.col("reject").isNotNull()).alias("rejected"), *issues]


def judged(items: DataFrame) -> DataFrame:
    """Items with their ``kind``; books validated, with ``reject`` and ``findings``. Other kinds pass with neither."""
    routed = g.route(items)
    checked = g.validate_items(routed)
    book = F.col("kind") == "book"
    none = F.array().cast(checked.schema["findings"].dataType)
    return checked.withColumn("reject", F.when(book, F.col("reject"))).withColumn("findings", F.when(book, F.col("findings")).otherwise(none))


def counted(items: DataFrame, write: Callable[[DataFrame], object]) -> dict[str, int]:
    """``write(items)`` and the ``kind_metrics`` of what it wrote, observed in the same pass."""
    seen = Observation("kinds")
    write(items.observe(seen, *kind_metrics()))
    return {k: int(v or 0) for k, v in seen.get.items()}


@dataclass(frozen=True)
class Catalogue:
    """Where the sinks lie: the listings as a bucketed table, all else by batch number."""

    folder: str
    buckets: int = 64

    @property
    def listings(self) -> BucketedTable:
        return BucketedTable(f"{self.folder}/listings", ("shop_id", "url"), SCHEMAS["shop_books"], self.buckets)

    def create(self, spark: SparkSession) -> Catalogue:
        self.listings.create(spark.createDataFrame([], SCHEMAS["shop_books"]))
        return self

    def sink(self, spark: SparkSession, name: str) -> DataFrame:
        """What has been written to a sink by all batches, with their number."""
        return self.listings.read(spark) if name == "listings" else spark.read.option("basePath", f"{self.folder}/{name}").parquet(f"{self.folder}/{name}")

    def ingest(self, items: DataFrame, number: int, after: Callable[[str], None] = lambda sink: None) -> None:
        """One batch of ``ITEM`` rows into all sinks; ``after`` is told each sink that is done. Times and runs come from the items.

        Of a batch's rows for one listing the last value of each column stands, nulls aside; every admitted row with a
        price is an observation. Rejected items leave findings only, items of other kinds are kept among the items.
        """
        spark, run = items.sparkSession, F.lit(number).cast("long")
        path = f"{self.folder}/items/batch={number}"
        kinds = judged(items)
        # written each time: a batch that runs again must read all of its stream, or the state of dropped repeats is lost
        counts = counted(kinds, lambda df: df.write.mode("overwrite").parquet(path))
        stored = spark.read.schema(kinds.schema).parquet(path)
        after("items")
        if not counts["items"]:
            return  # a stream closes its watermark with an empty batch
        write_once(spark.createDataFrame(list(counts.items()), "name string, n long"), f"{self.folder}/counts", number)
        after("counts")
        books = stored.where("kind = 'book' and reject is null")
        columns = [c for c in ("title", "author", "publisher", "format", "type", "sku", "isbn", "price", "price_original", "year", "description", "image_url", "in_stock") if c in stored.columns]
        batch = g.fold_batch(books.select("shop_id", "url", "at", "item_id", *columns).withColumn("_order", F.struct("at", "item_id")).drop("item_id"), ["shop_id", "url"], "_order")

        def rules(old: DataFrame, new: DataFrame) -> DataFrame:
            return g.upsert_listings(old, new, F.col("at"), run)

        prepared = self.listings.prepare(batch, number, rules)
        after("prepared")
        changes, prices, findings = (f"{self.folder}/{x}" for x in ("changes", "prices", "findings"))
        if not is_complete(spark, f"{changes}/batch={number}"):
            hit = [r[0] for r in prepared.select("bucket").distinct().collect()]
            moved = g.diff(self.listings.read(spark, hit), prepared, F.lit(None).cast("timestamp"), run).drop("changed_at")
            write_once(moved.join(prepared.select(F.col("id").alias("shop_book_id"), F.col("last_seen_at").alias("changed_at")), "shop_book_id"), changes, number)
        after("changes")
        ids = prepared.select("shop_id", "url", "id")
        write_once(g.price_rows(books.join(ids, ["shop_id", "url"]).withColumn("in_stock", F.coalesce("in_stock", F.lit(True))), F.col("at"), run), prices, number)
        after("prices")
        found = stored.where("size(findings) > 0").select("shop_id", "url", F.inline("findings"), run.alias("run_id"), F.col("at").alias("observed_at"))
        write_once(found, findings, number)
        after("findings")
        self.listings.apply(prepared)
        after("listings")

    def stream(self, items: DataFrame, checkpoint: str, late: str = "1 hour", after: Callable[[str], None] = lambda sink: None):
        """Ingest a stream of items; an item that arrives again within ``late`` of event time is dropped. Progress carries the counts as ``kinds``."""
        once = items.withWatermark("at", late).dropDuplicatesWithinWatermark(["item_id"])
        seen = once.observe("arrived", F.count("*").alias("items"), *[F.count_if(g.kind_of() == k).alias(f"kind_{k}") for k in KINDS])
        return seen.writeStream.foreachBatch(lambda df, n: self.ingest(df, n, after)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
