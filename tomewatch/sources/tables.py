"""Catalogue tables: explicit schemas, reads in batch and stream, appends, keyed merges and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of every stored table, never inferred. Money is decimal, times are UTC.
SCHEMAS = {
    "shops": "id long, name string, trust int",
    "discovered_urls": "id long, shop_id long, url string, normalized_url string, type string, fail_count int, shop_book_id long, first_seen_at timestamp, last_seen_at timestamp, last_checked_at timestamp, last_run_id long",
    "url_classifications": "discovered_url_id long, score int, reasons array<struct<key: string, points: int>>",
    "shop_books": "id long, shop_id long, url string, title string, author string, sku string, isbn string, publisher string, year int, format string, type string, description string, image_url string, price decimal(10,2), price_original decimal(10,2), in_stock boolean, is_active boolean, categories array<string>, book_id long, match_status string, match_method string, first_seen_at timestamp, last_seen_at timestamp, last_run_id long",
    "prices": "shop_book_id long, price decimal(10,2), price_original decimal(10,2), discount_pct decimal(5,2), in_stock boolean, run_id long, observed_at timestamp",
    "shop_book_changes": "shop_book_id long, field string, old_value string, new_value string, changed_at timestamp, run_id long",
    "shop_book_field_updates": "shop_book_id long, field string, updated_at timestamp",
    "shop_book_attributes": "shop_book_id long, key string, value string",
    "shop_authors": "id long, name string, normalized_name string",
    "shop_book_authors": "shop_book_id long, author_id long, position int",
    "books": "id long, title string, year int, publisher_id long, libis_code string, data_source string, languages array<string>",
    "book_isbns": "book_id long, isbn string, isbn_type string",
    "authors": "id long, name string, normalized_name string, libis_code string",
    "book_authors": "book_id long, author_id long, role string, position int",
    "publishers": "id long, name string",
    "scrape_runs": "id long, shop_id long, phase string, status string, started_at timestamp, finished_at timestamp, heartbeat_at timestamp, urls_total long, urls_processed long, error_count long, close_reason string",
    "scrape_url_items": "run_id long, url string, status string, attempts int, retry_count int, error_reason string, started_at timestamp, finished_at timestamp",
    "scrape_failures": "id long, run_id long, url string, error_reason string, http_status int, acknowledged boolean, failed_at timestamp",
    "scrape_run_events": "run_id long, event_type string, payload string, created_at timestamp",
    "validation_issues": "shop_id long, entity string, field string, issue string, url string, raw_value string, first_run int, last_run int, run_count int, state string, snoozed_until timestamp, acknowledged_at timestamp, resolved_at timestamp",
    "pages": "page_id long, url string, html string",
}
# The order in which the closed vocabularies are declared, where that order sorts.
ISBN_TYPES = ("isbn10", "isbn13", "ebook", "audio", "unknown")
LIFECYCLE = ("new", "acknowledged", "snoozed", "resolved")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stored table with its declared schema."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def read_jdbc(spark: SparkSession, url: str, name: str, partition_column: str, low: int, high: int, parts: int) -> DataFrame:
    """The same table from a database, read in ``parts`` ranges of a numeric column."""
    options = {"url": url, "dbtable": name, "partitionColumn": partition_column, "lowerBound": low, "upperBound": high, "numPartitions": parts}
    return spark.read.format("jdbc").options(**options).load()


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMAS["pages"]).parquet(path)


def stream_table(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """New Parquet files of a folder as micro-batches."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def append(df: DataFrame, path: str, date_col: str) -> None:
    """Append observations, partitioned by day."""
    df.withColumn("day", F.to_date(date_col)).write.mode("append").partitionBy("day").parquet(path)


def merge(target: DataFrame, source: DataFrame, keys: list[str], overwrite: list[str] = (), keep: list[str] = ()) -> DataFrame:
    """The snapshot of ``target`` after an upsert of ``source``, with ``created`` telling new rows.

    Columns in ``overwrite`` always take the source's value, those in ``keep`` only fill nulls, and all others
    take the source's value unless it is null. Rows of the target that the source lacks stay. ``source`` has one
    row a key. Plain Parquet has no update in place: write the snapshot to a new folder.
    """
    s = source.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in source.columns if c not in keys], F.lit(True).alias("_src"))
    both = target.withColumn("_tgt", F.lit(True)).join(s, keys, "full")

    def value(c: str) -> Column:
        if c not in source.columns:
            return F.col(c)
        if c in overwrite:
            return F.when(F.col("_src"), F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c)
        order = (c, f"_s_{c}") if c in keep else (f"_s_{c}", c)
        return F.coalesce(*order).alias(c)

    out = [F.col(k) for k in keys] + [value(c) for c in target.columns if c not in keys]
    return both.select(*out, (F.col("_tgt").isNull() & F.col("_src")).alias("created"))


def export_rows(df: DataFrame) -> DataFrame:
    """Eleven text columns of an export: yes/no flags, blank nulls and zero prices, whole prices as 40.0."""
    price = F.when(F.coalesce("price_cents", F.lit(0)) == 0, "").when(F.col("price_cents") % 100 == 0, F.concat(F.expr("price_cents div 100").cast("string"), F.lit(".0")))
    price = price.otherwise(F.regexp_replace(F.concat(F.expr("price_cents div 100").cast("string"), F.lit("."), F.lpad((F.col("price_cents") % 100).cast("string"), 2, "0")), "0$", ""))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    flag = lambda c: F.when(F.col(c), "yes").otherwise("no").alias(c)
    return df.select(*[text(c) for c in ("id", "title", "author", "publisher", "year", "isbn", "format", "type")], price.alias("price"), flag("in_stock"), flag("is_active"))


def export_csv(df: DataFrame, path: str) -> None:
    """``export_rows`` sorted by title and id, with CRLF line ends and a header per file."""
    export_rows(df.orderBy("title", "id")).write.mode("overwrite").csv(path, header=True, lineSep="\r\n", emptyValue="", quoteAll=False)


def url_batches(df: DataFrame, size: int = 500) -> DataFrame:
    """URLs of each source in batches of about ``size``, listed in order of id; no batch grows with its source."""
    sized = df.groupBy("shop_id").agg(F.count("*").alias("_n"))
    dealt = df.join(sized, "shop_id").withColumn("batch", F.pmod(F.xxhash64("id"), F.ceil(F.col("_n") / size)))
    return dealt.groupBy("shop_id", "batch").agg(F.array_sort(F.collect_list(F.struct("id", "url"))).alias("urls"))
