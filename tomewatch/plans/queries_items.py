"""Ingest, merges, item folds and the batch forms of the streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest as g
from ..operators.windows import latest_per_key
from ..sources import tables as src
from ..sources.buckets import BucketedTable, work_folder
from ..streaming import ingest, jobs
from .registry import query

EVENTS_NOW = "2024-01-30 00:00:00"


def now():
    return F.lit("2001-08-01 00:00:00").cast("timestamp")


# raw items from the listings, with planted faults
_ITEM = """select id, case when id % 31 = 0 then 'ftp://x' else url end as url, case when id % 37 = 0 then '' when id % 41 = 0 then 'x' when id % 43 = 0 then '<b>' || title else '  ' || title end as title,
  author, publisher, format, case when id % 29 = 0 then 'n/a' when id % 23 = 0 then null else cast(price_cents // 100 as string) end as price,
  case when id % 19 = 0 then '1' when id % 17 = 0 then 'x' else null end as price_original, case when id % 13 = 0 then '312' else cast(year as string) end as year, case when id % 26 = 0 then '1999' else '250' end as pages,
  case when id % 11 = 0 then '9780000000000' else isbn end as isbn, in_stock from {shop_books}"""


def raw_items(t):
    sql = _ITEM.replace("price_cents // 100", "price_cents div 100")
    return t.spark.sql(sql.replace("select id,", "select id, shop_id,", 1), shop_books=t.shop_books).withColumn("properties", F.create_map(F.lit("duration"), F.lit("60"), F.lit("colour"), F.col("format")))


_BAD_PRICE, _NO_TITLE, _BAD_URL = "coalesce(price = 'n/a', false)", "title = ''", "starts_with(url, 'ftp')"
_YEAR = "cast(year as int)"
_VALIDATED = f"""with i as ({_ITEM}), v as (select *, case when {_BAD_PRICE} then 'Invalid price: n/a' when {_NO_TITLE} then 'Missing title' when {_BAD_URL} then 'Invalid URL: ftp://x' end as reject,
   case when {_YEAR} between 1800 and 2030 then {_YEAR} when cast(pages as int) between 1800 and 2030 and year is not null then cast(pages as int) end as new_year,
   case when price = 'n/a' then null else cast(price as bigint) end as p from i)"""
query("ing1_validate_items", f"{_VALIDATED} select id, reject, nullif(trim(title), '') as title, new_year as year, case when id % 11 = 0 then null else isbn end as isbn, p as price from v")(
    lambda t: g.validate_items(raw_items(t)).select("id", "reject", "title", "year", "isbn", F.col("price").cast("long").alias("price"))
)
_ISSUES = f"""{_VALIDATED}, f as (
  select 'invalid_price' as issue, {_BAD_PRICE} as hit, id from v union all select 'invalid_price_original', not {_BAD_PRICE} and price_original = 'x', id from v
  union all select 'missing_price', price is null and in_stock, id from v union all select 'zero_price', p = 0 and in_stock, id from v
  union all select 'price_higher_than_original', not {_BAD_PRICE} and price_original = '1' and p > 1, id from v union all select 'missing_title', not {_BAD_PRICE} and {_NO_TITLE}, id from v
  union all select 'invalid_year', reject is distinct from 'Invalid price: n/a' and not {_NO_TITLE} and year is not null and new_year is null, id from v
  union all select 'year_pages_swap', reject is distinct from 'Invalid price: n/a' and not {_NO_TITLE} and new_year <> {_YEAR}, id from v
  union all select 'invalid_isbn', reject is distinct from 'Invalid price: n/a' and not {_NO_TITLE} and id % 11 = 0, id from v union all select 'invalid_url', reject = 'Invalid URL: ftp://x', id from v
  union all select 'html_in_text', reject is null and title like '<b>%', id from v union all select 'suspicious_title', reject is null and length(trim(title)) < 2, id from v
  union all select 'attribute_unknown_key', reject is null, id from v)
  select id, issue from f where hit"""
query("ing2_ing5_findings", _ISSUES)(
    lambda t: g.validate_items(raw_items(t), allowed=["duration"]).select("id", F.explode("findings").alias("f")).select("id", "f.issue")
)
query("prj2_split_properties", "select event_id, event_type, user_id || '|x' as props from events")(
    lambda t: g.split_properties(
        t.events.select("event_id", F.create_map(F.lit("kind"), "event_type", F.lit("user"), F.col("user_id").cast("string"), F.lit("both"), F.lit("raw")).alias("raw"), F.create_map(F.lit("both"), F.lit("x")).alias("properties")), ["kind"]
    ).select("event_id", F.col("kind").alias("event_type"), F.concat_ws("|", F.col("properties")["user"], F.col("properties")["both"]).alias("props"))
)
query("prj1_admit_cards", "select p_partkey as id, 'https://shop.example/p/' || p_partkey as url from {part} where p_partkey % 5 <> 0 and p_partkey % 7 <> 0 and p_partkey % 3 <> 0")(
    lambda t: g.admit_cards(
        t.part.select(F.col("p_partkey").alias("id"), F.concat(F.lit("/p/"), F.col("p_partkey").cast("string")).alias("url"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_name")).alias("title"), F.when(F.col("p_partkey") % 7 != 0, 1).alias("price"), (F.col("p_partkey") % 3 == 0).alias("rejected"), F.lit(None).cast("boolean").alias("in_stock")),
        "https://shop.example",
    )[0].select("id", "url")
)

# a batch over the listings: two thirds seen again with changes, and as many new rows
_BATCH = """select shop_id, case when id % 5 = 0 then url || '-new' else url end as url, case when id % 4 = 0 then title || ' II' else title end as title, case when id % 3 = 0 then null else publisher end as publisher,
  case when id % 7 = 1 then 'A. New' else author end as author, sku from {shop_books} where id % 3 <> 1"""


def batch(t):
    return t.spark.sql(_BATCH, shop_books=t.shop_books)


query(
    "ing7_upsert_listings",
    f"""with b as ({_BATCH}) select coalesce(s.url, b.url) as url, coalesce(b.title, s.title) as title, coalesce(b.publisher, s.publisher) as publisher, coalesce(b.author, s.author) as author,
        s.url is null as created, case when b.url is not null then true else s.is_active end as is_active from {{shop_books}} s full join b on b.shop_id = s.shop_id and b.url = s.url""",
)(lambda t: g.upsert_listings(t.shop_books.withColumn("last_run_id", F.lit(1).cast("long")), batch(t), now(), F.lit(2).cast("long")).select("url", "title", "publisher", "author", "created", "is_active"))
query(
    "ing8_changes",
    f"""with b as ({_BATCH}), m as (select s.id, s.title as t0, b.title as t1, s.author as a0, coalesce(b.author, s.author) as a1 from {{shop_books}} s join b on b.shop_id = s.shop_id and b.url = s.url)
        select id as shop_book_id, 'title' as field, t0 as old_value, t1 as new_value from m where t0 is distinct from t1 union all select id, 'author', a0, a1 from m where a0 is distinct from a1""",
)(
    lambda t: g.diff(
        t.shop_books, g.upsert_listings(t.shop_books, batch(t), now(), F.lit(2)), now(), F.lit(2), fields=("title", "author", "publisher", "isbn"), scope=("shop_id",)
    ).select("shop_book_id", "field", "old_value", "new_value")
)
query("ing9_field_updates", "select l_suppkey * 1000000 + l_partkey as shop_book_id, l_returnflag as field, max(l_shipdate) as updated_at from lineitem group by 1, 2")(
    lambda t: g.field_updates(
        t.spark.createDataFrame([], src.SCHEMAS["shop_book_field_updates"]), t.lineitem.select(F.expr("l_suppkey * 1000000 + l_partkey").alias("shop_book_id"), F.col("l_returnflag").alias("field"), F.col("l_shipdate").cast("timestamp").alias("changed_at"))
    ).withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))
)
# a third of the batch comes under a new URL: found by its SKU, if it has one
query("ing6_locate", "select case when id % 3 <> 1 or sku is not null then id end as found, id as expected from {shop_books}")(
    lambda t: g.locate(t.shop_books.select("shop_id", F.expr("case when id % 3 = 1 then url || '/moved' else url end").alias("url"), "sku", F.col("id").alias("expected")), t.shop_books)[0].select(F.col("id").alias("found"), "expected")
)
query(
    "ing10_guard_drift",
    "select id, case when book_id is null or isbn is null or exists (select 1 from {book_isbns} i where i.book_id = b.book_id and i.isbn = b.isbn) then book_id end as book_id from {shop_books} b",
)(lambda t: g.guard_drift(t.shop_books, t.book_isbns).select("id", "book_id"))
query("ing11_price_rows", "select id as shop_book_id, price_cents as cents from {shop_books} where price_cents is not null")(
    lambda t: g.price_rows(
        t.shop_books.select("id", (F.col("price_cents") / 100).cast("decimal(10,2)").alias("price"), F.lit(None).cast("decimal(10,2)").alias("price_original"), "in_stock"), now(), F.lit(1)
    ).select("shop_book_id", (F.col("price") * 100).cast("long").alias("cents"))
)
query("ing12_merge_attributes", "select id as shop_book_id, 'format' as key, case when id % 2 = 0 then 'new' else format end as value from {shop_books} where format is not null or id % 2 = 0")(
    lambda t: g.merge_attributes(
        t.shop_books.where("format is not null").select("shop_id", F.col("id").alias("shop_book_id"), F.lit("format").alias("key"), F.col("format").alias("value")),
        t.shop_books.where("id % 2 = 0").select("shop_id", "id", F.create_map(F.lit("format"), F.lit("new")).alias("properties")), ("shop_id",),
    ).drop("shop_id")
)
query("ing13_sync_authors", "select id as shop_book_id, lower(author) as name, 0 as position from {shop_books} where author is not null union all select id, 'other name', 1 from {shop_books} where author is not null")(
    lambda t: (
        lambda authors, bridge: bridge.join(authors.select(F.col("id").alias("author_id"), F.col("normalized_name").alias("name")), "author_id").select("shop_book_id", "name", "position")
    )(*g.sync_authors(t.shop_books.select("shop_id", "id", F.concat("author", F.lit(" & Other  Name; "), "author").alias("author")), t.spark.createDataFrame([], src.SCHEMAS["shop_authors"]), t.spark.createDataFrame([], src.SCHEMAS["shop_book_authors"]).withColumn("shop_id", F.lit(None).cast("long")), ("shop_id",)))
)
query(
    "ing15_link_urls",
    "select id, case when shop_book_id % 4 = 0 and type in ('unknown', 'unreachable', 'partial') then case when shop_book_id % 8 = 0 then 'product' else 'partial' end else type end as type, case when shop_book_id % 4 = 0 then 0 else fail_count end as fail_count from {discovered_urls}",
)(lambda t: g.link_urls(t.discovered_urls, t.discovered_urls.where("shop_book_id % 4 = 0").select("shop_id", "normalized_url", (F.col("shop_book_id") % 8 == 0).alias("complete"))).select("id", "type", "fail_count"))
query("ing16_mark_non_product", "select id, case when shop_book_id % 4 = 0 and type <> 'product' then 'non_product' else type end as type, case when shop_book_id % 4 = 0 then 0 else fail_count end as fail_count, case when shop_book_id % 4 = 0 then timestamp '2001-08-01' else last_checked_at end as last_checked_at from {discovered_urls}")(
    lambda t: g.mark_non_product(t.discovered_urls, t.discovered_urls.where("shop_book_id % 4 = 0").withColumn("at", now())).select("id", "type", "fail_count", F.col("last_checked_at").cast("timestamp_ntz").alias("last_checked_at"))
)
query(
    "ing16_classifications",
    """select id as discovered_url_id, cast(max(shop_book_id % 50) over (partition by shop_id, normalized_url) as integer) as book_score, false as is_book_product, '[{"key":"no_isbn","points":' || max(shop_book_id % 50) over (partition by shop_id, normalized_url) || '}]' as reasons
       from {discovered_urls} where shop_book_id % 4 = 0""",
)(
    lambda t: g.classifications(
        t.discovered_urls, t.discovered_urls.where("shop_book_id % 4 = 0").withColumn("score", F.expr("cast(shop_book_id % 50 as int)")).withColumn("reasons", F.expr("array(named_struct('key', 'no_isbn', 'points', score))")).withColumn("at", now())
    ).drop("classified_at")
)
query(
    "ing17_record_failures",
    "select id, fail_count + case when shop_book_id % 4 = 0 then 2 else 0 end as fail_count, case when shop_book_id % 4 = 0 and fail_count + 2 >= 3 and type <> 'non_product' then 'unreachable' else type end as type from {discovered_urls}",
)(lambda t: g.record_failures(t.discovered_urls, t.discovered_urls.where("shop_book_id % 4 = 0").select("shop_id", "normalized_url", F.explode(F.array(F.lit(1), F.lit(2)))))[0].select("id", "fail_count", "type"))
# a library record for every part: two thirds find a work by an ISBN, some by their code only, the rest are new
_RECORDS = """select concat('L', cast(p.p_partkey as string)) as libis_code, upper(p.p_name) as title, case when p.p_partkey % 4 <> 0 then cast(1900 + p.p_size as int) end as year, case when p.p_partkey % 3 = 0 then 'New House' end as publisher,
  case when p.p_partkey % 7 = 0 then null when p.p_partkey % 2 = 0 then i.isbn10 else i.isbn13 end as isbn, i.isbn10, i.isbn13, p.p_partkey as k from {part} p join {part_isbn} i on i.p_partkey = p.p_partkey"""
_KNOWN = "select id, title, year, case when id % 9 = 0 then null else publisher end as publisher, data_source, case when id % 14 = 0 then concat('L', cast(id as string)) end as libis_code from {books}"
_RESOLVED = f"""with r as ({_RECORDS}), k as ({_KNOWN}), o as (select isbn, min(book_id) as book_id from {{book_isbns}} group by isbn),
  a as (select r.libis_code, min(o.book_id) as book_id from r join o on r.isbn is not null and o.isbn in (r.isbn10, r.isbn13) group by 1),
  m as (select r.*, coalesce(a.book_id, k.id) as book_id from r left join a on a.libis_code = r.libis_code left join k on k.libis_code = r.libis_code),
  w as (select book_id, max(libis_code) as libis_code, arg_max(title, libis_code) as title, arg_max(year, libis_code) as year, arg_min(publisher, libis_code) as publisher from m where book_id is not null group by 1)"""


def upserted(t):
    records = t.spark.sql(_RECORDS, part=t.part, part_isbn=t.part_isbn).select("libis_code", "title", "year", "publisher", F.expr("case when isbn is null then cast(array() as array<string>) else array(isbn) end").alias("isbns"))
    return g.upsert_works(t.spark.sql(_KNOWN, books=t.books), t.book_isbns, records)


query(
    "ing18_upsert_works",
    f"""{_RESOLVED} select k.id, coalesce(w.title, k.title) as title, coalesce(w.year, k.year) as year, coalesce(k.publisher, w.publisher) as publisher, case when w.book_id is not null then 'library' else k.data_source end as data_source,
        coalesce(w.libis_code, k.libis_code) as libis_code from k left join w on w.book_id = k.id union all select null, title, year, publisher, 'library', libis_code from m where book_id is null""",
)(lambda t: upserted(t)[0].select(F.when(F.col("id").isin(0) | (F.abs("id") < 10**9), F.col("id")).alias("id"), "title", "year", "publisher", "data_source", "libis_code"))
query(
    "ing18_upsert_isbns",
    f"""{_RESOLVED}, n as (select isbn, min(coalesce(cast(book_id as varchar), libis_code)) as owner from (select book_id, libis_code, unnest([isbn10, isbn13]) as isbn from m where isbn is not null) z group by 1)
        select i.isbn, coalesce(n.owner, cast(i.book_id as varchar)) as owner, i.isbn_type from {{book_isbns}} i left join n on n.isbn = i.isbn union all select isbn, owner, 'isbn' || length(isbn) from n where isbn not in (select isbn from {{book_isbns}})""",
)(
    lambda t: (lambda works, isbns: isbns.join(works.select(F.col("id").alias("book_id"), "libis_code"), "book_id", "left").select("isbn", F.when(F.abs("book_id") < 10**9, F.col("book_id").cast("string")).otherwise(F.col("libis_code")).alias("owner"), "isbn_type"))(*upserted(t))
)
query("ing19_merge_authors", "select normalized_name, 'c' || id as code from {authors} union all select 'new author', null")(
    lambda t: g.merge_authors(
        t.authors.withColumn("code", F.lit(None).cast("string")),
        t.authors.select(F.upper("name").alias("name"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("code")).union(t.spark.range(1).select(F.lit("New, Author"), F.lit(None).cast("string"))),
    ).select("normalized_name", "code")
)
query("ing20_find_or_create", "select distinct publisher as name from {books} union select 'Other' as name")(
    lambda t: g.find_or_create(t.books.select(F.col("publisher").alias("name")).distinct().withColumn("id", F.xxhash64("name")).select("id", "name").where("name <> 'Publisher 3'"), t.books.select(F.col("publisher").alias("name")).union(t.spark.range(1).select(F.lit("Other")))).select("name")
)
query("ing21_add_works", "select i.p_partkey as id from {part_isbn} i where i.isbn13 not in (select isbn from {book_isbns}) and i.isbn10 not in (select isbn from {book_isbns})")(
    lambda t: g.add_works(t.part_isbn.select(F.col("p_partkey").alias("id"), F.col("isbn10").alias("isbn")), t.book_isbns)[0].select("id")
)
_KIND = "case event_type when 'view' then 'enqueue' when 'click' then 'claim' when 'purchase' then 'done' when 'error' then 'failed' else 'retry' end"
query(
    "ing22_fold_items",
    f"""with e as (select user_id as run_id, cast(event_id % 40 as string) as url, {_KIND} as kind, ts as seen from events)
        select run_id, url, coalesce(arg_min(kind, seen) filter (where kind in ('done', 'failed')), case when count(*) filter (where kind = 'claim') > 0 then 'processing' else 'pending' end) as status,
        count(*) filter (where kind = 'claim') as attempts, count(*) filter (where kind = 'retry') as retry_count from e group by 1, 2""",
)(
    lambda t: g.fold_items(
        t.events.select(F.col("user_id").alias("run_id"), (F.col("event_id") % 40).cast("string").alias("url"), F.expr(_KIND).alias("kind"), F.col("ts").alias("at"), F.lit("r").alias("reason"))
    ).select("run_id", "url", "status", "attempts", "retry_count")
)
query(
    "ing23_retry_items",
    """select i.run_id, i.item_id from (select distinct run_id, item_id from {scrape_failures}) i join (select *, row_number() over (partition by run_id, item_id order by failed_at desc, id desc) as k from {scrape_failures}) f
       on f.run_id = i.run_id and f.item_id = i.item_id and f.k = 1 where f.error_reason = 'timeout' and f.http_status is null""",
)(
    lambda t: g.retry_items(
        t.scrape_failures.select("run_id", "item_id").distinct().withColumn("status", F.lit("failed")),
        latest_per_key(t.scrape_failures, ["run_id", "item_id"], [F.desc("failed_at"), F.desc("id")]), "timeout", None,
    ).select("run_id", "item_id")
)
query("ing24_retryable", "select run_id, item_key from {scrape_url_items} where status = 'failed' and attempts < 3")(
    lambda t: g.retryable_items(t.scrape_url_items.withColumn("reason", F.lit("timeout"))).select("run_id", "item_key")
)
query("ing25_route", "select case when p_partkey % 10 = 0 then 'canonical' when p_partkey % 7 = 0 then 'url' when p_partkey % 3 = 0 then 'non_product' else 'book' end as kind, count(*) as n from {part} group by 1")(
    lambda t: g.route(t.part.select((F.col("p_partkey") % 10 == 0).alias("canonical"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_name")).alias("title"), F.lit(None).alias("price"), (F.col("p_partkey") % 3 != 0).alias("is_book")))
    .groupBy("kind").agg(F.count("*").alias("n"))
)


# the batch of ing7 into a table on disk: only the buckets that it touches are written again
def bucketed(t):
    columns = ["shop_id", "url", "title", "publisher", "author", "sku"]
    t = t.keep("shop_books", columns=("id", *columns))
    table = BucketedTable(work_folder(t.spark), ("shop_id", "url"), "shop_id long, url string, title string, publisher string, author string, sku string", 32).create(t.shop_books.select(columns))
    table.upsert(batch(t), 1, lambda old, new: src.merge(old, new, ["shop_id", "url"], overwrite=["title"]))
    return table.read(t.spark)


query(
    "snk2_bucketed_upsert",
    f"""with b as ({_BATCH}) select coalesce(s.shop_id, b.shop_id) as shop_id, coalesce(s.url, b.url) as url, coalesce(b.title, s.title) as title, coalesce(b.publisher, s.publisher) as publisher, coalesce(b.author, s.author) as author,
        coalesce(b.sku, s.sku) as sku from {{shop_books}} s full join b on b.shop_id = s.shop_id and b.url = s.url""",
)(bucketed)


def arriving(rows, wave):
    """The raw items as they arrive: all of them in wave 1; in wave 2 every fourth under a new title, each twice."""
    rows = rows.select(
        F.concat_ws("-", "shop_id", "url", "id", F.lit(wave)).alias("item_id"), F.lit(f"2001-08-0{wave} 00:00:00").cast("timestamp").alias("at"), "shop_id", "url",
        (F.col("title") if wave == 1 else F.concat("title", F.when(F.col("title") != "", " II").otherwise(""))).alias("title"), "author", (F.col("publisher") if wave == 1 else F.lit(None).cast("string")).alias("publisher"),
        *[F.lit(None).cast("string").alias(c) for c in ("format", "type", "sku")], "isbn", "price", "price_original", "year", "pages", *[F.lit(None).cast("string").alias(c) for c in ("description", "image_url")],
        "in_stock", (F.col("id") % 6 != 5).alias("is_book"), F.lit(False).alias("canonical"), "properties", "id",
    )
    again = rows.where("id % 4 = 0")
    return (rows if wave == 1 else again.union(again)).drop("id")


def streamed(t):
    folder = work_folder(t.spark)
    catalogue = ingest.Catalogue(folder, 32).create(t.spark)
    # an id that listings of two sources share arrives from both
    t = t.keep("shop_books")
    rows = raw_items(t).drop("shop_id").join(t.shop_books.select("id", "shop_id"), "id")
    for wave in (1, 2):
        arriving(rows, wave).write.mode("append").parquet(f"{folder}/in")
    query = catalogue.stream(src.stream_table(t.spark, f"{folder}/in", ingest.ITEM, 64), f"{folder}/checkpoint")
    query.awaitTermination()
    seen = catalogue.sink(t.spark, "prices").groupBy(F.col("shop_book_id").alias("id")).agg(F.count("*").alias("n_prices"))
    rows = catalogue.sink(t.spark, "listings").join(seen, "id", "left")
    return rows.select("shop_id", "url", "title", "publisher", "year", "isbn", (F.col("price") * 100).cast("long").alias("price_cents"), F.coalesce("n_prices", F.lit(0)).alias("n_prices"))


query(
    "st1_ingest_stream",
    f"""{_VALIDATED}, s as (select v.*, b.shop_id from v join {{shop_books}} b on b.id = v.id where reject is null and v.id % 6 <> 5)
        select shop_id, url, trim(title) || case when id % 4 = 0 then ' II' else '' end as title, publisher, new_year as year, case when id % 11 = 0 then null else isbn end as isbn, p * 100 as price_cents,
        case when p is null then 0 when id % 4 = 0 then 2 else 1 end as n_prices from s""",
)(streamed)


def item_counts(t):
    counts = ingest.counted(ingest.judged(arriving(raw_items(t), 1)), lambda df: df.write.format("noop").mode("overwrite").save())
    return t.spark.createDataFrame(list(counts.items()), "name string, n long").where("n > 0")


query(
    "ing25_counts",
    f"""{_VALIDATED}, b as (select * from v where id % 6 <> 5), f as (select issue as name, count(*) as n from ({_ISSUES[_ISSUES.index("  select 'invalid_price'"):_ISSUES.index(" union all select 'attribute_unknown_key'")].replace("from v", "from b")}) z where hit group by 1)
        select 'issue_' || name as name, n from f union all select 'items', count(*) from v union all select 'kind_book', count(*) from b union all select 'kind_non_product', count(*) from v where id % 6 = 5
        union all select 'rejected', count(*) from b where reject is not null""",
)(item_counts)

query("st2_rate", "select date_trunc('hour', ts) as start, count(*) as n from events group by 1")(lambda t: jobs.rate(t.events, size="1 hour", step="1 hour").withColumn("start", F.col("start").cast("timestamp_ntz")))
query("st2_trailing_rate", f"select count(*) as n from events where ts > timestamp '{EVENTS_NOW}' - interval 86400 second and ts <= timestamp '{EVENTS_NOW}'")(lambda t: jobs.trailing_rate(t.events, EVENTS_NOW, 86400))
query("st3_eta", "select p.run_id, case when d.n > 0 then greatest(1, cast(ceil(p.n * 1.0 / d.n) as bigint)) end as eta_minutes from (select run_id, count(*) as n from {scrape_url_items} where status = 'pending' group by 1) p left join (select run_id, count(*) as n from {scrape_url_items} where status = 'done' group by 1) d on d.run_id = p.run_id")(
    lambda t: jobs.eta_minutes(t.scrape_url_items.where("status = 'pending'").groupBy("run_id").agg(F.count("*").alias("pending")), t.scrape_url_items.where("status = 'done'").groupBy("run_id").agg(F.count("*").alias("n")))
)
query("st4_silent", f"select user_id, max(ts) as last_seen from events group by 1 having max(ts) < timestamp '{EVENTS_NOW}' - interval 43200 second")(
    lambda t: jobs.silent(t.events, EVENTS_NOW, 43200).withColumn("last_seen", F.col("last_seen").cast("timestamp_ntz"))
)
_RUNS = """select id, shop_id, phase, case when status = 'failed' and id % 5 = 0 then 'stopping' when status = 'running' and id % 3 = 0 then 'paused' else status end as status, close_reason,
  cast(started_at as timestamp) as started_at, case when id % 7 <> 0 then cast(started_at as timestamp) + interval 50 second end as last_heartbeat from {scrape_runs}"""
_REAP = "1998-07-01 00:00:00"
query(
    "st4_reap_runs",
    f"""with r as ({_RUNS}), d as (select *, status in ('running', 'stopping', 'paused') and coalesce(last_heartbeat, started_at) < timestamp '{_REAP}' - case when status = 'paused' then interval 604800 second else interval 60 second end as dead from r)
        select id, case when dead then 'failed' else status end as status, case when dead then case status when 'paused' then 'paused_timeout' when 'stopping' then 'stop_timeout' else 'heartbeat_timeout' end else close_reason end as close_reason, dead as reaped from d""",
)(lambda t: jobs.reap_runs(t.spark.sql(_RUNS, scrape_runs=t.scrape_runs), _REAP).select("id", "status", "close_reason", "reaped"))
query(
    "st4_stuck_items",
    f"""with r as ({_RUNS}), i as (select run_id, item_key, status, cast(finished_at as timestamp) as claimed_at from {{scrape_url_items}})
        select i.run_id, i.item_key, case when r.status in ('running', 'paused') then 'stuck_in_processing' else 'run_aborted' end as error_reason from i join r on r.id = i.run_id
        where i.status = 'processing' and (r.status not in ('running', 'paused') or i.claimed_at < timestamp '{_REAP}' - interval 120 second)""",
)(
    lambda t: jobs.stuck_items(t.scrape_url_items.withColumn("claimed_at", F.col("finished_at").cast("timestamp")), t.spark.sql(_RUNS, scrape_runs=t.scrape_runs), _REAP).select("run_id", "item_key", "error_reason")
)
query("st5_fold_runs", "select user_id as run_id, coalesce(arg_min(event_type, ts) filter (where event_type in ('completed', 'error')), 'running') as status, min(ts) as started_at from events group by 1")(
    lambda t: jobs.fold_runs(t.events.select(F.col("user_id").alias("run_id"), F.col("ts").alias("at"), F.when(F.col("event_type") == "error", "failed").otherwise(F.col("event_type")).alias("kind"), F.lit("r").alias("reason")))
    .select("run_id", F.when(F.col("status") == "failed", "error").otherwise(F.col("status")).alias("status"), F.col("started_at").cast("timestamp_ntz").alias("started_at"))
)
query(
    "st6_failure_streaks",
    """with e as (select user_id, event_type = 'error' as failed, count(*) filter (where event_type <> 'error') over (partition by user_id order by ts, event_id rows unbounded preceding) as g from events)
       select user_id, count(*) filter (where failed) as streak, count(*) filter (where failed) >= 3 as unreachable from e where g = (select max(g) from e x where x.user_id = e.user_id) group by 1""",
)(lambda t: jobs.failure_streaks(t.events.withColumn("failed", F.col("event_type") == "error")))
query("st9_in_flight", "select run_id, item_key, cast(epoch(timestamp '2001-12-31') - epoch(finished_at) as bigint) as age_seconds from {scrape_url_items} where status = 'processing' order by 3 desc, item_key limit 50")(
    lambda t: jobs.in_flight(t.scrape_url_items.withColumn("started_at", F.col("finished_at")), "2001-12-31 00:00:00").select("run_id", "item_key", "age_seconds")
)
query(
    "st5_aborted_items",
    "select i.run_id, i.item_key, case when r.status <> 'running' and i.status = 'processing' then 'failed' else i.status end as status from {scrape_url_items} i left join {scrape_runs} r on r.id = i.run_id",
)(
    lambda t: jobs.aborted_items(t.scrape_url_items, t.scrape_runs.select(F.col("id").alias("run_id"), "status", F.col("started_at").alias("finished_at")))[0].select("run_id", "item_key", "status")
)
query(
    "jn11_latest_failure",
    """with l as (select *, row_number() over (partition by run_id, item_id order by failed_at desc, id desc) as k from {scrape_failures}), i as (select distinct user_id as item_id, user_id % 20 as run_id from events)
       select i.run_id, i.item_id, l.error_reason, l.http_status from i left join l on l.run_id = i.run_id and l.item_id = i.item_id and l.k = 1""",
)(lambda t: g.latest_failures(t.events.select(F.col("user_id").alias("item_id"), (F.col("user_id") % 20).alias("run_id")).distinct(), t.scrape_failures))
query(
    "ing14_merge_urls",
    """with b as (select shop_id, case when id % 3 = 0 then url || '-x' else url end as url, case when id % 2 = 0 then id end as book from {shop_books} where id % 53 <> 0)
       select coalesce(u.normalized_url, b.url) as url, case when coalesce(u.type, 'unknown') = 'unknown' and coalesce(b.book, u.shop_book_id) is not null then 'product' else coalesce(u.type, 'unknown') end as type, u.id is null as created
       from {discovered_urls} u full join b on b.shop_id = u.shop_id and b.url = u.normalized_url""",
)(
    lambda t: g.merge_urls(
        t.discovered_urls.withColumn("last_seen_at", F.lit(None).cast("timestamp")).withColumn("first_seen_at", F.lit(None).cast("timestamp")),
        t.shop_books.where("id % 53 <> 0").select("shop_id", F.when(F.col("id") % 3 == 0, F.concat("url", F.lit("-x"))).otherwise(F.col("url")).alias("url"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("shop_book_id")), now(), F.lit(2),
    ).select(F.col("normalized_url").alias("url"), "type", "created")
)
query(
    "ing26_retries",
    "select i.run_id, i.item_key, cast(count(r.l_orderkey) as int) as retry_count from (select distinct run_id, item_key from {scrape_url_items}) i left join lineitem r on r.l_orderkey = i.run_id and r.l_linenumber * 10000000000 + r.l_partkey * 10000 + r.l_suppkey = i.item_key and r.l_returnflag = 'R' group by 1, 2",
)(
    lambda t: g.apply_retries(
        t.scrape_url_items.select("run_id", "item_key").distinct().withColumn("retry_count", F.lit(0)),
        t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("run_id"), F.expr("l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey").alias("item_key"), F.lit(1).alias("attempt"), F.lit("r").alias("reason"), F.col("l_shipdate").alias("at")),
    )[0]
)
