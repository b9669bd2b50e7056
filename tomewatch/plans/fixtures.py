"""The catalogue tables presented from the driver's tables, as one SQL text that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Bytes of the line items' files in a piece, which one task takes at a time. Pieces go by bytes, not by file splits: these differ
#: between sessions, and with many small ones the driver's tasks and the blocks of a shuffle would grow with their square.
PIECE = 4 << 20
#: Rows take some ten times their bytes in Parquet. Spark would else take a table of millions of rows for a small one and gather it on
#: the driver to broadcast it.
COMPRESSION = 10.0
BASE = "region nation customer supplier part orders lineitem events documents pages".split()

_DIGIT_SUM13 = " + ".join(f"cast(substr(body, {k + 1}, 1) as int) * {1 if k % 2 == 0 else 3}" for k in range(12))
_DIGIT_SUM10 = " + ".join(f"cast(substr(body, {k + 4}, 1) as int) * {10 - k}" for k in range(9))

#: View name -> SQL; {x} is another view or a base table.
VIEWS: dict[str, str] = {
    "part_isbn": f"""
        select p_partkey, concat(body, cast((10 - ({_DIGIT_SUM13}) % 10) % 10 as string)) as isbn13,
          concat(substr(body, 4, 9), case when (11 - ({_DIGIT_SUM10}) % 11) % 11 = 10 then 'X' else cast((11 - ({_DIGIT_SUM10}) % 11) % 11 as string) end) as isbn10
        from (select p_partkey, concat('978', lpad(cast(p_partkey * 37 % 1000000007 as string), 9, '0')) as body from {{part}}) b""",
    "shops": "select s_suppkey as id, s_name as name, cast(50 + s_suppkey % 51 as int) as trust from {supplier}",
    "observed": """
        select l_suppkey, l_partkey, l_shipdate, max(cast(floor(l_extendedprice * 100 / l_quantity + 0.5) as bigint)) as price_cents
        from {lineitem} group by l_suppkey, l_partkey, l_shipdate""",
    "shop_books": """
        select s.l_suppkey * 1000000 + s.l_partkey as id, s.l_suppkey as shop_id,
          concat('https://s', cast(s.l_suppkey as string), '.example/p/', case when s.l_partkey % 37 = 0 then 'other-page' else replace(p.p_name, ' ', '-') end, '-', cast(s.l_partkey as string)) as url,
          case when s.l_partkey % 41 = 0 then 'Red (DVD) ring' else p.p_name end as title,
          case when s.l_partkey % 13 = 0 then null else p.p_brand end as author,
          case when s.l_partkey % 11 = 0 then null else concat('Publisher ', cast(p.p_size % 7 as string)) end as publisher,
          case when s.l_partkey % 19 = 0 then null when s.l_partkey % 17 = 0 then '10 x 20 cm' else p.p_type end as format,
          case when (s.l_suppkey + s.l_partkey) % 9 = 0 then 'non_book' when (s.l_suppkey + s.l_partkey) % 10 = 1 then 'ebook' else 'book' end as type,
          cast(case when s.l_partkey % 13 = 0 and s.l_partkey % 2 = 0 then null when s.l_partkey % 23 = 0 then 1700 when s.l_partkey % 29 = 0 then 2090 else 1960 + p.p_size end as int) as year,
          case when s.l_partkey % 7 = 0 then null when s.l_partkey % 43 = 0 and s.l_suppkey % 2 = 0 then i.isbn10 else i.isbn13 end as isbn,
          case when s.l_partkey % 3 = 0 then null else concat('SKU', cast(s.l_partkey as string)) end as sku,
          case when (s.l_suppkey + s.l_partkey) % 31 = 0 then null when s.l_partkey % 47 = 0 then 0 else s.price_cents end as price_cents,
          (s.l_suppkey + s.l_partkey) % 3 <> 0 as in_stock, (s.l_suppkey + s.l_partkey) % 5 <> 0 as is_active,
          case when s.l_partkey % 8 = 3 then 'zaislai' else concat('cat', cast(s.l_partkey % 8 as string)) end as category,
          case when s.l_partkey % 5 <> 0 and (s.l_suppkey + s.l_partkey) % 4 <> 0 then s.l_partkey end as book_id,
          case when s.l_partkey % 5 <> 0 and (s.l_suppkey + s.l_partkey) % 4 <> 0 then 'matched' else 'unmatched' end as match_status,
          s.first_seen_at, s.last_seen_at
        from (select l_suppkey, l_partkey, max(price_cents) as price_cents, min(l_shipdate) as first_seen_at, max(l_shipdate) as last_seen_at
              from {observed} group by l_suppkey, l_partkey) s
        join {part} p on p.p_partkey = s.l_partkey join {part_isbn} i on i.p_partkey = s.l_partkey""",
    "discovered_urls": """
        select id * 10 + 1 as id, shop_id, id as shop_book_id, url, url as normalized_url,
          case when id % 11 = 0 then 'non_product' when id % 14 = 0 then 'unreachable' when id % 17 = 0 then 'unknown' else 'product' end as type,
          cast(id % 5 as int) as fail_count, case when id % 6 = 5 then null else last_seen_at end as last_checked_at
        from {shop_books} where id % 53 <> 0
        union all
        select id * 10 + 2, shop_id, id, concat(url, case when id % 12 = 0 then '?v=2' else '-alt' end), concat(url, case when id % 12 = 0 then '?v=2' else '-alt' end),
          case when id % 22 = 0 then 'non_product' else 'product' end, 0, last_seen_at
        from {shop_books} where id % 6 = 0 and id % 53 <> 0""",
    "books": """
        select p_partkey as id, p_name as title, cast(1960 + p_size as int) as year, concat('Publisher ', cast(p_size % 7 as string)) as publisher,
          case when p_partkey % 2 = 0 then 'library' else 'shop_inferred' end as data_source
        from {part} where p_partkey % 5 <> 0""",
    "book_isbns": """
        select p.p_partkey as book_id, i.isbn13 as isbn, 'isbn13' as isbn_type from {part} p
          join {part_isbn} i on i.p_partkey = p.p_partkey + case when p.p_partkey % 11 = 0 then 5 else 0 end where p.p_partkey % 5 <> 0
        union all
        select p.p_partkey, i.isbn10, 'isbn10' from {part} p join {part_isbn} i on i.p_partkey = p.p_partkey where p.p_partkey % 5 <> 0 and p.p_partkey % 3 = 0""",
    "authors": "select cast(substr(p_brand, 7) as bigint) as id, p_brand as name, lower(p_brand) as normalized_name from {part} group by p_brand",
    "book_authors": """
        select p_partkey as book_id, cast(substr(p_brand, 7) as bigint) as author_id, case when p_partkey % 4 = 0 then 'translator' else 'author' end as role, 0 as position
        from {part} where p_partkey % 5 <> 0""",
    "prices": """
        select l_suppkey * 1000000 + l_partkey as shop_book_id, l_shipdate as observed_at, price_cents,
          case when l_partkey % 3 = 0 then price_cents + 500 end as original_cents
        from {observed}""",
    "scrape_runs": """
        select o_orderkey as id, o_custkey % (select count(*) from {supplier}) as shop_id,
          case o_orderstatus when 'O' then 'completed' when 'F' then 'failed' else 'running' end as status,
          case substr(o_orderpriority, 1, 1) when '1' then 'discover_sitemap' when '2' then 'discover_category' when '3' then 'scan' when '4' then 'validate' else 'match' end as phase,
          o_orderdate as started_at, cast(o_orderkey % 5000 as int) as seconds,
          cast(floor(o_totalprice) as bigint) % 200 as urls_total, cast(floor(o_totalprice) as bigint) % 171 as urls_processed, cast(o_orderkey % 7 as int) as error_count,
          case when o_orderstatus = 'F' then case when o_orderkey % 3 = 0 then 'heartbeat_timeout' when o_orderkey % 3 = 1 then 'backend_5xx' end end as close_reason
        from {orders}""",
    "scrape_url_items": """
        select l_orderkey as run_id, l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey as item_key, l_suppkey as shop_id, l_suppkey * 1000000 + l_partkey as shop_book_id,
          case when l_linestatus = 'O' then 'done' when l_returnflag = 'R' then 'failed' when l_returnflag = 'A' then 'processing' else 'pending' end as status,
          cast(l_linenumber as int) as attempts, cast(l_quantity as int) * 10 as duration_ms, l_shipdate as finished_at
        from {lineitem}""",
    "scrape_failures": """
        select event_id as id, cast(user_id as bigint) as item_id, user_id % 20 as run_id, user_id % 5 as shop_id, ts as failed_at,
          case cast(floor(value) as int) % 5 when 0 then 'http_error' when 1 then 'timeout' when 2 then 'parse_error' when 3 then 'blocked' end as error_reason,
          case cast(floor(value) as int) % 4 when 0 then 404 when 1 then 503 when 2 then 429 end as http_status, event_id % 3 = 0 as acknowledged
        from {events} where event_type = 'error'""",
    "run_events": "select event_id as id, user_id % 20 as run_id, event_type, ts as created_at, props as payload from {events}",
    "validation_issues": """
        select event_id as id, user_id % (select count(*) from {supplier}) as shop_id, user_id % 20 as run_id,
          case event_id % 7 when 0 then 'missing_price' when 1 then 'invalid_isbn' when 2 then 'suspicious_title' when 3 then 'zero_price' when 4 then 'url_aliases' when 5 then 'stale_active' else 'html_in_text' end as issue,
          case event_id % 3 when 0 then 'price' when 1 then 'isbn' else 'title' end as field, concat('https://x.example/', cast(event_id as string)) as url,
          case event_id % 11 when 0 then 'resolved' when 1 then 'acknowledged' when 2 then 'snoozed' else 'new' end as lifecycle_state, ts as first_seen_at
        from {events} where event_type <> 'view'""",
}


def dependencies(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def true_sizes(spark: SparkSession) -> SparkSession:
    """Judge tables by what they take in memory, unless the session already sets a factor."""
    key = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(key, "1.0")) == 1.0:
        spark.conf.set(key, str(COMPRESSION))
    return spark


def file_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of all files of a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def table(spark: SparkSession, sf_dir: str, name: str, kept: dict[str, DataFrame] | None = None) -> DataFrame:
    """A catalogue view or base table over the Parquet files of ``sf_dir``; views that are in ``kept`` are read from there."""
    if kept and name in kept:
        return kept[name]
    if name not in VIEWS:
        return true_sizes(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    given = {d: table(spark, sf_dir, d, kept) for d in dependencies(sql)}
    if name == "observed":
        # dealt by part once: both group-bys of a listing and its joins with its part then find their rows where they are;
        # a large table in more pieces than the session's, so that a task's memory does not grow with it
        pieces = -(-file_bytes(spark, f"{sf_dir}/lineitem.parquet") // PIECE)
        few = pieces <= int(spark.conf.get("spark.sql.shuffle.partitions"))
        given["lineitem"] = given["lineitem"].repartition(*([] if few else [pieces]), "l_partkey")
    return spark.sql(sql, **given)


def oracle(sql: str) -> str:
    """DuckDB text of a query that names views as {view}: the views it needs become common table expressions."""
    order: list[str] = []

    def visit(text: str) -> None:
        for d in dependencies(text):
            if d in VIEWS and d not in order:
                visit(VIEWS[d])
                order.append(d)

    visit(sql)
    plain = lambda text: re.sub(r"\{(\w+)\}", r"\1", text)
    ctes = ",\n".join(f"{v} as ({plain(VIEWS[v])})" for v in order)
    body = plain(sql).strip()
    if not ctes:
        return body
    return f"with {ctes},\n{body[5:]}" if body.lower().startswith("with ") else f"with {ctes}\n{body}"
