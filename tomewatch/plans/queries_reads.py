"""Read models: filters, aggregates, windows, sorts and unions over the catalogue tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import present
from ..operators import aggregates as a
from ..operators import filters as f
from ..operators import lifecycle as lc
from ..operators import windows as w
from .registry import query

NOW, SINCE, EVENTS_NOW = "2001-08-01 00:00:00", "1999-01-01 00:00:00", "2024-01-30 00:00:00"
OPEN_BOOK = "select book_id from {shop_books} where book_id is not null group by book_id having "

query("fil1_live", "select id, in_stock from {shop_books} where is_active and in_stock")(lambda t: f.live(t.shop_books, in_stock=True).select("id", "in_stock"))
query(
    "fil2_listings",
    """select id, title, isbn from {shop_books} where (title ilike '%ring%' or author ilike '%ring%' or isbn ilike '%ring%') and category = 'cat2' and is_active and isbn is not null
       and (author is null or publisher is null or year is null or isbn is null or price_cents is null or format is null)
       union all select id, title, isbn from {shop_books} where format is null and book_id is null and id in (select shop_book_id from {discovered_urls} where type = 'unreachable')""",
)(
    lambda t: f.filter_listings(t.shop_books, search="ring", category="cat2", active=True, has_isbn=True, missing="any").select("id", "title", "isbn").union(
        f.filter_listings(t.shop_books, format="none", linked=False, unreachable=t.discovered_urls).select("id", "title", "isbn")
    )
)
query(
    "fil3_books",
    """select id, title from {books} where data_source = 'library' and id in (select book_id from {book_isbns})
       and id in (select book_id from {shop_books} where book_id is not null group by book_id having count(*) between 0 and 24)
       union all select id, title from {books} where year = 1980 and title ilike '%blue%'""",
)(
    lambda t: f.filter_books(t.books, t.book_isbns, t.shop_books, source="library", has_isbn=True, listed=(0, 24)).select("id", "title").union(
        f.filter_books(t.books, t.book_isbns, t.shop_books, year=1980, search="blue").select("id", "title")
    )
)
query("fil4_urls", "select id, url from {discovered_urls} where type = 'product' and fail_count >= 3 and url ilike '%ring%' and shop_book_id is not null")(
    lambda t: f.filter_urls(t.discovered_urls, type="product", failing=True, search="ring", listed=True).select("id", "url")
)
query(
    "fil5_runs",
    f"""select id, phase from {{scrape_runs}} where starts_with(phase, 'discover') and status = 'failed' and started_at >= timestamp '{NOW}' - interval 30 day
        union all select id, phase from {{scrape_runs}} where phase <> 'validate' and shop_id = 3 and started_at >= timestamp '{NOW}' - interval 7 day""",
)(
    lambda t: f.filter_runs(t.scrape_runs, NOW, phase="discover", status="failed", since="30d").select("id", "phase").union(
        f.filter_runs(t.scrape_runs, NOW, phase="crawls", shop=3, since="7d").select("id", "phase")
    )
)
query("fil6_issues", "select id, issue, lifecycle_state from {validation_issues} where lifecycle_state in ('new', 'acknowledged') and issue in ('missing_price', 'zero_price') and url ilike '%9%'")(
    lambda t: f.filter_issues(t.validation_issues, present.severities(t.spark), severity="critical", state="open", search="9").select("id", "issue", "lifecycle_state")
)
query("fil7_rescrape", "select id, url from {shop_books} where publisher ilike '%publisher 3%' and category = 'cat5' and year is null and is_active order by id limit 50")(
    lambda t: f.page(f.filter_listings(t.shop_books, category="cat5", missing="year", active=True).where(f.matches_text("publisher 3", "publisher")), [F.col("id")], 1, 50).select("id", "url")
)
query("fil8_pattern", "select count(*) filter (where not regexp_matches(url, 'ring|bolt')) as filtered from {discovered_urls}")(lambda t: f.filter_pattern(t.discovered_urls, "ring|bolt")[1])
query(
    "fil9_due_urls",
    f"""select id, type from {{discovered_urls}} where type not in ('non_product', 'product') and (fail_count < 3 or last_checked_at is null or last_checked_at < timestamp '{NOW}' - interval 7 day)
        order by last_checked_at asc nulls first, id limit 200""",
)(lambda t: f.due_urls(t.discovered_urls, NOW, "delta", 200).select("id", "type"))
query("fil10_stable_urls", f"select id from {{discovered_urls}} where type in ('product', 'non_product') and last_checked_at >= timestamp '{NOW}' - interval 7 day")(lambda t: f.stable_urls(t.discovered_urls, NOW).select("id"))
query(
    "fil11_resumable_runs",
    """select id, shop_id from {scrape_runs} where (status = 'running' or status = 'failed' and close_reason is distinct from 'heartbeat_timeout')
       and id in (select run_id from {scrape_url_items} where status = 'pending')""",
)(lambda t: f.resumable_runs(t.scrape_runs, t.scrape_url_items).select("id", "shop_id"))
query(
    "prj3_present_listing",
    """select id, title, coalesce(author, '—') as author, case when price_cents is null then '—' else '€' || (price_cents // 100) || '.' || lpad(cast(price_cents % 100 as string), 2, '0') end as price,
       case when not is_active then 'delisted' when not in_stock then 'out' else 'active' end as state from {shop_books}""",
)(lambda t: present.present_listing(t.shop_books))
query(
    "prj4_present_runs",
    """select id, case when starts_with(phase, 'discover_') then 'discover' when phase in ('match', 'validate') then phase else 'scan' end as phase_type,
       case when starts_with(phase, 'discover_') then substr(phase, 10) when phase in ('match', 'validate') then '' else 'delta' end as phase_mode,
       cast(case when status = 'completed' then 100 when urls_total <= 0 then 0 else least(99, urls_processed * 100 // urls_total) end as bigint) as progress,
       case when h > 0 then case when m > 0 then h || 'h ' || m || 'm' else h || 'h' end when m > 0 then case when s > 0 then m || 'm ' || s || 's' else m || 'm' end else s || 's' end as elapsed,
       case when age < 60 then 'just now' when age < 3600 then (age // 60) || 'm ago' when age < 86400 then (age // 3600) || 'h ago' when d < 7 then d || 'd ago' when d < 35 then (d // 7) || 'w ago'
         when d < 360 then (d // 30) || 'mo ago' else (d // 365) || 'y ago' end as started_ago, strftime(started_at, '%Y-%m-%dT%H:%M:%S+00:00') as started_at
       from (select *, seconds // 3600 as h, seconds // 60 % 60 as m, seconds % 60 as s, cast(epoch(timestamp '2001-08-01') - epoch(started_at) as bigint) as age,
         cast(epoch(timestamp '2001-08-01') - epoch(started_at) as bigint) // 86400 as d from {scrape_runs})""",
)(lambda t: present.present_runs(t.scrape_runs, NOW))

query(
    "ag1_overview",
    "select (select count(*) from {shop_books}) as listings, (select count(*) from {shop_books} where is_active) as active, (select count(isbn) from {shop_books}) as with_isbn, (select count(*) from {prices}) as observations",
)(lambda t: a.overview_counts(t.shop_books, t.prices))
FIELDS = ["author", "publisher", "year", "isbn", "sku", "format", "price_cents"]
query("ag2_completeness", " union all ".join(f"select '{c}' as field, floor(count({c}) * 1000.0 / count(*) + 0.5) / 10.0 as pct from {{shop_books}}" for c in FIELDS))(lambda t: a.completeness(t.shop_books, FIELDS))
query("ag3_field_stats", " union all ".join(f"select shop_id, '{c}' as field, count(*) - count({c}) as missing, count({c}) as present from {{shop_books}} group by shop_id" for c in FIELDS))(
    lambda t: a.field_stats(t.shop_books, FIELDS)
)
query(
    "ag4_shop_stats",
    """select s.id as shop_id, s.name, coalesce(l.n, 0) as listings, coalesce(l.a, 0) as active, coalesce(u.n, 0) as urls, coalesce(p.n, 0) as observations, coalesce(i.n, 0) as new_issues
       from {shops} s left join (select shop_id, count(*) as n, count(*) filter (where is_active) as a from {shop_books} group by 1) l on l.shop_id = s.id
       left join (select shop_id, count(*) as n from {discovered_urls} group by 1) u on u.shop_id = s.id
       left join (select b.shop_id, count(*) as n from {prices} p join {shop_books} b on b.id = p.shop_book_id group by 1) p on p.shop_id = s.id
       left join (select shop_id, count(*) as n from {validation_issues} where lifecycle_state = 'new' group by 1) i on i.shop_id = s.id""",
)(lambda t: a.shop_stats(t.shops, t.shop_books, t.discovered_urls, t.prices, t.validation_issues))
_STATES = ", ".join(f"count(*) filter (where lifecycle_state = '{s}') as {s}" for s in ("new", "acknowledged", "snoozed", "resolved"))
query("ag5_issue_groups", f"select issue, shop_id, count(*) as total, {_STATES} from {{validation_issues}} group by issue, shop_id")(lambda t: a.issue_groups(t.validation_issues, ["issue", "shop_id"]))
query("ag6_issue_summary", "select issue, count(*) as n from {validation_issues} where lifecycle_state = 'new' group by issue")(lambda t: a.issue_summary(t.validation_issues, "new"))
_CLASH = "count(distinct lower(title)) > 1 or count(distinct lower(author)) > 1 or count(distinct year) > 1 or count(distinct lower(publisher)) > 1"
query("ag7_conflicts", OPEN_BOOK + _CLASH)(lambda t: a.conflicts(t.shop_books))
query(
    "ag8_book_stats",
    f"""with per as (select book_id, count(distinct shop_id) as s, count(*) as n from {{shop_books}} where book_id is not null group by 1)
        select (select count(*) from {{books}}) as total, (select count(*) from {{books}} where data_source = 'library') as enriched,
          (select floor(count(*) filter (where data_source = 'library') * 1000.0 / count(*) + 0.5) / 10.0 from {{books}}) as enriched_pct,
          (select count(*) from per where s > 1) as multi_source, (select count(*) from per where s = 1) as single_source,
          (select floor(sum(n) * 10.0 / count(*) + 0.5) / 10.0 from per) as avg_listings, (select count(*) from ({OPEN_BOOK + _CLASH}) c) as conflicts""",
)(lambda t: a.book_stats(t.books, t.shop_books))
query("ag9_price_span", "select book_id, count(*) as n, min(price_cents) as min_cents, max(price_cents) as max_cents from {shop_books} where book_id is not null group by book_id")(lambda t: a.price_span(t.shop_books))
query("ag10_years", "select distinct year from {books} where year is not null")(lambda t: a.years(t.books))
query(
    "ag11_daily_price",
    f"""select b.book_id, b.shop_id, date_trunc('day', p.observed_at) as day, max(p.price_cents) as price_cents from {{prices}} p join {{shop_books}} b on b.id = p.shop_book_id
        where b.book_id is not null and p.observed_at >= timestamp '{NOW}' - interval 30 day group by 1, 2, 3""",
)(lambda t: a.daily_price(t.prices, t.shop_books, NOW).withColumn("day", F.col("day").cast("timestamp_ntz")))
CHANGES = """select l_orderkey as run_id, l_suppkey * 1000000 + l_partkey as shop_book_id, case l_linenumber % 3 when 0 then 'title' when 1 then 'isbn' else 'author' end as field from {lineitem} where l_returnflag = 'R'"""


def changes(t):
    field = F.expr("case l_linenumber % 3 when 0 then 'title' when 1 then 'isbn' else 'author' end")
    return t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("run_id"), F.expr("l_suppkey * 1000000 + l_partkey").alias("shop_book_id"), field.alias("field"))


query(
    "ag12_run_counts",
    f"""with ch as ({CHANGES}), cr as (select run_id from {{scrape_url_items}} where status = 'done' and attempts = 1)
        select r.id as run_id, coalesce(a.n, 0) as added, coalesce(u.n, 0) as updated from {{scrape_runs}} r left join (select run_id, count(*) as n from cr group by 1) a on a.run_id = r.id
        left join (select run_id, count(distinct shop_book_id) as n from ch group by 1) u on u.run_id = r.id""",
)(lambda t: a.run_counts(t.scrape_runs, changes(t), t.scrape_url_items.where("status = 'done' and attempts = 1")))
query(
    "ag13_run_breakdown",
    "select run_id, " + ", ".join(f"count(*) filter (where status = '{s}') as {s}" for s in ("pending", "processing", "done", "failed"))
    + ", count(*) filter (where status in ('done', 'failed')) as terminal from {scrape_url_items} group by run_id",
)(lambda t: a.run_breakdown(t.scrape_url_items))
query("ag14_changed_fields", f"select run_id, shop_book_id, string_agg(distinct field, ', ' order by field) as fields from ({CHANGES}) c group by run_id, shop_book_id")(lambda t: a.changed_fields(changes(t)))
_LATEST = "(select * from (select *, row_number() over (partition by run_id, item_id order by failed_at desc, id desc) as rn from {scrape_failures}) x where rn = 1)"
query(
    "ag15_failure_groups",
    f"""select run_id, error_reason, http_status, count(*) filter (where not acknowledged) as unacked, count(*) filter (where acknowledged) as acked
        from {_LATEST} l group by 1, 2, 3 having count(*) filter (where not acknowledged) > 0""",
)(lambda t: w.failure_groups(t.scrape_failures))
query(
    "ag16_failure_recurrence",
    """with g as (select distinct shop_id, run_id, error_reason, http_status from {scrape_failures}),
       n as (select shop_id, run_id, row_number() over (partition by shop_id order by run_id) as n from (select distinct shop_id, run_id from {scrape_failures}) d),
       k as (select g.*, n.n from g join n on n.shop_id = g.shop_id and n.run_id = g.run_id)
       select k.shop_id, k.run_id, k.error_reason, k.http_status, (select count(*) from k o where o.shop_id = k.shop_id and o.n between k.n - 5 and k.n - 1
         and o.error_reason is not distinct from k.error_reason and o.http_status is not distinct from k.http_status) as recurrence from k""",
)(lambda t: w.failure_recurrence(t.scrape_failures))
query(
    "ag17_run_kpis",
    f"""select count(*) filter (where status = 'running') as running, count(*) filter (where d) as day_total, count(*) filter (where d and status = 'completed') as day_ok,
        count(*) filter (where d and status = 'failed') as day_failed, count(*) as all_time from (select status, started_at >= timestamp '{NOW}' - interval 24 hour as d from {{scrape_runs}}) r""",
)(lambda t: a.run_kpis(t.scrape_runs, NOW))
query(
    "ag18_listing_kpis",
    """select count(*) as total, count(*) filter (where is_active) as active, count(*) filter (where isbn is null) as missing_isbn, count(*) filter (where price_cents is null) as missing_price,
       count(*) filter (where id in (select shop_book_id from {discovered_urls} where type = 'unreachable')) as unreachable from {shop_books}""",
)(lambda t: a.listing_kpis(t.shop_books, t.discovered_urls))
query("ag18_url_kpis", "select count(*) as total, count(shop_book_id) as with_listing, count(*) - count(shop_book_id) as without, count(*) filter (where fail_count >= 3) as failed from {discovered_urls}")(
    lambda t: a.url_kpis(t.discovered_urls)
)
query("ag19_run_findings", "select run_id, field, issue, count(*) as n from {validation_issues} group by 1, 2, 3")(lambda t: a.run_findings(t.validation_issues))
query(
    "ag20_activity",
    f"""select cast(d as date) as day, coalesce(sum(urls_processed), 0) as items from generate_series(timestamp '{NOW}' - interval 13 day, timestamp '{NOW}', interval 1 day) g(d)
        left join {{scrape_runs}} r on cast(r.started_at as date) = cast(g.d as date) and r.status = 'completed' group by 1""",
)(lambda t: a.activity(t.scrape_runs, NOW))
query(
    "ag21_issue_trend",
    f"""select issue, list(n order by day) as counts from (select i.issue, cast(g.d as date) as day, count(v.id) as n from (select distinct issue from {{validation_issues}}) i
        cross join generate_series(timestamp '{EVENTS_NOW}' - interval 6 day, timestamp '{EVENTS_NOW}', interval 1 day) g(d)
        left join {{validation_issues}} v on v.issue = i.issue and cast(v.first_seen_at as date) = cast(g.d as date) group by 1, 2) x group by issue""",
)(lambda t: a.issue_trend(t.validation_issues, EVENTS_NOW))
query("ag22_zero_yield_runs", f"select count(*) as n from {{scrape_runs}} where starts_with(phase, 'discover') and status = 'completed' and started_at >= timestamp '{NOW}' - interval 24 hour and urls_processed = 0")(
    lambda t: a.zero_yield_runs(t.scrape_runs, NOW)
)
query("ag23_failed_runs", f"select id, shop_id, close_reason from {{scrape_runs}} where status = 'failed' and started_at between timestamp '{SINCE}' and timestamp '{NOW}' order by started_at desc nulls first, id desc limit 100")(
    lambda t: a.failed_runs(t.scrape_runs, SINCE, NOW).select("id", "shop_id", "close_reason")
)
query(
    "ag24_pipeline_health",
    f"""with r as (select *, started_at >= timestamp '{NOW}' - interval 24 hour as d, started_at >= timestamp '{NOW}' - interval 30 day as m,
          row_number() over (partition by phase order by started_at desc, id desc) as rn from {{scrape_runs}})
        select phase, count(*) filter (where d and status = 'completed') as ok_24h, count(*) filter (where d and status = 'failed') as failed_24h, count(*) filter (where d) as total_24h,
          case when count(*) filter (where m and status in ('completed', 'failed')) > 0 then
            floor(count(*) filter (where m and status = 'completed') * 1000.0 / count(*) filter (where m and status in ('completed', 'failed')) + 0.5) / 10.0 end as success_30d,
          sum(seconds) filter (where status = 'completed') // count(*) filter (where status = 'completed') as mean_seconds,
          string_agg(status, ',' order by rn desc) filter (where rn <= 24) as recent from r group by phase""",
)(lambda t: a.pipeline_health(t.scrape_runs, NOW))
query("ag25_duplicate_urls", "select count(normalized_url) - count(distinct normalized_url) as duplicates from {discovered_urls}")(lambda t: a.duplicate_urls(t.discovered_urls, "normalized_url"))
query("ag26_zero_yield", "select shop_id, count(*) as known from {discovered_urls} where shop_id not in (select shop_id from {scrape_runs} where phase = 'discover_sitemap' and urls_processed > 100) group by 1")(
    lambda t: a.zero_yield(t.scrape_runs.where("phase = 'discover_sitemap' and urls_processed > 100"), t.discovered_urls)
)
query("ag28_run_issue_counts", "select run_id, count(*) as findings from {validation_issues} group by 1")(lambda t: a.run_issue_counts(t.validation_issues))
query("ag28_restart_depth", "select run_id, count(*) as restarts from {run_events} where event_type = 'signup' group by 1")(lambda t: a.restart_depth(t.run_events, "signup"))
query("ag29_settings_map", "select shop_id, string_agg(category || '=' || n, ';' order by category) as settings from (select shop_id, category, count(*) as n from {shop_books} group by 1, 2) s group by 1")(
    lambda t: a.settings_map(t.shop_books.groupBy("shop_id", F.col("category").alias("key")).agg(F.count("*").cast("string").alias("value"))).select(
        "shop_id", F.array_join(F.transform(F.map_entries("settings"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("settings")
    )
)

query(
    "wn1_price_steps",
    f"select shop_book_id, observed_at, price_cents, lag(price_cents) over (partition by shop_book_id order by observed_at, price_cents) as previous_cents from {{prices}} where observed_at >= timestamp '{SINCE}'",
)(lambda t: w.price_steps(t.prices, SINCE).select("shop_book_id", F.col("observed_at").cast("timestamp_ntz").alias("observed_at"), "price_cents", "previous_cents"))
query(
    "wn2_price_movers",
    f"""with s as (select *, lag(price_cents) over (partition by shop_book_id order by observed_at, price_cents) as previous_cents from {{prices}} where observed_at >= timestamp '{SINCE}')
        select shop_book_id, previous_cents, price_cents, max(observed_at) as observed_at, price_cents - previous_cents as change_cents from s where previous_cents <> price_cents group by 1, 2, 3""",
)(lambda t: w.price_movers(t.prices, SINCE).withColumn("observed_at", F.col("observed_at").cast("timestamp_ntz")))
query("wn3_latest_failure", f"select id, run_id, item_id, error_reason from {_LATEST} l")(
    lambda t: w.latest_per_key(t.scrape_failures, ["run_id", "item_id"], [F.desc("failed_at"), F.desc("id")]).select("id", "run_id", "item_id", "error_reason")
)
query(
    "wn4_top_failures",
    f"select run_id, error_reason, http_status, id, k as rank from (select *, row_number() over (partition by run_id, error_reason, http_status order by failed_at desc, id desc) as k from {_LATEST} l) x where k <= 3",
)(lambda t: w.top_failures(t.scrape_failures).select("run_id", "error_reason", "http_status", "id", "rank"))
query(
    "wn5_job_metrics",
    """with f as (select shop_id, phase, status, row_number() over (partition by shop_id, phase order by started_at desc, id desc) as k from {scrape_runs} where status in ('completed', 'failed')),
       d as (select shop_id, phase, seconds, row_number() over (partition by shop_id, phase order by started_at desc, id desc) as k from {scrape_runs} where status = 'completed')
       select f.shop_id, f.phase, f.status as last_status, m.mean_seconds, m.sampled from f left join
         (select shop_id, phase, sum(seconds) // count(*) as mean_seconds, count(*) as sampled from d where k <= 30 group by 1, 2) m on m.shop_id = f.shop_id and m.phase = f.phase where f.k = 1""",
)(lambda t: w.job_metrics(t.scrape_runs))
query(
    "wn6_repeated_failures",
    """select shop_id, phase, min(close_reason) as close_reason from (select *, row_number() over (partition by shop_id, phase order by started_at desc nulls last, id desc) as k from {scrape_runs}
         where status in ('completed', 'failed')) x where k <= 3 group by 1, 2 having count(*) filter (where status = 'failed') = 3 and count(close_reason) = 3 and count(distinct close_reason) = 1""",
)(lambda t: w.repeated_failures(t.scrape_runs))
_KIND = "case when event_type = 'view' then 'a' when event_type = 'signup' then null else 'b' end"
query(
    "wn7_stall_streak",
    f"""with e as (select run_id, {_KIND} as v, row_number() over (partition by run_id order by created_at desc, id desc) as r from {{run_events}}),
        t as (select run_id, v as top from e where r = 1)
        select e.run_id, coalesce(min(r) filter (where e.v is null or e.v is distinct from t.top), count(*) + 1) - 1 as streak from e join t on t.run_id = e.run_id where r <= 8 group by 1""",
)(lambda t: w.stall_streak(t.run_events.withColumn("v", F.expr(_KIND)), "v"))
query("wn8_latest_run", "select shop_id, id, status from (select *, row_number() over (partition by shop_id order by started_at desc, id desc) as k from {scrape_runs}) x where k = 1")(lambda t: w.latest_run(t.scrape_runs))
query("wn9_last_success", "select shop_id, phase, max(started_at) as last_success from {scrape_runs} where status = 'completed' group by 1, 2")(
    lambda t: w.last_success(t.scrape_runs).withColumn("last_success", F.col("last_success").cast("timestamp_ntz"))
)
query("so1_so2_page", "select id, title, price_cents from {shop_books} where is_active order by price_cents desc nulls last, id desc limit 25 offset 50")(
    lambda t: f.page(f.live(t.shop_books), [f.sort_column("price_cents", ("price_cents", "title"), True), F.desc("id")], 3, 25).select("id", "title", "price_cents")
)
query("so2_page_count", "select count(*) as total, greatest(1, cast(ceil(count(*) / 25.0) as bigint)) as pages from {shop_books} where is_active")(lambda t: f.page_count(f.live(t.shop_books), 25))
query(
    "so4_ranked_sort",
    """select run_id, item_key, status, duration_ms from {scrape_url_items} order by case status when 'failed' then 0 when 'processing' then 1 when 'pending' then 2 else 3 end, duration_ms desc nulls last, run_id, item_key, finished_at limit 80""",
)(
    lambda t: t.scrape_url_items.orderBy(f.ranked("status", ("failed", "processing", "pending")), F.col("duration_ms").desc_nulls_last(), "run_id", "item_key", "finished_at")
    .limit(80).select("run_id", "item_key", "status", "duration_ms")
)
_INBOX = """(select 'finding' as kind, id, run_id, issue, lifecycle_state as state, case when issue in ('missing_price', 'zero_price') then 'critical' when issue = 'url_aliases' then 'info' else 'warning' end as severity,
    first_seen_at as seen_at from {validation_issues}
    union all select 'failure', id, run_id, coalesce(error_reason, 'unknown'), case when acknowledged then 'acknowledged' else 'new' end,
      case when error_reason like 'parse%' and (http_status is null or http_status not between 400 and 599) then 'critical' else 'warning' end, failed_at from {scrape_failures})"""
query("so5_severity_sort", f"select kind, id, severity from {_INBOX} i order by case severity when 'critical' then 0 when 'warning' then 1 else 2 end, seen_at desc, kind, id limit 60")(
    lambda t: lc.inbox(t.validation_issues, t.scrape_failures).orderBy(f.ranked("severity", ("critical", "warning")), F.desc("seen_at"), "kind", "id").limit(60).select("kind", "id", "severity")
)
query("so6_in_flight", "select run_id, item_key, shop_id from {scrape_url_items} where status = 'processing' order by finished_at, run_id, item_key limit 50")(
    lambda t: t.scrape_url_items.where("status = 'processing'").orderBy("finished_at", "run_id", "item_key").limit(50).select("run_id", "item_key", "shop_id")
)
query("set1_inbox", f"select kind, id, run_id, issue, state, severity from {_INBOX} i where state = 'new'")(
    lambda t: lc.inbox(t.validation_issues, t.scrape_failures).where("state = 'new'").select("kind", "id", "run_id", "issue", "state", "severity")
)
query("set1_inbox_counts", f"select kind, state, count(*) as n from {_INBOX} i group by 1, 2")(lambda t: lc.inbox(t.validation_issues, t.scrape_failures).groupBy("kind", "state").agg(F.count("*").alias("n")))
query("set2_missing_from_feed", "select id from {shop_books} where is_active and url not in (select url from {discovered_urls} where type = 'product')")(
    lambda t: f.live(t.shop_books).join(t.discovered_urls.where("type = 'product'").select("url"), "url", "left_anti").select("id")
)
query("set4_keep_first", "select run_id, item_key, attempts, duration_ms from (select *, row_number() over (partition by run_id order by attempts, item_key, duration_ms) as k from {scrape_url_items}) x where k = 1")(
    lambda t: w.latest_per_key(t.scrape_url_items, ["run_id"], [F.asc("attempts"), F.asc("item_key"), F.asc("duration_ms")]).select("run_id", "item_key", "attempts", "duration_ms")
)
