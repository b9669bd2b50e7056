"""What a query must not do: join for rules that it does not run, parse all pages in one task, meet null keys in one task."""

import pytest
from pyspark.sql import functions as F

from tomewatch.operators import details, matching, quality
from tomewatch.plans.queries_quality import found
from tomewatch.plans.queries_text import built
from tomewatch.plans.registry import QUERIES, Tables

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_rule_joins_only_what_it_needs(spark):
    t = Tables(spark, SF)
    one = lambda issue: quality.suite(t.shop_books, t.discovered_urls, t.prices, t.book_isbns, "2001-08-01 00:00:00", issue)
    own = plan(t.shop_books).count("Join")
    assert plan(one("price_zero")).count("Join") == own
    assert "_drift" not in plan(one("stale_active")) and "_same_isbn" not in plan(one("stale_active"))
    assert {r["issue"] for r in one("price_zero").collect()} == {"price_zero"}


@pytest.mark.parametrize("issue", ["book_no_signals", "book_no_metadata", "format_is_dimensions", "active_no_price", "non_book_has_isbn", "year_out_of_range"])
def test_rules_on_own_columns_join_nothing_more(spark, issue):
    t = Tables(spark, SF)
    assert plan(found(t, issue)).count("Join") <= plan(t.shop_books).count("Join") and "Window" not in plan(found(t, issue))


@pytest.mark.parametrize("issue", ["non_product_active", "unmatched_has_isbn"])
def test_rules_on_urls_join_stored_listings_once(spark, issue):
    out = plan(found(Tables(spark, SF), issue))
    assert out.count("Join") == 1 and "_drift" not in out and "_aliases" not in out


@pytest.mark.parametrize("issue", ["unmatched_has_isbn", "stale_active"])
def test_rules_on_healed_listings_join_only_ended_ones(spark, issue):
    out = plan(found(Tables(spark, SF), issue))
    assert out.count("Join LeftAnti") == 1 and "_unreachable" not in out


def test_rules_on_urls_store_only_their_columns(spark):
    t = Tables(spark, SF)
    found(t, "non_product_active")
    assert not {"isbn", "book_id"} & set(t.shop_books.columns)


def test_pages_are_dealt_over_cores(spark):
    assert built(Tables(spark, SF)).rdd.getNumPartitions() >= 4


def test_findings_without_a_work_are_spread(spark):
    rows = lambda data, schema: spark.createDataFrame(data, schema)
    found = rows([(i, 1, f"u{i}", "zero_price", "new", None, 1) for i in range(40)], "id long, shop_id long, url string, issue string, lifecycle_state string, shop_book_id long, run_id long")
    out = details.issue_detail(
        found, rows([(1, "t", None, None)], "id long, title string, isbn string, book_id long"), rows([], "id long, shop_id long, url string, shop_book_id long"),
        rows([(1, "failed", "scan")], "id long, status string, phase string"), rows([(1, "s")], "id long, name string"), rows([(1, "w")], "id long, title string"), rows([(1, "9", "isbn13")], "book_id long, isbn string, isbn_type string"),
    )
    assert "no work " in plan(out) and "no listing " in plan(out)
    assert out.count() == 40 and out.where("book_title is null and title is null and run_status = 'failed'").count() == 40


@pytest.fixture
def conf(spark):
    """Settings that hold for one test."""
    before = {}

    def put(key, value):
        before.setdefault(key, spark.conf.get(key, None))
        spark.conf.set(key, value)

    yield put
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_pieces_do_not_grow_with_file_splits(spark, conf):
    conf("spark.sql.files.maxPartitionBytes", "64k")
    assert Tables(spark, "/root/testdata/sf0.1").observed.rdd.getNumPartitions() <= 4


def test_parts_are_not_broadcast_for_their_few_bytes_in_parquet(spark, conf):
    """20,000 parts are 0.2 MB in Parquet and 2 MB as the two columns that the join reads."""
    conf("spark.sql.autoBroadcastJoinThreshold", "300k")
    t = Tables(spark, "/root/testdata/sf0.1")
    assert "BroadcastHashJoin" not in t.shop_books.select("id", "title")._jdf.queryExecution().executedPlan().toString()


def test_synthesis_reads_listings_once_and_drops_those_without_isbn(spark):
    rows = lambda data, schema: spark.createDataFrame(data, schema)
    listings = rows(
        [(1, 1, "a", "x", 2000, None, None, "111"), (2, 2, "b", None, None, "late", "2001-01-02", "1-11"), (3, 1, "c", "y", 2001, "early", "2001-01-01", "111"), (4, 1, "d", "y", 2001, "p", None, None), (5, 1, "e", "y", 2001, "p", None, " "), (6, 2, "f", None, None, "own", None, "222")],
        "id long, shop_id long, title string, author string, year int, publisher string, first_seen_at string, isbn string",
    )
    out = matching.synthesise(listings, rows([(9, "222")], "book_id long, isbn string"), rows([(1, 60), (2, 70)], "id long, trust int"))
    assert [tuple(r) for r in out.select("isbn", "title", "author", "year", "shop_id", "publisher").collect()] == [("111", "b", None, None, 2, "early")]
    assert "Window" not in plan(out) and plan(out).count("Join") == 2


@pytest.mark.parametrize("name", ["mat1_counts", "mat1_run_matching"])
def test_matching_derives_listings_once(spark, name):
    assert not [f for f in QUERIES[name](spark, SF).inputFiles() if "lineitem" in f]


@pytest.mark.parametrize("name", ["jn15_issue_detail", "set1_unified"])
def test_findings_are_not_shuffled_for_their_run(spark, conf, name):
    """The few runs that findings name come by broadcast, so no exchange goes by run_id, however large the table of runs is."""
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    made = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(run_id" not in made and "BroadcastHashJoin [run_id" in made


def test_runs_beyond_a_broadcast_are_joined(spark):
    t = Tables(spark, SF)
    some = t.scrape_runs.where("id % 3 = 0")
    assert t.named(t.scrape_runs, some.select(F.col("id").alias("run_id")), "run_id", rows=1).count() == some.count()


def test_inbox_spreads_findings_without_a_listing(spark, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    made = QUERIES["set1_unified"](spark, SF)
    dealt = [line for line in made._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning(shop_book_id" in line]
    assert len(dealt) == 2 and all("_spread#" in line for line in dealt)
    assert made.where("kind = 'validation' and shop_book_id is null").count() > 0
