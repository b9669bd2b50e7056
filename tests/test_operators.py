"""Operators on small frames: planted cases, suppressions and invariants."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tomewatch.functions import classify, isbn, present, text, urls
from tomewatch.operators import extract as x
from tomewatch.operators import filters, ingest, lifecycle, matching, quality, windows
from tomewatch.sources import tables
from tomewatch.streaming import jobs


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_isbn(spark):
    rows = [("978-0-306-40615-7",), ("9780306406158",), ("0-306-40615-2",), ("080442957X",), ("080442957x",), ("9789789001231",), ("9790000000001",), ("9781234567",), ("",), (None,)]
    got = values(spark, rows, "i string", isbn.is_valid(F.col("i")), isbn.to_isbn13(F.col("i")), isbn.to_isbn10(F.col("i")))
    assert [g[0] for g in got] == [True, False, True, True, True, False, True, False, False, False]
    assert got[2][1] == "9780306406157" and got[0][2] == "0306406152" and got[3][1] == "9780804429573" and got[6][2] is None and got[4][2] == "080442957X"


def test_urls(spark):
    cases = {
        "HTTP://Shop.Example//a//b/?utm_source=x&b=2&a=1&ref=z#top": "http://shop.example/a/b?b=2&a=1",
        "https://shop.example": "https://shop.example/",
        "https://shop.example/ą č/?q=a+b&x=%C4%85": "https://shop.example/ą č?q=a+b&x=%C4%85",
        "https://s.example/p?x=1%zz&fbclid=1": "https://s.example/p?x=1%25zz",
        " /only/path/ ": "/only/path", "//Host/x": "//host/x", "https://s.example/p?=1&&y": "https://s.example/p?y=", "https://s.example/p?a=~*": "https://s.example/p?a=~%2A",
    }
    got = values(spark, [(u,) for u in cases], "u string", "u", urls.normalize_url(F.col("u")))
    assert dict(got) == cases
    twice = values(spark, [(u,) for u in cases.values()], "u string", "u", urls.normalize_url(F.col("u")))
    assert all(a == b for a, b in twice)


def test_text(spark):
    got = values(
        spark, [("kale-du-pu-ga-12", "Kalėdų pūga"), ("kaledu-puga", "Kalėdų pūga"), ("a-b", "Other…"), ("x1-tale2", "The Tale"), (None, "x")], "s string, t string",
        text.diacritic_loss(F.col("s"), F.col("t")), text.slug_mismatch(F.col("s"), F.col("t")),
    )
    assert got == [(True, True), (False, False), (False, True), (False, False), (False, False)]
    names = values(spark, [("A. One, B. Two; C & D / E and F ir G",), ("Solo",), (" ",), (None,), (";",)], "a string", text.split_authors(F.col("a")))
    assert [n[0] for n in names] == [["A. One", "B. Two", "C", "D", "E", "F", "G"], ["Solo"], [], [], [";"]]
    forms = values(spark, [("14 x 21 cm, kieti viršeliai",), ("Minkštas",), ("CD",), ("10x20",), (None,)], "c string", text.cover_format(F.col("c")))
    assert [f[0] for f in forms] == ["hardcover", "paperback", "cd", None, None]
    cents = values(spark, [("1 234,50 €",), ("€12",), ("0.5",), ("n/a",), (None,)], "p string", text.price_text_cents(F.col("p")))
    assert [c[0] for c in cents] == [123450, 1200, 50, None, None]
    assert values(spark, [("2 h 05 min",), ("1:30:00",), ("45 min",), ("x",)], "d string", text.minutes_of(F.col("d"))) == [(125,), (90,), (45,), (None,)]


def test_classifier(spark):
    rows = [
        ("Pasaka", ["Grožinė&nbsp; literatūra"], None, None, None), ("Stalo žaidimas", ["Žaislai"], None, None, None), ("Lego", None, None, "A", None),
        ("Knyga", ["Žaislai"], "9780306406157", "A", "hardcover"), (" ", None, "9780306406157", None, None), ("Knyga", None, None, "A", "x"),
    ]
    verdict = classify.classify(F.col("t"), F.col("c"), F.col("i"), F.col("a"), [F.col("f")])
    got = values(spark, rows, "t string, c array<string>, i string, a string, f string", verdict["score"], verdict["is_book"], F.element_at(verdict["reasons"], -1)["key"])
    assert got == [
        (3, True, "non_book_categories"), (-7, False, "blocked_non_book_category"), (-1, False, "blocked_game_toy_title"), (3, True, "non_book_categories"), (0, False, "no_title"), (4, True, "non_book_categories"),
    ]


def test_presentation(spark):
    got = values(spark, [(0,), (59,), (61,), (3600,), (3720,), (90_000,), (None,)], "s long", present.duration_text(F.col("s")), present.age_text(F.col("s")))
    assert got == [("0s", "just now"), ("59s", "just now"), ("1m 1s", "1m ago"), ("1h", "1h ago"), ("1h 2m", "1h ago"), ("25h", "1d ago"), ("—", "—")]
    assert values(spark, [("7.50", "10.00"), ("1", "0"), ("9.99", None)], "p string, o string", present.discount_percent(F.col("p"), F.col("o")).cast("string")) == [("25.00",), (None,), (None,)]
    stamp = [(dt.datetime(2024, 1, 2, 3, 4, 5),), (dt.datetime(2024, 1, 2, 3, 4, 5, 60),)]
    assert [r[0] for r in values(spark, stamp, "t timestamp", present.iso_text(F.col("t")))] == ["2024-01-02T03:04:05+00:00", "2024-01-02T03:04:05.000060+00:00"]


ITEM = "url string, title string, author string, publisher string, format string, price string, price_original string, year string, pages string, isbn string, in_stock boolean, properties map<string,string>"


def item(**over):
    base = {"url": "https://s/p", "title": " T1 ", "author": "A", "publisher": " ", "format": "book", "price": "5.0", "price_original": None, "year": "2001", "pages": None, "isbn": None, "in_stock": None, "properties": {}}
    return tuple((base | over)[c.split()[0]] for c in ITEM.split(", "))


def test_validator(spark):
    cases = [
        (item(), None, []), (item(price="abc", title=""), "Invalid price: abc", ["invalid_price"]), (item(title=""), "Missing title", ["missing_title"]), (item(url="ftp://x"), "Invalid URL: ftp://x", ["invalid_url"]),
        (item(price=None), None, ["missing_price"]), (item(price=None, in_stock=False), None, []), (item(price="0"), None, ["zero_price"]), (item(price="9", price_original="8"), None, ["price_higher_than_original"]),
        (item(price_original="x"), None, ["invalid_price_original"]), (item(year="312", pages="1999"), None, ["year_pages_swap"]), (item(year="12"), None, ["invalid_year"]), (item(year="abc"), None, ["invalid_year"]),
        (item(isbn="123"), None, ["invalid_isbn"]), (item(title="<b>x</b>", author="<i>"), None, ["html_in_text", "html_in_text"]), (item(title="x"), None, ["suspicious_title"]), (item(title="y" * 301), None, ["suspicious_title"]),
        (item(format="audiobook", properties={"pages": "3"}), None, ["format_mismatch"]), (item(properties={"duration": "3"}), None, ["format_mismatch"]), (item(properties={"zz": "1"}), None, ["attribute_unknown_key"]),
        (item(properties={"lang": "xx"}), None, ["attribute_invalid_value"]), (item(properties={"size": "3cm"}), None, ["attribute_invalid_value"]), (item(properties={"size": "31", "lang": "lt"}), None, []),
    ]
    df = spark.createDataFrame([(k, *c[0]) for k, c in enumerate(cases)], "k int, " + ITEM)
    out = ingest.validate_items(df, ["pages", "duration", "lang", "size"], {"lang": ["lt", "en"]}, {"size": "[0-9]+"}).orderBy("k").collect()
    for r, (_, reject, issues) in zip(out, cases, strict=True):
        assert (r.reject, [f["issue"] for f in r.findings]) == (reject, issues), r
    assert (out[0].title, out[0].publisher, str(out[0].price)) == ("T1", None, "5.00") and (out[9].year, out[9].pages) == (1999, 312) and out[12].isbn is None
    swapped = ingest.validate_items(spark.createDataFrame([item(year="312", properties={"pages": "1999"})], ITEM)).first()
    assert swapped.year == 1999 and swapped.properties == {"pages": "312"}


BOOK = "id long, shop_id long, url string, title string, author string, isbn string, year int, format string, type string, category string, price_cents long, in_stock boolean, is_active boolean, book_id long, last_seen_at timestamp"
NOW = "2024-02-01 00:00:00"


def book(id, **over):
    base = {"id": id, "shop_id": 1, "url": f"https://s/p/title-{id}", "title": f"Title {id}", "author": f"A{id}", "isbn": None, "year": 2000, "format": "hardcover", "type": "book", "category": "c",
            "price_cents": 100, "in_stock": True, "is_active": True, "book_id": None, "last_seen_at": dt.datetime(2024, 1, 30)}
    return tuple((base | over)[c.split()[0]] for c in BOOK.split(", "))


def catalogue():
    return [
        book(1, isbn="9780306406157", book_id=7), book(2, isbn="9780306406157", book_id=7), book(3, title="Twin", author="X", url="https://s/twin-1"), book(4, title="twin", author="x", url="https://s/twin-2"),
        book(5, url="https://s/other-name"), book(6, url="https://s/kale-du-pu-ga", title="Kalėdų pūga"), book(7, price_cents=None), book(8, price_cents=0), book(9, author=None, year=None),
        book(10, author=None, year=None, format=None), book(11, author=None, year=None, category="Žaislai"), book(12, year=1700), book(13, format="10 x 20 cm"), book(14, type="non_book", isbn="9780804429573", book_id=9),
        book(15, is_active=False, price_cents=None), book(16, last_seen_at=dt.datetime(2023, 12, 1)), book(17), book(18), book(19, isbn="9791234567896"), book(20, title="Set (DVD)", url="https://s/set-dvd", author=None, year=None), book(21), book(22),
    ]


def suite(spark, rows):
    known = [(k * 10, 1, r[0], r[2], "product") for k, r in enumerate(rows) if r[0] not in (17, 18, 21)]
    known += [(1001, 1, 18, "https://s/p/title-18", "non_product"), (1002, 1, 21, "https://s/p/title-21", "unreachable"), (1003, 1, 22, "https://s/x/alias", "product"), (1004, 1, 1, rows[0][2], "non_product")]
    urls_ = spark.createDataFrame(known, "id long, shop_id long, shop_book_id long, url string, type string")
    prices = spark.createDataFrame([(r[0],) for r in rows if r[0] != 19], "shop_book_id long")
    owned = spark.createDataFrame([(7, "0306406152", "isbn10"), (9, "9781111111111", "isbn13")], "book_id long, isbn string, isbn_type string")
    return quality.suite(spark.createDataFrame(rows, BOOK), urls_, prices, owned, NOW)


def test_quality_rules(spark):
    got = {}
    for r in quality.check_registered(suite(spark, catalogue())).collect():
        got.setdefault(r.issue, set()).add(r.shop_book_id)
    assert got == {
        "isbn_duplicate": {1, 2}, "title_author_duplicate": {3, 4}, "slug_title_mismatch": {5}, "slug_diacritic_loss": {6}, "active_no_price": {7}, "in_stock_no_price": {7}, "price_zero": {8},
        "book_no_metadata": {9, 10}, "book_no_signals": {10}, "year_out_of_range": {12}, "format_is_dimensions": {13}, "non_book_has_isbn": {14}, "no_price_history": {19}, "non_product_active": {1},
        "stale_active": {16}, "unreachable_active": {21}, "orphan_no_url": {17}, "unmatched_has_isbn": {19}, "match_isbn_drift": {14}, "url_aliases": {22},
    }
    off = [r[:12] + (False,) + r[13:] for r in catalogue()]
    assert suite(spark, off).count() == 0
    with pytest.raises(Exception, match="unregistered"):
        quality.check_registered(spark.createDataFrame([("odd",)], "issue string")).collect()


def test_lifecycle(spark):
    at = lambda day: dt.datetime(2024, 1, day)
    schema = tables.SCHEMAS["validation_issues"]
    rows = [(1, e, "f", "i", "u", "old", 1, 1, 1, s, until, None, at(1) if s == "resolved" else None) for e, s, until in
            [("new", "new", None), ("ack", "acknowledged", None), ("res", "resolved", None), ("woken", "snoozed", at(3)), ("asleep", "snoozed", at(20)), ("gone", "new", None), ("done", "resolved", None)]]
    table = spark.createDataFrame(rows, schema)
    found = spark.createDataFrame([(1, e, "f", "i", "u", "v", s) for e, s in [("new", "new"), ("ack", "new"), ("res", "acknowledged"), ("woken", "new"), ("asleep", "new"), ("fresh", "acknowledged"), ("fresh", "acknowledged")]], "shop_id long, entity string, field string, issue string, url string, raw_value string, initial_state string")
    now = F.lit("2024-01-10").cast("timestamp")
    merged = lifecycle.merge_findings(table, found, F.lit(2), now)
    got = {r.entity: r for r in merged.collect()}
    assert {e: r.state for e, r in got.items()} == {"new": "new", "ack": "acknowledged", "res": "acknowledged", "woken": "new", "asleep": "snoozed", "gone": "resolved", "done": "resolved", "fresh": "acknowledged"}
    assert (got["new"].run_count, got["new"].raw_value, got["gone"].run_count, got["fresh"].first_run, got["res"].resolved_at) == (2, "v", 1, 2, None) and got["gone"].resolved_at == at(10)
    again = {r.entity: (r.state, r.run_count) for r in lifecycle.merge_findings(merged, found, F.lit(3), now).collect()}
    assert all(again[e] == (r.state, r.run_count + (e not in ("gone", "done"))) for e, r in got.items())
    kept = {r.entity: r.state for r in lifecycle.merge_findings(table, found, F.lit(2), now, resolve=False).collect()}
    assert kept["gone"] == "new"


def test_matching_and_merges(spark):
    listings = spark.createDataFrame([(1, 1, "978-0306406157", None, "T", "A", "P2", 2000, dt.datetime(2024, 1, 2)), (2, 2, "9780804429573", None, "Best", "B", None, 2001, dt.datetime(2024, 1, 3)), (3, 1, "9780804429573", None, "Low", "B", "P1", 2001, dt.datetime(2024, 1, 4)), (4, 1, None, 5, "L", "C", None, 1, None)],
                                     "id long, shop_id long, isbn string, book_id long, title string, author string, publisher string, year int, first_seen_at timestamp").withColumn("match_status", F.lit("unmatched"))
    owned = spark.createDataFrame([(5, "9780306406157")], "book_id long, isbn string")
    shops = spark.createDataFrame([(1, None), (2, 90)], "id long, trust int")
    matched = matching.run_matching(listings, owned, shops, 100)
    linked, works = matched.listings, matched.works
    assert [(w.title, w.publisher, w.isbn_type) for w in works.collect()] == [("Best", "P1", "isbn13")]
    got = {r.id: r.book_id for r in linked.collect()}
    assert got[1] == 5 and got[4] == 5 and got[2] == got[3] and got[2] >= 100
    target = spark.createDataFrame([(1, "a", "x", "k"), (2, "b", None, None)], "id long, t string, u string, v string")
    batch = spark.createDataFrame([(2, None, "n", "w"), (3, "c", None, "z")], "id long, t string, u string, v string")
    once = tables.merge(target, batch, ["id"], overwrite=["t"], keep=["v"])
    assert sorted(tuple(r) for r in once.collect()) == [(1, "a", "x", "k", False), (2, None, "n", "w", False), (3, "c", None, "z", True)]
    twice = tables.merge(once.drop("created"), batch, ["id"], overwrite=["t"], keep=["v"])
    assert sorted(tuple(r)[:4] for r in twice.collect()) == sorted(tuple(r)[:4] for r in once.collect())
    folded = ingest.fold_batch(spark.createDataFrame([(1, 1, "a", None), (1, 2, None, "b"), (1, 3, "c", None)], "k long, o long, x string, y string"), ["k"], "o").first()
    assert (folded.x, folded.y) == ("c", "b")


def test_pages(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(["b", "a", "c", None, "a"])], "id long, t string")
    order = [filters.sort_column("t", ("t",)), F.asc("id")]
    pages = [[r.id for r in filters.page(df, order, n, 2).collect()] for n in (1, 2, 3)]
    assert pages == [[1, 4], [0, 2], [3]] and tuple(filters.page_count(df.limit(0), 2).first()) == (0, 1)
    with pytest.raises(ValueError):
        filters.sort_column("x", ("t",))


def test_markdown_and_sitemaps(spark):
    html = "<h2>Head</h2><p>One <b>bold</b>&nbsp;<i>it</i> <a href='/u'>link</a><br>two</p><ul><li>a<li>b</li></ul><ol><li>x</li></ol><table><tr><th>K</th><th>V</th></tr><tr><td>1</td><td>2</td></tr></table>"
    got = x.to_markdown(html)
    assert got.startswith("## Head\n\nOne **bold** *it* [link](/u)\ntwo") and "- a" in got and "- b" in got and "1. x" in got and "| K | V |\n| --- | --- |\n| 1 | 2 |" in got
    assert x.to_markdown(None) is None and x.to_markdown("plain") == "plain"
    bodies = [("http://s/i", '<?xml?><sitemapindex xmlns="n"><sitemap><loc>http://s/sitemap_product_1</loc></sitemap><sitemap><loc>http://s/blog</loc></sitemap></sitemapindex>'),
              ("http://s/sitemap_product_1", "<urlset><url><loc> http://s/a?x=1&amp;y=2 </loc></url><url><loc>http://s/b</loc></url></urlset>"), ("http://s/blog", "<urlset><url><loc>http://s/no</loc></url></urlset>"), ("http://s/bad", "not xml <")]
    pages = spark.createDataFrame(bodies, "url string, body string")
    rows = x.sitemap_urls(pages)
    assert rows.where("kind = 'sitemap'").count() == 2
    assert sorted(r["loc"] for r in x.children(rows, pages).collect()) == ["http://s/a?x=1&y=2", "http://s/b"]
    assert x.feed_items(spark.createDataFrame([('{"p": {"i": [{"a": 1}, {"a": 2}]}}',), ("broken",), (None,)], "body string"), "p struct<i: array<struct<a: int>>>", "p.i").count() == 2


def events(n=400):
    rng = random.Random(1)
    at = dt.datetime(2024, 1, 1)
    return [(k, at + dt.timedelta(seconds=30 * k), rng.randrange(6), rng.random() < 0.5) for k in range(n)]


def replay(spark, df, tmp_path, order, build, mode):
    """Feed the frame as ordered files and return what the streaming query emitted."""
    folder, out = tmp_path / "in", []
    rows = df.orderBy(order).collect()
    for k in range(0, len(rows), 100):
        spark.createDataFrame(rows[k : k + 100], df.schema).coalesce(1).write.mode("append").parquet(str(folder))
    stream = tables.stream_table(spark, str(folder), df.schema.simpleString()[7:-1].replace(":", " "))
    q = build(stream).writeStream.outputMode(mode).foreachBatch(lambda b, n: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return out


def test_streams_equal_batches(spark, tmp_path):
    df = spark.createDataFrame(events(), "event_id long, ts timestamp, user_id long, failed boolean")
    seen = replay(spark, df, tmp_path / "a", "ts", jobs.failure_streak_stream, "update")
    last = {r.user_id: r.streak for r in seen}
    assert last == {r.user_id: r.streak for r in jobs.failure_streaks(df).collect()}
    quiet = spark.createDataFrame([(k, t, u, f) for k, t, u, f in events() if u != 3 or k < 100], df.schema)
    silent = replay(spark, quiet, tmp_path / "b", "ts", lambda s: jobs.silent_stream(s, 3600), "append")
    assert {r.user_id for r in silent} == {3}
    counted = replay(spark, df, tmp_path / "c", "ts", lambda s: jobs.rate(s, size="10 minutes", step="5 minutes"), "append")
    want = {r.start: r.n for r in jobs.rate(df, size="10 minutes", step="5 minutes").collect()}
    assert counted and all(want[r.start] == r.n for r in counted)


def test_price_steps_stream(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randrange(5), dt.datetime(2024, 1, 1) + dt.timedelta(hours=k), rng.choice([100, 110, 120])) for k in range(300)]
    df = spark.createDataFrame(rows, "shop_book_id long, observed_at timestamp, price_cents long")
    got = replay(spark, df, tmp_path, "observed_at", jobs.price_step_stream, "append")
    want = windows.price_steps(df, "2000-01-01").where("previous_cents <> price_cents")
    key = lambda r: (r.shop_book_id, r.observed_at, r.previous_cents, r.price_cents)
    assert sorted(map(key, got)) == sorted(map(key, want.collect()))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 5)), (2, dt.datetime(2024, 1, 2))], "id long, at timestamp")
    for _ in range(2):
        tables.append(df, str(tmp_path / "p"), "at")
    assert spark.read.parquet(str(tmp_path / "p")).groupBy("day").count().count() == 2
    for _ in range(2):
        jobs.append_once(df, 7, str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).count() == 2
    row = [(1, "T", None, "P", 2001, None, None, "book", 4000, True, False), (2, "S", "A", None, None, "1", "f", "book", 1250, False, True)]
    listing = spark.createDataFrame(row, "id long, title string, author string, publisher string, year int, isbn string, format string, type string, price_cents long, in_stock boolean, is_active boolean")
    tables.export_csv(listing, str(tmp_path / "csv"))
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "csv").glob("*.csv")))
    assert b"2,S,A,,,1,f,book,12.5,no,yes\r\n" in data and b"1,T,,P,2001,,,book,40.0,yes,no\r\n" in data
