import json
from datetime import datetime
from decimal import ROUND_HALF_EVEN, Context, Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from tidewick.functions import money, text
from tidewick.operators import assets, book, health, history, requests
from tidewick.operators import articles as feed
from tidewick.sinks import tables as sinks
from tidewick.sources import derived, pages, tables
from tidewick.streaming import listener


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("given, shown", [("0.000000", "0"), ("100", "100"), ("1.500", "1.5"), ("10.0", "10")])
def test_trimming(spark, given, shown):
    assert one(spark, money.trim_zeros(F.lit(given))) == shown


def test_percentages(spark):
    assert one(spark, money.round_percent(F.lit(1.005))) == 1.0
    assert one(spark, money.percent_change(F.lit(Decimal("0")), F.lit(Decimal("5")))) == 0.0


def test_strict_division_rounds_half_to_even(spark):
    df = spark.createDataFrame([(Decimal("0.000000000123"), Decimal(1)), (Decimal(1), Decimal(3)), (Decimal(1), Decimal(0))], "a decimal(38,18), b decimal(38,18)")
    assert [r.x for r in df.select(money.strict_divide("a", "b").alias("x")).collect()] == [Decimal("0.000000000123"), Decimal("0.333333333333333333"), None]


@pytest.mark.parametrize("precision, scale", [(20, 4), (19, 0), (18, 2), (10, 10), (36, 4), (38, 18), (30, 18)])
def test_shifts_by_products_are_shifts_by_text(spark, precision, scale):
    kind = DecimalType(precision, scale)
    values = [Decimal(n).scaleb(-scale) for n in (0, 1, -1, 5, 15, -25, 123456789)]
    rows = spark.createDataFrame([(v, e) for v in values for e in (None, *range(-25, 9))], f"v {kind.simpleString()}, e int")
    found = rows.select("v", "e", money.shift(F.col("v"), F.col("e"), kind).alias("x"), money.shift(F.col("v"), F.col("e")).alias("y")).collect()
    for v, e, x, y in found:
        want = None if e is None else v.scaleb(e).quantize(Decimal(1).scaleb(-18), ROUND_HALF_EVEN, Context(prec=60))
        assert x == y == want


@pytest.mark.parametrize("quote, compat, price", [(6, True, "2"), (7, True, "0.2"), (8, True, "0.02"), (9, True, "0"), (18, True, "0"), (9, False, "0.002"), (18, False, "0.000000000002")])
def test_price_scales(spark, quote, compat, price):
    assert one(spark, assets.display_price(F.lit(Decimal("2")), F.lit(6), F.lit(quote), compat)) == Decimal(price)


def test_quote_amounts_are_cut(spark):
    assert one(spark, assets.quote_amount(F.lit(Decimal("199")).cast("decimal(19,0)"), F.lit(Decimal("0.015")).cast("decimal(18,3)"), F.lit(2))) == Decimal("0.02")


def test_missing_display_unit_raises(spark, data):
    registry = spark.createDataFrame([("c", [([("ua", 0, [])], "ua", "A", "a", "A")])], tables.schema.REGISTRY)
    raw = spark.createDataFrame([(1, "ua", "ua", "buy", Decimal(1), Decimal(1), "m", "t", 0)], "id long, base string, quote string, order_type string, price decimal(18,2), amount decimal(18,0), maker string, taker string, executed_at long")
    with pytest.raises(Exception, match="no display denom"):
        assets.convert_trades(raw, assets.display_units(registry)).collect()


IMAGES = [('<p><img alt="x" src="https://cdn-images/x.png"></p>', "https://cdn-images/x.png"), ('<img src="https://other/x.png">', ""), ("<p>none</p>", "")]


def test_unknown_assets_are_an_error_or_null(spark):
    units = spark.createDataFrame([("ua", "a", 6)], "denom string, display string, exponent int")
    raw = spark.createDataFrame([(1, "ua", "ux", "buy", Decimal("2"), Decimal(5), "m", "t", 0)], "id long, base string, quote string, order_type string, price decimal(20,4), amount decimal(17,0), maker string, taker string, executed_at long")
    with pytest.raises(Exception, match="no display denom for quote asset"):
        assets.convert_trades(raw, units).collect()
    with pytest.raises(Exception, match="no display denom for quote asset"):
        assets.convert_orders(raw, units, "2024-01-01").collect()
    (row,) = assets.convert_trades(raw, units, strict=False).collect()
    assert row.price is None and row.market_id == "ua/ux"


def test_landed_lists(spark, tmp_path):
    (tmp_path / "orders.json").write_text('{"market_id": "a/b", "order_type": "buy", "price": "1.5", "amount": "7"}\n')
    (tmp_path / "markets.json").write_text('{"base": "ua", "quote": "ub", "creator": "me"}\n')
    (tmp_path / "assets.json").write_text('{"chain_name": "c", "assets": [{"base": "ua", "display": "a", "denom_units": [{"denom": "ua", "exponent": 0}, {"denom": "a", "exponent": 6}]}]}')
    assert [tuple(r) for r in tables.raw_orders(spark, str(tmp_path / "orders.json")).collect()] == [("a/b", "buy", "1.5", "7")]
    assert [tuple(r) for r in tables.raw_markets(spark, str(tmp_path / "markets.json")).collect()] == [("ua/ub", "ua", "ub", "me")]
    assert [tuple(r) for r in assets.display_units(tables.registry(spark, str(tmp_path / "assets.json"))).collect()] == [("ua", "a", 6)]


def test_database_tables(spark, tmp_path):
    """Derby comes with Spark; a numeric key splits the table into ranges, and filters and columns reach the database."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = [(i, f"m{i % 3}", Decimal(i) / 2) for i in range(20)]
    spark.createDataFrame(rows, "id long, market_id string, price decimal(18,2)").write.option("createTableColumnTypes", "market_id VARCHAR(64)").jdbc(url, "history", properties=driver)
    whole = tables.jdbc(spark, url, "history", **driver)
    parts = tables.jdbc(spark, url, "history", key="id", bounds=(0, 20), parts=4, **driver)
    assert whole.rdd.getNumPartitions() == 1 and parts.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect())) == rows
    some = parts.where("market_id = 'm1'").select("price")
    assert "EqualTo(market_id,m1)" in some._jdf.queryExecution().executedPlan().toString().replace("\n", "")
    assert sorted(r.price for r in some.collect()) == [Decimal(i) / 2 for i in range(20) if i % 3 == 1]


def test_charts_take_a_market_and_a_length(spark):
    for bad in ({}, {"market_id": "a/b", "minutes": 0}):
        with pytest.raises(ValueError):
            requests.ChartRequest(**bad)


@pytest.mark.parametrize("html, url", IMAGES)
def test_images(spark, html, url):
    assert one(spark, text.first_image(F.lit(html))) == url


def test_short_descriptions_keep_whole_characters(spark):
    short = one(spark, text.shorten(F.lit("é" * 80)))
    assert short == "é" * 75 + "..." and one(spark, text.shorten(F.lit("x" + "é" * 80))) == "x" + "é" * 74 + "..."
    assert one(spark, text.strip_html(F.lit("<script>var a='<p>'</script>a<b>b</b><!-- c -->"))) == "ab"


def test_settings(spark):
    assert one(spark, text.settings(F.lit("a=1,b=2"))) == {"a": "1", "b": "2"}
    assert tables.Settings.from_environment({"HEALTH_NODES": "n1=http://a, n2=http://b"}).nodes == {"n1": "http://a", "n2": "http://b"}


@pytest.mark.parametrize("depth, rows", [(0, 14), (1, 14), (2, 2), (10, 10)])
def test_depth(spark, depth, rows):
    orders = spark.createDataFrame([(i, "a/b", kind, Decimal(i), Decimal(1)) for i in range(1, 8) for kind in ("buy", "sell")], "id long, market_id string, order_type string, price decimal(18,2), amount decimal(18,0)")
    found = book.levels(orders, depth).collect()
    assert len(found) == rows
    best = max((r for r in found if r.order_type == "buy"), key=lambda r: r.position)
    assert best.price == 7 and min((r for r in found if r.order_type == "sell"), key=lambda r: r.position).price == 1


def test_history_of_a_ticker(spark):
    rows = [(i, m, "buy", Decimal(1), Decimal(1), Decimal(1), datetime(2024, 1, 1), "x", "y") for i, m in enumerate(["a/b", "c/d"])]
    trades = spark.createDataFrame(rows, "id long, market_id string, order_type string, amount decimal(18,0), price decimal(18,0), i_quote_amount decimal(18,0), executed_at timestamp, maker string, taker string")
    assert history.history(trades, history.HistoryRequest(ticker_id="a_b")).count() == 1
    assert history.history(trades, history.HistoryRequest(ticker_id="a_b", compat=True)).count() == 2
    with pytest.raises(ValueError):
        history.HistoryRequest()


def test_request_rules():
    assert history.HistoryRequest(market_id="a/b").rows == 500 and history.HistoryRequest(market_id="a/b", limit=9999).rows == 1000
    assert requests.ChartRequest("a/b", minutes=1440, limit=9000).rows == 9000 and requests.ChartRequest("a/b").rows == 500
    for bad in (lambda: requests.ChartRequest("a/b", minutes=7), lambda: requests.ChartRequest("a/b", minutes=5, limit=5001), lambda: requests.BookRequest("a/b", depth=-1), lambda: requests.MarketChoice()):
        with pytest.raises(ValueError):
            bad()
    assert requests.allowed_format("other") == "" and requests.health_minutes(9999, bounded=True) == 720 and requests.health_minutes(0) == 10


def test_nodes(spark):
    lag = health.node_lags(spark.createDataFrame([("a", 100), ("b", 102), ("c", 103)], "name string, height long")).collect()
    assert [(r.ahead, r.behind) for r in lag] == [("c", "a")]
    nobody = health.node_health(spark.createDataFrame([], "name string, height long")).first()
    assert (nobody.is_healthy, nobody.errors) == (False, "")


def test_balances(spark):
    checks = spark.createDataFrame([("pa1", 5, "u"), ("pa2", 5, "u"), ("zz", 5, "u"), ("pa3", 5, "u")], "address string, min_amount long, denom string")
    held = spark.createDataFrame([("pa1", [("u", "4")]), ("pa3", [("u", "5")])], "address string, balances array<struct<denom: string, amount: string>>")
    found = {r.address: (r.is_healthy, r.error) for r in health.check_balances(checks, held, spark.createDataFrame([("pa", "e")], "prefix string, endpoint string")).collect()}
    assert found["pa3"] == (True, "") and found["pa1"][1] == "balance [4] is less than min amount [5]" and found["pa2"][1] == "balance [0] is less than min amount [5]"
    assert found["zz"] == (False, "no endpoint found for provided address")


def test_sinks_are_idempotent(spark, tmp_path):
    trades = derived.trades(spark, "/root/testdata/sf0.001")
    once = sinks.replace_trades(trades, trades.where("id < 100"))
    twice = sinks.replace_trades(once, trades.where("id < 100"))
    assert once.exceptAll(twice).count() == 0 and once.count() == trades.count()
    path = str(tmp_path / "t")
    for _ in range(2):
        sinks.write_partitions(trades.withColumn("d", F.to_date("executed_at")), path, ["market_id", "d"])
    sinks.write_partitions(trades.where("market_id = 'view/usd' and executed_at < '2024-01-02'").withColumn("d", F.to_date("executed_at")), path, ["market_id", "d"])
    assert spark.read.parquet(path).count() == trades.count()


def test_empty_books_stay_unless_cleared(spark):
    old = spark.createDataFrame([("a/b", 1)], "market_id string, n long")
    none = old.where("false")
    assert sinks.replace_books(old, none).count() == 1
    assert sinks.replace_books(old, none, clear_empty=True, synced=old).count() == 0


def test_landed_documents(spark, tmp_path):
    (tmp_path / "prices.json").write_text(json.dumps({"x": {"usd": 1.5}, "y": {"eur": 2.0}}))
    assert [tuple(r) for r in assets.prices(tables.price_maps(spark, str(tmp_path / "prices.json")), "prices", "usd").collect()] == [("x", 1.5, "usd")]
    (tmp_path / "supply.json").write_text(json.dumps({"supply": [{"denom": "u", "amount": "5"}]}))
    assert [tuple(r) for r in assets.coins_of(tables.coin_lists(spark, str(tmp_path / "supply.json"))).collect()] == [("u", "5")]
    (tmp_path / "trades.json").write_text(json.dumps({"market_id": "a/b", "executed_at": "17", "price": "1"}))
    assert tables.raw_trades(spark, str(tmp_path / "trades.json")).first().executed_at == 17
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title>T</title><link>L</link><description>D</description><pubDate>Mon, 01 Jan 2024 00:00:00 GMT</pubDate></item></channel></rss>")
    (article,) = feed.articles(tables.feed(spark, str(tmp_path / "feed.xml"))).collect()
    assert (article.title, article.description, article.author_name, article.publish_date) == ("T", "D", "", datetime(2024, 1, 1))


def test_pages_follow_the_cursor():
    book_of = {"": {"list": [{"executed_at": "9", "price": "3"}, {"executed_at": "8", "price": "2"}], "next_key": "k"}, "k": {"list": [{"executed_at": 8, "price": "1"}, {"executed_at": 7, "price": "0"}]}}
    found = list(pages.Walk({"url": "-"}, "a/b", 8, get=lambda url, market, limit, key: book_of[key]).trades())
    assert [r[3] for r in found] == ["3", "1", "2"] and found[0][0] == "a/b"
    assert [r[1] for r in found] == [9 * pages.PLACES, 8 * pages.PLACES, 8 * pages.PLACES + 1]


def test_events_without_a_known_market_are_skipped(spark):
    events = spark.createDataFrame([("x.OrderSavedEvent", [("market_id", '"a/b"')]), ("x.OrderSavedEvent", [("market_id", '"q/q"')]), ("x.MarketCreatedEvent", []), ("x.Other", [])], tables.schema.EVENT)
    found = listener.dispatch(events, spark.createDataFrame([("a/b",)], "market_id string")).collect()
    assert sorted((r.market_id or "", r.process) for r in found) == [("", "markets"), ("a/b", "orders")]
    assert listener.listen(events, events, "Saved").count() == 4


def test_windowed_stream(spark, tmp_path):
    trades = derived.trades(spark, "/root/testdata/sf0.001")
    path = str(tmp_path / "in")
    trades.write.parquet(path)
    stream = listener.windowed(spark.readStream.schema(trades.schema).parquet(path), 60)
    stream.writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("windows").count() > 100


def test_strict_conversion_raises_whatever_is_read(spark):
    """A missing asset is an error for each column alone and for a count; a left join must not lose the row."""
    raw = spark.createDataFrame([(1, "u1", "u2", "buy", Decimal("1.5"), Decimal(1000000), "m", "t", 0)], "id long, base string, quote string, order_type string, price decimal(20,4), amount decimal(17,0), maker string, taker string, executed_at long")
    for units in ([], [("u1", "d", 6)], [("u2", "d", 6)], [("u1", "d", 6), ("u2", "d", None)]):
        known = spark.createDataFrame(units, "denom string, display string, exponent int")
        for made in (assets.convert_trades(raw, known), assets.convert_orders(raw, known, "2024-01-01")):
            for column in made.columns:
                with pytest.raises(Exception, match="no display denom"):
                    made.select(column).collect()
            with pytest.raises(Exception, match="no display denom"):
                made.count()
        assert assets.convert_trades(raw, known, strict=False).select("price").first().price is None
        assert assets.convert_orders(raw, known, "2024-01-01", strict=False).count() == 1
    both = spark.createDataFrame([("u1", "d", 6), ("u2", "d", 3)], "denom string, display string, exponent int")
    assert assets.convert_trades(raw, both).count() == 1 and assets.convert_trades(raw, both).first().i_quote_amount == 1500


def test_whole_numbers_are_divided_exactly(spark):
    cases = [(w, k) for w in (0, 7, 10**18 - 1, 2**63 - 1, 2**63, 10**37) for k in (0, 1, 6, 18) if w < 10 ** (20 + k)]
    df = spark.createDataFrame([(Decimal(w), k) for w, k in cases], "w decimal(38,0), k int")
    assert [r.x for r in df.select(money.unshifted(F.col("w"), F.col("k")).alias("x")).collect()] == [Decimal(w).scaleb(-k) for w, k in cases]


def test_charts_read_the_days_they_need(spark, data, tmp_path):
    from tidewick.operators import gapfill
    from tidewick.operators.candles import candles
    from tidewick.sinks.tables import write_partitions
    from tidewick.sources import derived

    path = str(tmp_path / "candles")
    write_partitions(candles(derived.trades(spark, data), (15, 60)).withColumn("candle_date", F.to_date("start_at")), path, ["market_id", "candle_date"])
    markets = derived.markets(spark, data).where("market_id = 'view/usd'").cache()
    chart = gapfill.from_table(spark, path, markets, "2024-01-20 12:00:00", 60, 30)
    assert rows_of(chart) == rows_of(gapfill.from_trades(derived.trades(spark, data).where("executed_at <= '2024-01-20 12:00:00'"), markets, "2024-01-20 12:00:00", 60, 30))
    plan = chart._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "candle_date" in plan.split("PartitionFilters", 1)[1]
    # Folders of other days may break without harm: they aren't opened.
    for folder in (tmp_path / "candles").glob("market_id=view*/candle_date=*"):
        if not "2024-01-19" <= folder.name.partition("=")[2] <= "2024-01-20":
            for file in folder.glob("*.parquet"):
                file.write_bytes(b"broken")
    assert rows_of(gapfill.from_table(spark, path, markets, "2024-01-20 12:00:00", 60, 30)) == rows_of(chart)


def test_stored_charts_with_later_candles(spark, data, tmp_path):
    """With ``later`` the newest candles count, whenever they start, and days before the range still aren't opened."""
    from tidewick.operators import gapfill
    from tidewick.operators.candles import candles
    from tidewick.sinks.tables import write_partitions
    from tidewick.sources import derived

    path = str(tmp_path / "candles")
    hours = candles(derived.trades(spark, data), (60,)).cache()
    write_partitions(hours.withColumn("candle_date", F.to_date("start_at")), path, ["market_id", "candle_date"])
    for folder in (tmp_path / "candles").glob("market_id=view*/candle_date=*"):
        if folder.name.partition("=")[2] < "2024-01-19":
            for file in folder.glob("*.parquet"):
                file.write_bytes(b"broken")
    markets = derived.markets(spark, data)
    found = rows_of(gapfill.from_table(spark, path, markets, "2024-01-20 12:00:00", 60, 30, later=True))
    assert found == rows_of(gapfill.gapfilled(hours, markets, "2024-01-20 12:00:00", 60, 30))
    assert found != rows_of(gapfill.from_table(spark, path, markets, "2024-01-20 12:00:00", 60, 30))


def test_ranks_of_groups_over_many_partitions(spark):
    """One group has most rows, ties are broken by id, and null groups are groups."""
    from tidewick.operators.ranks import ranked

    groups = [None, "a", "b", "c"]
    rows = [(groups[0 if k % 50 == 0 else 1 + (k % 10 == 0) + (k % 25 == 0)], k * 7 % 40, k) for k in range(2000)]
    found = ranked(spark.createDataFrame(rows, "g string, v int, id int"), ["g"], [-F.col("v"), F.col("id")])
    want = []
    for g in groups:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        want += [(*r, k + 1, len(mine)) for k, r in enumerate(mine)]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert all("rank_part" in line or "sum(n" in line for line in plan.splitlines() if "Window [" in line)


def test_joined_errors_are_bounded(spark):
    rows = spark.range(500).select(F.format_string("a%03d", F.col("id")).alias("address"), F.lit("u").alias("denom"), F.lit(False).alias("is_healthy"), F.col("id").cast("string").alias("error"))
    first = health.joined_errors(rows.select("address", "error"), ["address"], ",", 3).first()
    assert (first.n_errors, first.errors) == (500, "0,1,2")
    plan = health.joined_errors(rows.select("address", "error"), ["address"], ",", 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=3" in plan
    assert health.balance_health(rows).first().errors.startswith("[a000]: [0]; [a001]: [1]; ")
    with pytest.raises(Exception, match="500 errors are too many"):
        health.balance_health(rows, 499).collect()
    none = health.balance_health(rows.where("is_healthy")).first()
    assert none.is_healthy and none.errors == ""


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))
