"""The registered queries: operators over the tables derived from a folder of generated data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html
from ..functions.buckets import LENGTHS, at, bucket_end, bucket_start, from_millis, minutes_before
from ..functions.money import percent_change, round_percent
from ..functions.text import first_image, shorten, strip_html
from ..operators import assets, book, documents, gapfill, health, history, tickers
from ..operators import articles as feed
from ..operators import candles as ohlc
from ..operators.requests import BookRequest, ChartRequest
from ..sinks import tables as sinks
from ..sinks.versions import Tables
from ..sources import derived, tables
from ..sources.shared import shared_path
from ..streaming import dirty, listener, sync
from .oracle import AS_OF, AS_OF_ALIGNED

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def ntz(rows: DataFrame) -> DataFrame:
    """Times as wall-clock times in UTC, decimals as doubles: types that compare across engines."""
    out = {}
    for name, kind in rows.dtypes:
        if kind == "timestamp":
            out[name] = F.col(name).cast("timestamp_ntz")
        elif kind.startswith("decimal"):
            out[name] = F.col(name).cast("double")
    return rows.withColumns(out) if out else rows


def _candles(spark: SparkSession, sf_dir: str, *lengths: int) -> DataFrame:
    return ohlc.candles(derived.trades(spark, sf_dir), lengths or LENGTHS)


def _of_length(length: int) -> Query:
    return lambda spark, sf_dir: ntz(_candles(spark, sf_dir, length))


QUERIES |= {f"candles_{n}m": _of_length(n) for n in LENGTHS}


@query
def candles_all_lengths(spark, sf_dir):
    return ntz(_candles(spark, sf_dir))


@query
def candles_since(spark, sf_dir):
    return ntz(ohlc.candles_since(derived.trades(spark, sf_dir), minutes_before(AS_OF, 24 * 60), (60,)))


@query
def trading_view_all(spark, sf_dir):
    return ohlc.trading_view(_candles(spark, sf_dir), "market_id", "length")


def _filled(spark, sf_dir, as_of, length, limit):
    return gapfill.from_trades(derived.trades(spark, sf_dir), derived.markets(spark, sf_dir), as_of, length, limit)


@query
def intervals_gapfilled(spark, sf_dir):
    return ntz(_filled(spark, sf_dir, AS_OF, 5, 500))


@query
def intervals_gapfilled_aligned(spark, sf_dir):
    return ntz(_filled(spark, sf_dir, AS_OF_ALIGNED, 60, 10))


@query
def intervals_gapfilled_days(spark, sf_dir):
    return ntz(_filled(spark, sf_dir, AS_OF, 1440, 5000))


@query
def intervals_tradingview(spark, sf_dir):
    return ohlc.trading_view(_filled(spark, sf_dir, AS_OF, 15, 500), "market_id")


@query
def chart_request(spark, sf_dir):
    """A chart as it is asked for, under its public names."""
    request = ChartRequest(ticker_id="click_usd", minutes=60, limit=100)
    hours = ohlc.candles_since(derived.trades(spark, sf_dir), minutes_before(AS_OF, 60 * (request.rows + 1)), (60,))
    return ntz(gapfill.chart(hours, derived.markets(spark, sf_dir), request, AS_OF))


@query
def charts_stored(spark, sf_dir):
    """Charts from a stored table of candles of all lengths, of which only the days that they need are read."""
    path = shared_path(spark, "candles")
    sinks.write_partitions(_candles(spark, sf_dir).withColumn("candle_date", F.to_date("start_at")), path, ["market_id", "candle_date"])
    return ntz(gapfill.from_table(spark, path, derived.markets(spark, sf_dir), AS_OF, 15, 100, later=True))


@query
def candles_latest(spark, sf_dir):
    """Candles that two syncs stored twice, each once, as the later one left it."""
    hours = _candles(spark, sf_dir, 60).withColumn("i_created_at", at(AS_OF_ALIGNED)).withColumn("i_updated_at", F.lit(None).cast("timestamp"))
    again = hours.where("start_at >= '2024-01-10'").withColumn("i_updated_at", at(AS_OF)).withColumn("close_price", F.col("close_price") + 1)
    rows = ohlc.latest(hours.unionByName(again.withColumn("close_price", F.col("close_price").cast(hours.schema["close_price"].dataType))))
    return ntz(rows.select("market_id", "start_at", "close_price", "i_updated_at"))


@query
def market_creation(spark, sf_dir):
    return ntz(history.created_at(derived.trades(spark, sf_dir)))


def _tickers(spark, sf_dir):
    trades = derived.trades(spark, sf_dir)
    return tickers.tickers(derived.markets(spark, sf_dir), trades, ohlc.candles_since(trades, minutes_before(AS_OF, 60 * tickers.HOURS), (5,)), derived.orders(spark, sf_dir), AS_OF)


@query
def tickers_24h(spark, sf_dir):
    return _tickers(spark, sf_dir)


@query
def tickers_coingecko(spark, sf_dir):
    return tickers.listing_tickers(_tickers(spark, sf_dir))


@query
def tickers_json_round_trip(spark, sf_dir):
    rows = _tickers(spark, sf_dir)
    fields = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    return documents.from_documents(documents.to_documents(rows), fields)


@query
def candles_trimmed(spark, sf_dir):
    """Candles as they are stored and shown: decimals as text without trailing zeros."""
    rows = _candles(spark, sf_dir).select("market_id", "length", "start_at", "lowest_price", "open_price", "highest_price", "close_price", "base_volume", "quote_volume")
    return ntz(assets.shown_amounts(rows, *rows.columns[3:]))


@query
def time_buckets(spark, sf_dir):
    """Each trade with the start of its bucket of every length, its day and its time in milliseconds and seconds."""
    trades = derived.trades(spark, sf_dir)
    starts = [bucket_start(F.col("executed_at"), n).alias(f"start_{n}") for n in LENGTHS]
    end = bucket_end(bucket_start(F.col("executed_at"), 60), 60).alias("end_60")
    return ntz(trades.select("id", *starts, end, F.unix_millis("executed_at").alias("millis"), from_millis(F.unix_millis("executed_at")).alias("again")))


@query
def price_change(spark, sf_dir):
    return ntz(_candles(spark, sf_dir).select("market_id", "length", "start_at", round_percent(percent_change(F.col("open_price"), F.col("close_price"))).alias("change")))


@query
def last_price_per_market(spark, sf_dir):
    rows = tickers.markets_with_last_price(derived.markets(spark, sf_dir), derived.trades(spark, sf_dir), AS_OF)
    return ntz(rows.select("id", "market_id", "base", "quote", "last_price"))


@query
def market_lookup(spark, sf_dir):
    return ntz(derived.markets(spark, sf_dir).where("market_id = 'view/usd'").select("id", "market_id", "base", "i_created_at"))


@query
def first_trade_per_market(spark, sf_dir):
    return ntz(history.first_trades(derived.trades(spark, sf_dir)))


@query
def oldest_unprocessed(spark, sf_dir):
    return ntz(history.oldest_unprocessed(derived.trades(spark, sf_dir)))


@query
def trades_since(spark, sf_dir):
    return ntz(history.since(derived.trades(spark, sf_dir), at("2024-01-15 00:00:00")).select("id", "market_id", "price", "executed_at"))


@query
def dirty_days(spark, sf_dir):
    return ntz(sinks.dirty_days(derived.trades(spark, sf_dir)))


@query
def order_book_depth(spark, sf_dir):
    return ntz(book.levels(derived.orders(spark, sf_dir), 20))


@query
def order_book_full(spark, sf_dir):
    return ntz(book.levels(derived.orders(spark, sf_dir), 1))


def _joined(c):
    return F.array_join(F.transform(c, lambda x: F.concat(x["price"], F.lit(":"), x["volume"])), ",").alias(c)


@query
def order_book_documents(spark, sf_dir):
    return book.books(derived.orders(spark, sf_dir), AS_OF, 20).select("market_id", _joined("bids"), _joined("asks"), "timestamp")


@query
def order_book_coingecko(spark, sf_dir):
    pairs = lambda c: F.array_join(F.transform(c, lambda x: F.array_join(x, ":")), ",").alias(c)
    return book.listing_books(book.books(derived.orders(spark, sf_dir), AS_OF, 10)).select("ticker_id", pairs("bids"), pairs("asks"), "timestamp")


@query
def book_request(spark, sf_dir):
    """A book as it is asked for, in the listing format."""
    pairs = lambda c: F.array_join(F.transform(c, lambda x: F.array_join(x, ":")), ",").alias(c)
    rows = book.requested(derived.orders(spark, sf_dir), BookRequest(market_id="view/usd", depth=10, format="coingecko"), AS_OF)
    return rows.select("ticker_id", pairs("bids"), pairs("asks"), "timestamp")


@query
def best_bid_ask(spark, sf_dir):
    return ntz(book.best_prices(derived.orders(spark, sf_dir)))


def _history(spark, sf_dir, **request):
    return history.history(derived.trades(spark, sf_dir), history.HistoryRequest(**request))


@query
def history_filtered(spark, sf_dir):
    # 2024-01-05 and 2024-01-25 in milliseconds
    return history.trade_rows(_history(spark, sf_dir, market_id="view/usd", order_type="buy", start_time=1704412800000, end_time=1706140800000, limit=5000))


@query
def history_default(spark, sf_dir):
    return history.trade_rows(_history(spark, sf_dir, ticker_id="click_usd", order_type="neither", start_time=1))


@query
def history_by_address(spark, sf_dir):
    return history.trade_rows(_history(spark, sf_dir, address="17", limit=1000))


@query
def history_all_markets(spark, sf_dir):
    """A request by ticker alone in compatible mode: no market filter."""
    return history.trade_rows(_history(spark, sf_dir, ticker_id="click_usd", compat=True, limit=700))


@query
def history_buy_sell(spark, sf_dir):
    return history.listing_rows(_history(spark, sf_dir, market_id="click/usd"))


@query
def history_arrays(spark, sf_dir):
    rows = history.buys_and_sells(history.listing_rows(_history(spark, sf_dir, market_id="click/usd")))
    ids = lambda c: F.array_join(F.transform(c, lambda x: x["trade_id"].cast("string")), ",").alias(f"{c}s")
    return rows.select(ids("buy"), ids("sell"))


@query
def market_health(spark, sf_dir):
    return ntz(health.market_health(derived.markets(spark, sf_dir), derived.trades(spark, sf_dir), "2024-01-29 06:00:00", 0))


@query
def aggregator_health(spark, sf_dir):
    return ntz(health.aggregator_health(derived.trades(spark, sf_dir), "2024-01-29 06:00:00", 5000))


@query
def node_lag(spark, sf_dir):
    return health.node_lags(derived.nodes(spark, sf_dir))


@query
def node_health(spark, sf_dir):
    return health.node_health(derived.nodes(spark, sf_dir))


def _checks(spark, sf_dir):
    return health.check_balances(derived.balance_checks(spark, sf_dir), derived.balances(spark, sf_dir), derived.prefixes(spark, sf_dir))


@query
def balance_checks(spark, sf_dir):
    return _checks(spark, sf_dir)


@query
def balance_health(spark, sf_dir):
    return health.balance_health(_checks(spark, sf_dir))


def _units(spark, sf_dir):
    return assets.display_units(derived.registry(spark, sf_dir))


@query
def asset_units(spark, sf_dir):
    return _units(spark, sf_dir)


@query
def supply_total(spark, sf_dir):
    return assets.total_supply(assets.coins_of(derived.supply(spark, sf_dir)), _units(spark, sf_dir))


@query
def supply_circulating(spark, sf_dir):
    coins, pool = assets.coins_of(derived.supply(spark, sf_dir)), assets.coins_of(derived.pool(spark, sf_dir), "pool")
    return assets.circulating_supply(coins, pool, _units(spark, sf_dir), "unation_7")


@query
def prices_flatten(spark, sf_dir):
    landed = derived.price_maps(spark, sf_dir).select(F.from_json("document", "map<string, map<string, double>>").alias("prices"))
    return assets.prices(landed, "prices", "eur")


def _converted(spark, sf_dir):
    return assets.convert_trades(derived.raw_trades(spark, sf_dir), _units(spark, sf_dir))


@query
def unit_conversion(spark, sf_dir):
    return _converted(spark, sf_dir).select("id", "market_id", F.col("price").cast("double").alias("price"), F.col("amount").cast("double").alias("amount"))


@query
def unit_conversion_compat(spark, sf_dir):
    rows = assets.convert_trades(derived.raw_trades(spark, sf_dir), _units(spark, sf_dir), compat=True)
    return rows.groupBy("market_id").agg(F.count("*").alias("trades"), F.max("price").cast("double").alias("highest"), F.max("i_quote_amount").cast("double").alias("largest"))


@query
def quote_amount(spark, sf_dir):
    return _converted(spark, sf_dir).select("id", "market_id", F.col("i_quote_amount").cast("double").alias("quote_amount"))


@query
def order_conversion(spark, sf_dir):
    raw = derived.raw_trades(spark, sf_dir).select("id", "base", "quote", "order_type", "price", "amount")
    rows = assets.convert_orders(raw, _units(spark, sf_dir), AS_OF)
    return rows.groupBy("market_id", "order_type").agg(F.count("*").alias("levels"), F.min("price").cast("double").alias("lowest"), F.max("price_dec").alias("highest"))


def _rows(converted: DataFrame, *names: str) -> DataFrame:
    money = [F.col(c).cast("double").alias(c) for c in ("price", "amount", "i_quote_amount")]
    return converted.select("id", "market_id", *names, *money)


@query
def unit_conversion_compat_rows(spark, sf_dir):
    """All trades that :func:`unit_conversion_compat` sums up."""
    return _rows(assets.convert_trades(derived.raw_trades(spark, sf_dir), _units(spark, sf_dir), compat=True))


@query
def order_conversion_rows(spark, sf_dir):
    """All levels that :func:`order_conversion` sums up."""
    raw = derived.raw_trades(spark, sf_dir).select("id", "base", "quote", "order_type", "price", "amount")
    return _rows(assets.convert_orders(raw, _units(spark, sf_dir), AS_OF), "order_type")


@query
def strip_html_pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", strip_html(F.col("html")).alias("text"))


QUERIES["strip_html"] = QUERIES.pop("strip_html_pages")


@query
def visible_text(spark, sf_dir):
    """The text of pages as browsers tell it from markup, with character references resolved."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", html.visible_text(F.col("html")).alias("text"))


@query
def short_description(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", shorten(strip_html(F.col("html"))).alias("description"))


@query
def shorten_documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", shorten(F.col("text")).alias("short"))


@query
def img_extract(spark, sf_dir):
    items = derived.feed_items(spark, sf_dir)
    return items.select("position", first_image(F.coalesce(F.nullif("content", F.lit("")), "description")).alias("picture_url"))


@query
def articles(spark, sf_dir):
    return ntz(feed.articles(derived.feed_items(spark, sf_dir)))


@query
def event_dispatch(spark, sf_dir):
    return listener.dispatch(derived.events(spark, sf_dir), derived.markets(spark, sf_dir))


@query
def event_listen(spark, sf_dir):
    """Two subscriptions as one, filtered by a part of the type."""
    events = derived.events(spark, sf_dir)
    heard = listener.listen(events, events.where(F.col("type").endswith("ExecutedEvent")), "trade.Order")
    return heard.select("type", listener.event_market().alias("market_id")).groupBy("type", "market_id").agg(F.count("*").alias("n"))


@query
def event_listen_rows(spark, sf_dir):
    """All events that :func:`event_listen` counts."""
    events = derived.events(spark, sf_dir)
    heard = listener.listen(events, events.where(F.col("type").endswith("ExecutedEvent")), "trade.Order")
    return heard.select(F.col("attributes")[0]["value"].alias("event_id"), "type", listener.event_market().alias("market_id"))


@query
def upsert_candles(spark, sf_dir):
    hours = _candles(spark, sf_dir, 60)
    old = hours.where("start_at < '2024-01-20'").withColumn("i_created_at", at("2024-01-01 00:00:00")).withColumn("i_updated_at", F.lit(None).cast("timestamp"))
    rows = sinks.upsert_candles(old, hours.where("start_at >= '2024-01-10'"), AS_OF)
    return ntz(rows.select("market_id", "start_at", "close_price", "i_created_at", "i_updated_at"))


@query
def replace_trades(spark, sf_dir):
    trades = derived.trades(spark, sf_dir)
    rows = sinks.replace_trades(trades, trades.where("executed_at >= '2024-01-20'"))
    return ntz(rows.select("id", "market_id", "executed_at", "i_added_to_interval"))


@query
def replace_books(spark, sf_dir):
    orders = derived.orders(spark, sf_dir)
    new = orders.where("market_id in ('click/usd', 'view/usd') and order_type = 'buy'").withColumn("amount", (F.col("amount") * 2).cast(orders.schema["amount"].dataType))
    return ntz(sinks.replace_books(orders, new).select("market_id", "order_type", "price", "amount"))


@query
def mark_processed(spark, sf_dir):
    trades = derived.trades(spark, sf_dir)
    return sinks.mark_processed(trades, trades.where("order_type = 'buy'")).select("id", "i_added_to_interval")


@query
def upsert_markets(spark, sf_dir):
    known = derived.markets(spark, sf_dir)
    old, new = known.where("id <= 4"), known.where("id >= 3").withColumn("i_created_at", at(AS_OF)).withColumn("created_by", F.lit("sync"))
    return ntz(sinks.upsert_markets(old, new).select("id", "market_id", "created_by", "i_created_at"))


#: Trades of a landed file, about.
FILE_ROWS = 50_000


def scattered(trades: DataFrame, file_rows: int = FILE_ROWS) -> DataFrame:
    """Trades in no order of time, in at least three partitions whose size doesn't grow with the table; those of a market
    and second, which a batch replaces together, stay together."""
    late = F.unix_seconds("executed_at") % 5 == 0
    return trades.repartition(max(3, -(-trades.count() // file_rows)), late, "market_id", "executed_at")


@query
def candles_streamed(spark, sf_dir):
    """Candles of a stream of trades that lands in several files, in no order of time, by recomputing touched days."""
    landed, folder, state = (shared_path(spark, f"stream-{n}") for n in ("landed", "store", "state"))
    trades = derived.trades(spark, sf_dir)
    scattered(trades).write.parquet(landed)
    stream = spark.readStream.schema(trades.schema).option("maxFilesPerTrigger", 1).parquet(landed)
    stored = Tables(spark, folder, listener.trade_tables(trades.schema))
    listener.run(stream, stored, state).awaitTermination()
    return ntz(listener.settled(stored).read("candles").select(*ohlc.OUT))


@query
def candles_held(spark, sf_dir):
    """Candles of the same stream by dirty days that are kept as state, each computed once after all trades are stored."""
    landed, folder, notes, state = (shared_path(spark, f"held-{n}") for n in ("landed", "store", "notes", "state"))
    trades = derived.trades(spark, sf_dir)
    scattered(trades).write.parquet(landed)
    stream = spark.readStream.schema(trades.schema).option("maxFilesPerTrigger", 1).parquet(landed)
    stored = Tables(spark, folder, listener.trade_tables(trades.schema))
    dirty.run(stream, stored, notes, state)
    return ntz(stored.read("candles").select(*ohlc.OUT))


def feed_of(spark: SparkSession, sf_dir: str) -> sync.Feed:
    """The derived tables as what the event loop reads from; the markets asked for are broadcast, as one has many rows."""

    def trades(asked: DataFrame) -> DataFrame:
        return derived.trades(spark, sf_dir).join(F.broadcast(asked), "market_id").where("since is null or executed_at >= since").drop("since")

    return sync.Feed(lambda: derived.markets(spark, sf_dir), trades, lambda asked: derived.orders(spark, sf_dir).join(F.broadcast(asked), "market_id", "left_semi"))


@query
def listener_streamed(spark, sf_dir):
    """What the event loop has stored after the initial sync and all events of a stream: the rows of each table."""
    landed, folder, state = (shared_path(spark, f"listener-{n}") for n in ("landed", "store", "state"))
    derived.events(spark, sf_dir).repartition(3).write.json(landed)
    feed = feed_of(spark, sf_dir)
    stored = sync.tables_of(spark, folder, feed)
    sync.run(tables.event_stream(spark, landed, 1), feed, stored, state).awaitTermination()
    none = F.lit(None)
    parts = {"markets": ("id", "i_created_at", none, none), "trades": ("id", "executed_at", "price", "amount"), "candles": ("length", "start_at", "close_price", "base_volume"), "orders": ("id", none, "price", "amount")}
    rows = [
        stored.read(name).select(F.lit(name).alias("stored"), "market_id", *[(F.col(c) if isinstance(c, str) else c).cast(t).alias(n) for c, n, t in zip(columns, ("number", "at", "price", "amount"), ("long", "timestamp_ntz", "double", "double"), strict=True)])
        for name, columns in parts.items()
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
