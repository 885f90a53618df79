"""The event loop: markets, trades, candles and books follow events, batch by batch."""

from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidewick.operators import candles as ohlc
from tidewick.plans.catalog import feed_of
from tidewick.sinks.versions import Commit, Tables
from tidewick.sources import derived, tables
from tidewick.streaming import listener, sync

SPANS = "market_id = 'purchase/usd'"


def events(spark, *pairs):
    return spark.createDataFrame([(f"chain.trade.{kind}", [("market_id", f'"{market}"')]) for kind, market in pairs], tables.schema.EVENT)


@pytest.fixture
def loop(spark, data, tmp_path):
    feed = feed_of(spark, data)
    return feed, sync.tables_of(spark, str(tmp_path / "store"), feed)


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_events_of_a_market_that_their_batch_creates(spark, data, loop):
    feed, store = loop
    handle = sync.handler(feed, store)
    handle(events(spark, ("OrderSavedEvent", "view/usd")), 0)
    assert store.read("orders").count() == 0
    handle(events(spark, ("MarketCreatedEvent", "view/usd"), ("OrderSavedEvent", "view/usd"), ("OrderCanceledEvent", "none/usd")), 1)
    assert store.read("markets").count() == 6
    want = derived.orders(spark, data).where("market_id = 'view/usd'")
    assert rows(store.read("orders")) == rows(want) and store.read("trades").count() == 0


def test_a_repeated_batch_and_trades_that_come_later(spark, data, loop):
    feed, store = loop
    some = sync.Feed(feed.markets, lambda asked: feed.trades(asked).where("executed_at < '2024-01-10 07:00:00'"), feed.orders)
    first, second = sync.handler(some, store), sync.handler(feed, store)
    batch = events(spark, ("MarketCreatedEvent", "x"), ("OrderExecutedEvent", "purchase/usd"))
    for handle in (first, first):
        handle(batch, 0)
        assert rows(store.read("trades").drop("trade_date")) == rows(some.trades(spark.createDataFrame([("purchase/usd", None)], "market_id string, since timestamp")))
    assert store.state().version == 1
    for batch_id in (1, 1, 2):
        second(events(spark, ("OrderExecutedEvent", "purchase/usd")), batch_id)
    trades = derived.trades(spark, data).where(SPANS)
    assert rows(store.read("trades").drop("trade_date")) == rows(trades)
    assert rows(store.read("candles").select(*ohlc.OUT)) == stored_candles(trades)


def stored_candles(trades):
    money = [c for c in ohlc.OUT if c.endswith(("price", "volume")) and c != "average_price"]
    return rows(ohlc.candles(trades).select(*ohlc.OUT).withColumns({c: F.col(c).cast("decimal(38,18)") for c in money}))


def test_the_initial_sync_reads_markets_without_events(spark, data, loop, tmp_path):
    feed, store = loop
    quiet = events(spark).write.json(str(tmp_path / "none")) or tables.event_stream(spark, str(tmp_path / "none"))
    for _ in range(2):
        sync.run(quiet, feed, store, str(tmp_path / "state")).awaitTermination()
        assert rows(store.read("trades").drop("trade_date")) == rows(derived.trades(spark, data))
        assert rows(store.read("candles").select(*ohlc.OUT)) == stored_candles(derived.trades(spark, data))
        assert store.read("markets").count() == 6 and rows(store.read("orders")) == rows(derived.orders(spark, data))


def test_a_market_that_fails_does_not_stop_others(spark, data, loop):
    feed, store = loop
    broken = {"view/usd"}

    def trades(asked):
        found = feed.trades(asked).withColumn("error", F.lit(None).cast("string"))
        return found.withColumn("error", F.when(F.col("market_id").isin(*broken) & (F.col("id") % 7 == 0), "no answer")) if broken else found

    failing = sync.Feed(feed.markets, trades, feed.orders)
    sync.initial_sync(store, failing)
    others = derived.trades(spark, data).where("market_id <> 'view/usd'")
    assert rows(store.read("trades").drop("trade_date")) == rows(others)
    assert [tuple(r) for r in store.read("failures").collect()] == [("view/usd", "history", "no answer")]
    broken.clear()
    sync.handler(failing, store)(events(spark, ("OrderSavedEvent", "click/usd")), 0)
    assert store.read("failures").count() == 0 and rows(store.read("trades").drop("trade_date")) == rows(derived.trades(spark, data))


@pytest.mark.parametrize("dies_at", range(4))
def test_a_batch_that_dies_between_writes(spark, data, loop, monkeypatch, dies_at):
    """Whatever write fails, readers see the version before; the batch then runs again as a whole."""
    feed, store = loop
    some = sync.Feed(feed.markets, lambda asked: feed.trades(asked).where("executed_at < '2024-01-10'"), feed.orders)
    sync.initial_sync(store, some)
    before = {name: rows(store.read(name)) for name in store.tables}
    batch, writes, replace = events(spark, ("MarketCreatedEvent", "x"), ("OrderExecutedEvent", "purchase/usd")), [], Commit.replace

    def dying(self, name, frame):
        if len(writes) == dies_at:
            raise RuntimeError("lost")
        writes.append(name)
        replace(self, name, frame)

    monkeypatch.setattr(Commit, "replace", dying)
    with pytest.raises(RuntimeError, match="lost"):
        sync.handler(feed, store)(batch, 0)
    monkeypatch.setattr(Commit, "replace", replace)
    assert before == {name: rows(store.read(name)) for name in store.tables}
    sync.handler(feed, store)(batch, 0)
    assert rows(store.read("trades").where(SPANS).drop("trade_date")) == rows(derived.trades(spark, data).where(SPANS))


def test_a_late_trade_changes_its_day_only(spark, tmp_path):
    begin = datetime(2024, 1, 1)
    kind = "id long, market_id string, price decimal(18,2), amount decimal(18,0), i_quote_amount decimal(28,2), executed_at timestamp"
    make = lambda *seconds: spark.createDataFrame([(s, "a/b", Decimal(s), Decimal(1), Decimal(s), begin + timedelta(seconds=s)) for s in seconds], kind)
    store = Tables(spark, str(tmp_path / "store"), listener.trade_tables(make(1).schema))
    handle = listener.recompute(store)
    handle(make(100, 90000, 200000), 0)
    untouched = {r for r in store.read("candles").inputFiles() if "2024-01-01" not in r}
    for batch_id in (1, 1, 2):
        handle(make(50), batch_id)
    assert {r for r in store.read("candles").inputFiles() if "2024-01-01" not in r} == untouched
    assert rows(store.read("candles").select(*ohlc.OUT)) == stored_candles(make(100, 90000, 200000, 50))
