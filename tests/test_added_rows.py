"""Rows that lie beside partitions: a batch costs as much as its rows, and readers see the newest of each key."""

import json
from datetime import datetime, timedelta
from types import SimpleNamespace

from pyspark.sql import functions as F
from test_dirty_days import trades
from test_sync import rows, stored_candles

from tidewick.operators import candles as ohlc
from tidewick.sinks import versions
from tidewick.streaming import dirty, listener


def test_a_small_batch_rewrites_no_day(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "SMALL", 0)
    first = trades(spark, *[("a", 20 * n) for n in range(4000)], ("b", 1))
    store = versions.Tables(spark, str(tmp_path / "store"), listener.trade_tables(first.schema))
    handle = listener.recompute(store)
    handle(first, 0)
    begun = store.state()
    assert not begun.added["trades"].folders and len(begun.folders["candles"]) == 2
    late = trades(spark, ("a", 7), ("a", 86399))
    # A second that is there, with other trades.
    again = trades(spark, ("a", 20)).selectExpr("id + 1000000 as id", "market_id", "price + 5 as price", "amount", "i_quote_amount * 9 as i_quote_amount", "executed_at").to(first.schema)
    handle(late, 1)
    handle(again, 2)
    now = store.state()
    assert now.folders == begun.folders and len(now.added["trades"].folders) == 2 and now.added["trades"].stale == {("a", "2024-01-01")}
    second = datetime(2024, 1, 1) + timedelta(seconds=20)
    want = first.where(f"not (market_id = 'a' and executed_at = '{second}')").unionByName(late).unionByName(again)
    expected = rows(want), stored_candles(want)
    for folded in (False, True):
        assert (rows(store.read("trades").drop("trade_date")), rows(store.read("candles").select(*ohlc.OUT))) == expected
        if not folded:
            assert rows(store.read("candles", 1).select(*ohlc.OUT)) == stored_candles(first)
            listener.settled(store)
    after = store.state()
    assert not after.added["trades"].folders and after.folders["trades"].keys() == begun.folders["trades"].keys()
    assert after.folders["trades"]["market_id=b/trade_date=2024-01-01"] == begun.folders["trades"]["market_id=b/trade_date=2024-01-01"]
    store.vacuum()
    assert (rows(store.read("trades").drop("trade_date")), rows(store.read("candles").select(*ohlc.OUT))) == expected


def test_a_stored_batch_rewrites_no_day(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "SMALL", 0)
    first, late = trades(spark, *[("a", 20 * n) for n in range(4000)]), trades(spark, ("a", 7))
    store = versions.Tables(spark, str(tmp_path / "store"), listener.trade_tables(first.schema))
    handle = dirty.storer(store, str(tmp_path / "notes"))
    handle(first, 0)
    begun = store.state()
    handle(late, 1)
    now = store.state()
    assert now.folders == begun.folders and len(now.added["trades"].folders) == 1 and not now.added["trades"].stale
    assert store.read("candles").count() == 0 and store.read("trades").count() == 4001
    dirty.computer(store)(dirty.touched_days(late), 0)
    assert rows(store.read("candles").select(*ohlc.OUT)) == stored_candles(first.unionByName(late))


def test_a_stream_folds_seldom_and_reads_each_entry_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "SMALL", 0)
    batches = [trades(spark, *[("a", 7 * n + k) for n in range(300)]) for k in range(6)]
    store = versions.Tables(spark, str(tmp_path / "store"), listener.trade_tables(batches[0].schema))
    handle, folds, loads = listener.recompute(store), [], []
    fold = versions.Commit.fold
    monkeypatch.setattr(versions.Commit, "fold", lambda commit, name: folds.append(name) or fold(commit, name))
    monkeypatch.setattr(versions, "json", SimpleNamespace(dumps=json.dumps, loads=lambda text: loads.append(text) or json.loads(text)))
    for k, batch in enumerate(batches):
        handle(batch, k)
    assert len(folds) == 1 and len(loads) < len(batches)
    want = batches[0]
    for batch in batches[1:]:
        want = want.unionByName(batch)
    assert rows(store.read("candles").select(*ohlc.OUT)) == stored_candles(want)


def test_a_trade_twice_in_a_batch_counts_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "SMALL", 0)
    first, late = trades(spark, *[("a", 20 * n) for n in range(4000)]), trades(spark, ("a", 7), ("b", 9))
    store = versions.Tables(spark, str(tmp_path / "store"), listener.trade_tables(first.schema))
    handle = listener.recompute(store)
    handle(first, 0)
    # The same trade in the same second, and in a later one.
    handle(late.unionByName(late).unionByName(late.selectExpr("id", "market_id", "price", "amount", "i_quote_amount", "executed_at + interval 1 day as executed_at")), 1)
    # A batch without trades adds nothing.
    handle(late.limit(0), 2)
    want = first.unionByName(late)
    assert len(store.state().added["trades"].folders) == 1 and store.state().batches == {"trades": 2}
    for _ in range(2):
        assert (rows(store.read("trades").drop("trade_date")), rows(store.read("candles").select(*ohlc.OUT))) == (rows(want), stored_candles(want))
        listener.settled(store)


def test_a_batch_is_read_once(spark, tmp_path):
    first = trades(spark, *[(m, 20 * n) for n in range(200) for m in ("a", "b")])
    read = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda m: read.add(1) or m, "string").asNondeterministic()
    stores = {}
    for name in ("streamed", "held"):
        stores[name] = versions.Tables(spark, str(tmp_path / name), listener.trade_tables(first.schema))
        handle = listener.recompute(stores[name]) if name == "streamed" else dirty.storer(stores[name], str(tmp_path / "notes"))
        handle(first.withColumn("market_id", seen("market_id")).select(*first.columns), 0)
        assert read.value == 400
        read.value = 0
    assert rows(spark.read.schema(dirty.NOTE).parquet(str(tmp_path / "notes/trades-0000000000"))) == rows(dirty.touched_days(first))
    assert rows(stores["streamed"].read("trades")) == rows(stores["held"].read("trades"))
