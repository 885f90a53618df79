"""The event loop stores a feed's answer only where it is read more than once."""

from test_sync import rows

from tidewick.plans.catalog import feed_of
from tidewick.sources import derived
from tidewick.streaming import sync


def test_books_that_cannot_fail_go_straight_to_their_table(spark, data, tmp_path, monkeypatch):
    feed, names, stored = feed_of(spark, data), [], sync.stored
    store = sync.tables_of(spark, str(tmp_path / "store"), feed)
    monkeypatch.setattr(sync, "stored", lambda frame, name: names.append(name) or stored(frame, name))
    sync.initial_sync(store, feed)
    assert names == ["fetched-trades"]
    assert rows(store.read("orders")) == rows(derived.orders(spark, data))
    assert rows(store.read("trades").drop("trade_date")) == rows(derived.trades(spark, data))
