"""Dirty market days as state of a stream: each computed when it is due, equal to the batch."""

import time
from datetime import date, datetime, timedelta
from decimal import Decimal

import pandas as pd
import pytest
from test_sync import rows, stored_candles

from tidewick.operators import candles as ohlc
from tidewick.sinks.versions import Commit, Tables
from tidewick.streaming import dirty, listener

KIND = "id long, market_id string, price decimal(18,2), amount decimal(18,0), i_quote_amount decimal(28,2), executed_at timestamp"


def trades(spark, *places):
    """Trades of (market, second)."""
    return spark.createDataFrame([(n, m, Decimal(n % 7 + 1), Decimal(2), Decimal(2 * (n % 7 + 1)), datetime(2024, 1, 1) + timedelta(seconds=n)) for m, n in places], KIND)


class State:
    """A market's state without Spark."""

    def __init__(self):
        self.kept, self.now, self.timer = None, 0, None

    exists = property(lambda self: self.kept is not None)
    get = property(lambda self: self.kept)

    def getCurrentProcessingTimeMs(self):  # noqa: N802
        return self.now

    def update(self, kept):
        self.kept, self.timer = kept, None

    def setTimeoutDuration(self, milliseconds):  # noqa: N802
        self.timer = self.now + milliseconds


def step(track, state, now, *notes):
    state.now = now
    frame = pd.DataFrame(notes, columns=["day", "second"])
    return [pair for out in track(("m",), iter([frame] if notes else []), state) for pair in zip(out["day"], out["second"], strict=True)]


def test_days_are_held_until_they_are_due():
    track, state = dirty.tracker(10), State()
    assert step(track, state, 1000, (5, 50), (6, 60)) == [] and state.timer == 11000
    assert step(track, state, 4000, (5, 55), (7, 70)) == [] and state.timer == 11000
    assert step(track, state, 11000) == [(5, 70), (6, 70)] and state.timer == 14000
    assert step(track, state, 12000, (5, 51)) == [] and state.timer == 14000
    assert step(track, state, 14000) == [(7, 70)] and state.timer == 22000
    assert step(track, state, 30000) == [(5, 70)] and state.timer is None and state.kept == ([], [], 70)


def test_without_hold_days_are_due_at_once():
    track, state = dirty.tracker(None), State()
    assert step(track, state, 0, (5, 50), (5, 52), (4, 40)) == [(4, 52), (5, 52)]
    assert step(track, state, 0) == [] and state.kept == ([], [], 52)


@pytest.fixture
def place(spark, tmp_path):
    landed = str(tmp_path / "landed")
    tables = Tables(spark, str(tmp_path / "store"), listener.trade_tables(trades(spark, ("a", 1)).schema))

    def land(*places):
        trades(spark, *places).coalesce(1).write.mode("append").parquet(landed)

    def stream():
        return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(landed)

    return tables, land, stream, str(tmp_path / "notes"), str(tmp_path / "state")


DAY = 86400


def test_a_restart_a_late_trade_and_a_repeated_batch(spark, place):
    tables, land, stream, notes, state = place
    every = [("a", 1), ("a", 400), ("b", 2), ("a", DAY + 3), ("b", 2 * DAY + 4)]
    land(*every[:3])
    land(*every[3:])
    dirty.run(stream(), tables, notes, state)
    assert rows(tables.read("candles").select(*ohlc.OUT)) == stored_candles(trades(spark, *every))
    before = tables.state()
    late = [("a", 401), ("b", 3 * DAY)]
    land(*late)
    for _ in range(2):  # the second run finds nothing to do
        dirty.run(stream(), tables, notes, state)
        assert rows(tables.read("candles").select(*ohlc.OUT)) == stored_candles(trades(spark, *every, *late))
    after = tables.state()
    changed = {part for part, folder in after.folders["candles"].items() if before.folders["candles"].get(part) != folder}
    assert changed == {"market_id=a/candle_date=2024-01-01", "market_id=b/candle_date=2024-01-04"}
    dirty.storer(tables, notes)(trades(spark, *every[:3]), 0)
    dirty.computer(tables)(spark.createDataFrame([("a", date(2024, 1, 1), None)], dirty.NOTE), 0)
    assert tables.state() == after


@pytest.mark.parametrize("dies", ["before the note", "before the candles"])
def test_what_dies_is_made_up_for(spark, place, monkeypatch, dies):
    tables, land, stream, notes, state = place
    land(("a", 1), ("b", DAY))

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(*((dirty, "touched_days") if dies == "before the note" else (dirty, "candles_of_days")), lost)
        with pytest.raises(Exception, match="lost"):
            dirty.run(stream(), tables, notes, state)
    assert tables.read("trades").count() == 2 and tables.read("candles").count() == 0
    dirty.run(stream(), tables, notes, state)
    assert rows(tables.read("candles").select(*ohlc.OUT)) == stored_candles(trades(spark, ("a", 1), ("b", DAY)))


def test_timers_hand_days_out(spark, place):
    """Without further trades; the two queries commit side by side."""
    tables, land, stream, notes, state = place
    land(("a", 1), ("b", DAY))
    queries, end = dirty.run(stream(), tables, notes, state, hold=3), time.monotonic() + 90
    try:
        while tables.state().batches.get("due") is None and time.monotonic() < end and all(q.isActive for q in queries):
            time.sleep(0.5)
    finally:
        for q in queries:
            q.stop()
    assert rows(tables.read("candles").select(*ohlc.OUT)) == stored_candles(trades(spark, ("a", 1), ("b", DAY)))


def test_commits_of_other_partitions_are_rebased(spark, place):
    tables = place[0]
    one, other, third = tables.begin(), tables.begin(), tables.begin()
    for commit, market in ((one, "a"), (other, "b"), (third, "a")):
        listener.replace_seconds(commit, trades(spark, (market, 1)))
    assert one.publish(x=1) == 1 and other.publish_rebased(y=1) == 2
    with pytest.raises(Exception, match="taken"):
        third.publish_rebased(z=1)
    assert tables.read("trades").count() == 2 and tables.state().batches == {"x": 1, "y": 1}
    assert isinstance(tables.begin(), Commit)
