"""Market days whose candles are stale, kept as state of a stream: a day is computed once, however many batches touch it.

Two queries share the tables. One stores trades and notes the days each batch has touched, a row for each market and day;
the other holds these days by market until they are due, then computes their candles from what is stored. So the state
has a row for each market, and no task sees the trades of a market.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sinks.versions import Tables
from .listener import add_seconds, candles_of_days, days_of

NOTE = "market_id string, trade_date date, last timestamp"
#: Days as numbers since 1970 with the milliseconds at which they are due, and the market's last second in microseconds.
STATE = "days array<int>, due array<long>, last long"


def touched_days(trades: DataFrame) -> DataFrame:
    """(market_id, trade_date, last): the days of trades, each with its last second."""
    return days_of(trades).groupBy("market_id", "trade_date").agg(F.max("executed_at").alias("last"))


def tracker(hold: float | None) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """The step of a market: days become due ``hold`` seconds after the first note of them, at once without ``hold``.

    A day that was handed out and is touched again starts anew. The last second never falls, also if a late day comes.
    """

    def track(key: tuple, notes: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        days, due, last = state.get if state.exists else ([], [], None)
        held = dict(zip(days, due, strict=True))
        now = state.getCurrentProcessingTimeMs() if hold is not None else 0
        for batch in notes:
            for day, second in zip(batch["day"], batch["second"], strict=True):
                held.setdefault(int(day), now + int(1000 * (hold or 0)))
                last = int(second) if last is None else max(last, int(second))
        ready = sorted(day for day, at in held.items() if at <= now)
        left = sorted((day, at) for day, at in held.items() if at > now)
        state.update(([d for d, _ in left], [at for _, at in left], last))
        if left:
            state.setTimeoutDuration(max(1, min(at for _, at in left) - now))
        if ready:
            yield pd.DataFrame({"market_id": [key[0]] * len(ready), "day": pd.array(ready, "Int32"), "second": pd.array([last] * len(ready), "Int64")})

    return track


def due_days(notes: DataFrame, hold: float | None = None) -> DataFrame:
    """(market_id, trade_date, last) of a stream of notes: the days that are due, with the last second of their market.

    With ``hold`` timers hand days out, in batches without notes, too, so a query with it goes on until it is stopped.
    """
    numbers = notes.select("market_id", F.unix_date("trade_date").alias("day"), F.unix_micros("last").alias("second"))
    timeout = GroupStateTimeout.NoTimeout if hold is None else GroupStateTimeout.ProcessingTimeTimeout
    found = numbers.groupBy("market_id").applyInPandasWithState(tracker(hold), "market_id string, day int, second long", STATE, "update", timeout)
    return found.select("market_id", F.date_from_unix_date("day").alias("trade_date"), F.timestamp_micros("second").alias("last"))


def storer(tables: Tables, notes: str, writer: str = "trades") -> Callable[[DataFrame, int], None]:
    """Handler of a micro-batch of trades: they are stored once, then the days they touch are noted.

    A batch that died between the two notes its days when it runs again; a day noted twice is computed twice, which
    changes nothing.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        trades = batch
        if tables.state().batches.get(writer, -1) < batch_id:
            commit = tables.begin()
            if not add_seconds(commit, batch):
                return
            commit.publish_rebased(**{writer: batch_id})
            # Of what it has written two columns are read, of the batch all.
            trades = commit.written("trades")
        folder = f"{notes}/{writer}-{batch_id:010d}"
        if not tables.exists(f"{folder}/_SUCCESS"):
            touched_days(trades).write.mode("append").parquet(folder)

    return handle


def note_stream(spark: SparkSession, notes: str) -> DataFrame:
    return spark.readStream.schema(NOTE).option("recursiveFileLookup", True).parquet(notes)


def computer(tables: Tables, writer: str = "due") -> Callable[[DataFrame, int], None]:
    """Handler of a micro-batch of due days: their candles are computed from the stored trades and become visible at once."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        # The stateful step runs once for each batch, also for one that is known.
        days = tables.parts_of("trades", batch)
        if tables.state().batches.get(writer, -1) >= batch_id or not days:
            return
        commit = tables.begin()
        candles_of_days(commit, days)
        commit.publish_rebased(**{writer: batch_id})

    return handle


def run(trades: DataFrame, tables: Tables, notes: str, checkpoint: str, *, hold: float | None = None) -> list[StreamingQuery]:
    """Store a stream of trades and compute the candles of its days.

    Without ``hold`` all that is there is worked off, first trades, then days, and both queries are at their end; with
    it, both are returned running.
    """
    spark = tables.spark
    tables.make_folder(notes)
    queries = []
    for frame, handle, name in ((trades, storer(tables, notes), "trades"), (due_days(note_stream(spark, notes), hold), computer(tables), "due")):
        writer = frame.writeStream.outputMode("append" if name == "trades" else "update").foreachBatch(handle).option("checkpointLocation", f"{checkpoint}/{name}")
        queries.append((writer.trigger(availableNow=True) if hold is None else writer).start())
        if hold is None:
            queries[-1].awaitTermination()
    return queries
