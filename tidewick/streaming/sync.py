"""The event loop: what chain events make stale is read again from its source and stored."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from ..sinks.tables import upsert_markets
from ..sinks.versions import Commit, Table, Tables
from ..sources.shared import stored
from .listener import dispatch, store_trades, trade_tables

#: Markets that could not be read or converted, by what was to be done.
FAILURES = StructType([StructField(n, StringType()) for n in ("market_id", "process", "error")])


@dataclass(frozen=True)
class Feed:
    """Where stale tables are read from.

    What reads trades or orders may have a column ``error``: a row with one says that its market could not be read whole.
    """

    #: All markets.
    markets: Callable[[], DataFrame]
    #: Trades of markets (market_id, since), from the second ``since`` on, which is included; all where it is null.
    trades: Callable[[DataFrame], DataFrame]
    #: Price levels of markets (market_id).
    orders: Callable[[DataFrame], DataFrame]


def tables_of(spark: SparkSession, folder: str, feed: Feed) -> Tables:
    """The tables of the loop; all but markets and failures are partitioned by market, trades and candles by day, too."""
    plain = lambda rows: StructType([f for f in rows.schema.fields if f.name != "error"])
    markets = feed.markets()
    trades = feed.trades(markets.select("market_id", F.lit(None).cast("timestamp").alias("since")))
    orders = feed.orders(markets.select("market_id"))
    return Tables(spark, folder, {"markets": Table(markets.schema), **trade_tables(plain(trades)), "orders": Table(plain(orders), ("market_id",)), "failures": Table(FAILURES)})


def sync_markets(commit: Commit, feed: Feed) -> None:
    """New markets are added, known ones get the time of their sync."""
    commit.replace("markets", upsert_markets(commit.read("markets"), feed.markets()))


def resume(trades: DataFrame, markets: DataFrame) -> DataFrame:
    """(market_id, since): the second of each market's last stored trade, which is read again, or null."""
    last = trades.join(F.broadcast(markets), "market_id", "left_semi").groupBy("market_id").agg(F.max("executed_at").alias("since"))
    return markets.join(last, "market_id", "left")


def without_failed(rows: DataFrame, process: str) -> tuple[DataFrame, DataFrame]:
    """The rows of markets that were read whole, and the failures of the others, one for each."""
    if "error" not in rows.columns:
        return rows, rows.sparkSession.createDataFrame([], FAILURES)
    failed = rows.where("error is not null").groupBy("market_id").agg(F.min("error").alias("error")).select("market_id", F.lit(process).alias("process"), "error")
    return rows.join(failed, "market_id", "left_anti").drop("error"), failed


def refresh(commit: Commit, feed: Feed, pairs: DataFrame) -> None:
    """Read and store the trades, candles and books that pairs (market_id, process) name.

    A market that fails keeps what is stored of it and doesn't stop the others; it is listed among the failures until it
    is read again.
    """
    asked = lambda process: pairs.where(F.col("process") == process).select("market_id").distinct()
    failures = []
    traded = asked("history")
    if not traded.isEmpty():
        # The feed's answer is stored once: what is written and what candles are made of has to be the same.
        found, failed = without_failed(stored(feed.trades(resume(commit.read("trades"), traded)), "fetched-trades"), "history")
        failures.append(failed)
        if not found.isEmpty():
            store_trades(commit, found)
    ordered = asked("orders")
    if not ordered.isEmpty():
        books = feed.orders(ordered)
        # Books that can't fail are read once, so they go straight to their table.
        found, failed = without_failed(stored(books, "fetched-orders") if "error" in books.columns else books, "orders")
        failures.append(failed)
        commit.replace("orders", found)
    if failures:
        others = commit.read("failures").join(pairs.select("market_id", "process"), ["market_id", "process"], "left_anti")
        for failed in failures:
            others = others.unionByName(failed)
        commit.replace("failures", others)


def initial_sync(tables: Tables, feed: Feed) -> int:
    """Read all markets from their last stored second on, also those that no event names; one commit."""
    commit = tables.begin()
    sync_markets(commit, feed)
    every = commit.read("markets").select("market_id", F.explode(F.array(F.lit("history"), F.lit("orders"))).alias("process"))
    refresh(commit, feed, every)
    return commit.publish()


def handler(feed: Feed, tables: Tables, writer: str = "events") -> Callable[[DataFrame, int], None]:
    """Handler of a micro-batch of events.

    Markets come first, so that the events of a market that a batch creates find it; then the trades and candles of
    markets with executed orders, then the books of all markets that orders concern. What failed before is tried again.
    All becomes visible in one commit that also says which batch it was, so a batch that runs again changes nothing.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        if tables.state().batches.get(writer, -1) >= batch_id:
            return
        commit = tables.begin()
        listed = F.element_at(F.split("type", r"\."), -1) == "MarketCreatedEvent"
        if not batch.where(listed).isEmpty():
            sync_markets(commit, feed)
        again = commit.read("failures").select("market_id", "process")
        pairs = stored(dispatch(batch, commit.read("markets")).unionByName(again).distinct(), "stale")
        refresh(commit, feed, pairs)
        commit.publish(**{writer: batch_id})

    return handle


def run(events: DataFrame, feed: Feed, tables: Tables, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Sync all markets, then start the loop on a stream of events: a backfill of all that is there, or continuously."""
    initial_sync(tables, feed)
    writer = events.writeStream.foreachBatch(handler(feed, tables)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
