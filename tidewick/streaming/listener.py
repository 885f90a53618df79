"""Events to tables with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DateType, StructField, StructType

from .. import schema
from ..functions.text import unquoted
from ..operators.candles import candles
from ..sinks.versions import Added, Commit, State, Table, Tables
from ..sources.shared import stored

#: What an event makes stale, by the last part of its type.
STALE = {
    "MarketCreatedEvent": ("markets",),
    "OrderExecutedEvent": ("history", "candles", "orders"),
    "OrderCanceledEvent": ("orders",),
    "OrderSavedEvent": ("orders",),
}


def event_market(attributes="attributes"):
    """The market an event names: the first attribute market_id, without quotes."""
    return unquoted(F.get(F.filter(attributes, lambda a: a["key"] == "market_id"), 0)["value"])


def dispatch(events: DataFrame, markets: DataFrame) -> DataFrame:
    """(market_id, process) pairs that events make stale, each once; works on streams and tables.

    Events of unknown markets are skipped; a new market concerns the list of markets, whatever it is.
    """
    kinds = F.create_map(*[x for k, v in STALE.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    process = F.explode(F.try_element_at(kinds, F.element_at(F.split("type", r"\."), -1))).alias("process")
    rows = events.select(event_market().alias("event_market"), process).select(F.when(F.col("process") != "markets", F.col("event_market")).alias("market_id"), "process")
    # Pairs are few: each once before they meet the markets, no task sorts the events of a market.
    pairs = rows.distinct()
    known = pairs.where("process <> 'markets'").join(markets.select("market_id"), "market_id", "left_semi")
    return known.unionByName(pairs.where("process = 'markets'"))


def listen(blocks: DataFrame, transactions: DataFrame, contains: str) -> DataFrame:
    """Both subscriptions as one stream of the events whose type contains a text."""
    return blocks.unionByName(transactions).where(F.col("type").contains(contains))


def days_of(trades: DataFrame) -> DataFrame:
    return trades.withColumn("trade_date", F.to_date("executed_at"))


def trade_tables(trades: StructType) -> dict[str, Table]:
    """The tables of trades of a schema and of their candles, both by market and day.

    Trades of a market's second count as their newest batch has them.
    """
    dated = StructType([*trades.fields, StructField("trade_date", DateType())])
    candle = StructType([*schema.CANDLES.fields, StructField("candle_date", DateType())])
    return {"trades": Table(dated, ("market_id", "trade_date"), ("executed_at", "market_id"), once=("id", "market_id")), "candles": Table(candle, ("market_id", "candle_date"), view=current_candles)}


def dated(days: frozenset[tuple]) -> frozenset[tuple]:
    """Days that have a market and a date."""
    return frozenset(day for day in days if None not in day)


def day_candles(trades: DataFrame) -> DataFrame:
    """Candles with their day; no candle crosses a day."""
    return candles(trades.drop("trade_date")).withColumn("candle_date", F.to_date("start_at"))


def current_candles(rows: DataFrame, tables: Tables, state: State) -> DataFrame:
    """Stored candles, and in place of those of stale days what the trades of the same version make."""
    stale = dated(state.added.get("trades", Added()).stale)
    if not stale:
        return rows
    # Candles take several scans, for which trades beside their partitions are merged once.
    again = day_candles(stored(tables.read_state("trades", state, stale), "stale-trades"))
    days = tables.parts_frame("trades", stale).withColumnRenamed("trade_date", "candle_date")
    kept = rows.join(F.broadcast(days), ["market_id", "candle_date"], "left_anti").select(*rows.columns)
    return kept.unionByName(again.select(*[again[c].cast(rows.schema[c].dataType).alias(c) for c in rows.columns]))


def replace_seconds(commit: Commit, new: DataFrame) -> frozenset[tuple]:
    """Store trades in place of those of the same markets and seconds, and return the days (market_id, trade_date) they touch.

    A batch that comes again changes nothing. Trades are partitioned by market and day: a late trade rewrites one market's
    day only. ``new`` is read several times and has to be the same each time.
    """
    settle(commit)
    new = days_of(new)
    touched = dated(commit.tables.parts_of("trades", new))
    rows = new.dropDuplicates(["market_id", "id"])
    if commit.holds("trades", touched):
        seconds = new.select("market_id", "trade_date", "executed_at").distinct()
        rows = commit.read("trades", touched).join(seconds, ["market_id", "trade_date", "executed_at"], "left_anti").unionByName(rows)
    commit.replace("trades", rows)
    return touched


def add_seconds(commit: Commit, new: DataFrame, *, stale: bool = False) -> frozenset[tuple]:
    """:func:`replace_seconds` at the cost of the new trades alone, however many are stored of their days; they are read once.

    They lie beside the days until they outgrow these; then they are folded into them, and the candles of ``stale`` days
    are stored, too.
    """
    touched = commit.add("trades", days_of(new), stale=stale)
    if touched and commit.outgrown("trades"):
        settle(commit)
    return touched


def settle(commit: Commit) -> None:
    """Fold added trades into their days, and store the candles of those that are stale."""
    stale = commit.added("trades").stale
    commit.fold("trades")
    if stale:
        candles_of_days(commit, stale)


def candles_of_days(commit: Commit, days: frozenset[tuple]) -> None:
    """Compute the candles of days (market_id, trade_date) from the stored trades."""
    again = commit.read("trades", dated(days))
    commit.replace("candles", day_candles(stored(again, "day-trades") if commit.added("trades").folders else again))


def store_trades(commit: Commit, new: DataFrame) -> None:
    """Store trades, then recompute the candles of the days they touch."""
    candles_of_days(commit, replace_seconds(commit, new))


def recompute(tables: Tables, writer: str = "trades") -> Callable[[DataFrame, int], None]:
    """Handler of a micro-batch of trades: they and their candles become visible together, once.

    A batch costs as much as its trades: candles of the days it touches are stored when its trades are folded into these
    days (:func:`add_seconds`), and made from the trades by who reads them before.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        state = tables.state()
        if state.batches.get(writer, -1) < batch_id:
            commit = tables.begin()
            add_seconds(commit, batch, stale=True)
            commit.publish(**{writer: batch_id})

    return handle


def settled(tables: Tables) -> Tables:
    """The tables with all trades in their days and all candles stored; for when a stream is at its end."""
    commit = tables.begin()
    if commit.added("trades").folders:
        settle(commit)
        commit.publish()
    return tables


def run(trades: DataFrame, tables: Tables, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Start the recompute on a stream of trades: a backfill of all that is there, or continuously."""
    writer = trades.writeStream.foreachBatch(recompute(tables)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed(trades: DataFrame, minutes: int, late: str = "1 hour") -> DataFrame:
    """Native variant with a watermark: candles close after ``late`` and later trades are dropped."""
    window = F.window("executed_at", f"{minutes} minutes")
    return (
        trades.withWatermark("executed_at", late)
        .groupBy("market_id", window.alias("w"))
        .agg(F.min("price").alias("lowest_price"), F.max("price").alias("highest_price"), F.sum("amount").alias("base_volume"), F.sum("i_quote_amount").alias("quote_volume"))
        .select("market_id", F.lit(minutes).alias("length"), F.col("w.start").alias("start_at"), F.col("w.end").alias("end_at"), "lowest_price", "highest_price", "base_volume", "quote_volume")
    )


__all__ = ["STALE", "add_seconds", "candles_of_days", "dispatch", "event_market", "listen", "recompute", "replace_seconds", "run", "settled", "store_trades", "trade_tables", "windowed"]
