"""Trade history: optional filters, newest first, two output formats."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.buckets import from_millis
from ..functions.money import shown
from ..functions.text import ticker_to_market

#: Fixed values of the request rules.
DEFAULT_LIMIT, MAX_LIMIT = 500, 1000


@dataclass(frozen=True)
class HistoryRequest:
    """What to return. Times are milliseconds and count only if both are positive; both ends are included.

    A ticker stands for its market. ``compat`` gives trades of all markets where only a ticker is named.
    """

    market_id: str = ""
    ticker_id: str = ""
    order_type: str = ""
    start_time: int = 0
    end_time: int = 0
    address: str = ""
    limit: int = 0
    compat: bool = False

    def __post_init__(self):
        if not self.address and len(self.market_id) < 2 and len(self.ticker_id) < 2:
            raise ValueError("name a market_id or a ticker_id")

    @property
    def rows(self) -> int:
        return DEFAULT_LIMIT if self.limit <= 0 else min(self.limit, MAX_LIMIT)

    @property
    def market(self) -> str:
        return self.market_id or ("" if self.compat else ticker_to_market(self.ticker_id))

    def conditions(self) -> list[Column]:
        found = []
        if self.market:
            found.append(F.col("market_id") == self.market)
        if self.order_type in ("buy", "sell"):
            found.append(F.col("order_type") == self.order_type)
        if self.start_time > 0 and self.end_time > 0:
            found.append(F.col("executed_at").between(from_millis(F.lit(self.start_time)), from_millis(F.lit(self.end_time))))
        if self.address:
            found.append((F.col("maker") == self.address) | (F.col("taker") == self.address))
        return found


def history(trades: DataFrame, request: HistoryRequest) -> DataFrame:
    """The newest trades that meet the request; among equal times the largest id comes first."""
    return trades.where(reduce(Column.__and__, request.conditions(), F.lit(True))).orderBy(F.col("executed_at").desc(), F.col("id").desc()).limit(request.rows)


def _millis() -> Column:
    return F.unix_millis("executed_at").cast("string")


def trade_rows(trades: DataFrame) -> DataFrame:
    return trades.select(
        F.col("id").alias("order_id"), shown(F.col("price")).alias("price"), shown(F.col("amount")).alias("base_volume"), shown(F.col("i_quote_amount")).alias("quote_volume"),
        _millis().alias("executed_at"), "order_type", "maker", "taker",
    )


def listing_rows(trades: DataFrame) -> DataFrame:
    """The other format: renamed, without the parties. Whatever isn't a buy is a sell."""
    return trades.select(
        F.col("id").alias("trade_id"), shown(F.col("price")).alias("price"), shown(F.col("amount")).alias("base_volume"), shown(F.col("i_quote_amount")).alias("target_volume"),
        _millis().alias("trade_timestamp"), F.when(F.col("order_type") == "buy", "buy").otherwise("sell").alias("type"),
    )


def buys_and_sells(rows: DataFrame) -> DataFrame:
    """One row with two arrays; callers pass the limited result of :func:`history`."""
    entry = F.struct(F.col("trade_timestamp").cast("long").alias("at"), *rows.columns)
    side = lambda kind: F.transform(F.sort_array(F.collect_list(F.when(F.col("type") == kind, entry)), asc=False), lambda x: F.struct(*[x[c].alias(c) for c in rows.columns]))
    return rows.agg(side("buy").alias("buy"), side("sell").alias("sell"))


def first_trades(trades: DataFrame) -> DataFrame:
    return trades.groupBy("market_id").agg(F.min("executed_at").alias("first_trade"))


def created_at(trades: DataFrame) -> DataFrame:
    """(market_id, i_created_at): a market counts as created a minute before its first trade."""
    return first_trades(trades).select("market_id", (F.col("first_trade") - F.expr("interval 1 minute")).alias("i_created_at"))


def oldest_unprocessed(trades: DataFrame) -> DataFrame:
    """The oldest trade of each market that no candle holds yet."""
    return first_trades(trades.where(~F.col("i_added_to_interval")))


def since(trades: DataFrame, time: Column) -> DataFrame:
    """Trades from a time on, without a cap; equal times included."""
    return trades.where(F.col("executed_at") >= time)
