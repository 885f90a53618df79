"""Tickers over the last 24 hours, for all markets in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.buckets import minutes_before
from ..functions.money import percent_change, round_percent
from ..functions.text import ticker_id
from .book import best_prices

HOURS, LENGTH = 24, 5


def last_prices(trades: DataFrame, as_of: str, hours: int = HOURS) -> DataFrame:
    """Price of each market's last trade after ``as_of - hours``; among equal seconds the smallest id is last."""
    recent = trades.where(F.col("executed_at") > minutes_before(as_of, 60 * hours))
    return recent.groupBy("market_id").agg(F.max_by("price", F.struct("executed_at", -F.col("id"))).alias("last_price"))


def markets_with_last_price(markets: DataFrame, trades: DataFrame, as_of: str, hours: int = HOURS) -> DataFrame:
    """Markets, the one with the smallest id of each market_id, with their last price or null."""
    first = markets.groupBy("market_id").agg(F.min_by(F.struct(*[c for c in markets.columns if c != "market_id"]), "id").alias("m")).select("market_id", "m.*")
    return first.join(last_prices(trades, as_of, hours), "market_id", "left").select(*markets.columns, "last_price")


def day_summary(candles: DataFrame, as_of: str, hours: int = HOURS) -> DataFrame:
    """Volumes, high, low and open of the 5-minute candles that start within the last hours.

    A zero low is replaced by the next candle's low, so lows are minima over what follows the last zero, unless the
    last candle's low is the zero itself. A high is never below 0.
    """
    recent = candles.where((F.col("length") == LENGTH) & (F.col("start_at") >= minutes_before(as_of, 60 * hours)))
    place = F.unix_seconds("start_at")
    # At most 60 * hours / LENGTH + 1 lows of a market are listed.
    rows = recent.groupBy("market_id").agg(
        F.sum("base_volume").alias("base_volume"),
        F.sum("quote_volume").alias("quote_volume"),
        F.greatest(F.max("highest_price"), F.lit(0)).alias("high"),
        F.min_by("open_price", place).alias("open_price"),
        F.sort_array(F.collect_list(F.struct(place.alias("place"), F.col("lowest_price").alias("low")))).alias("lows"),
    )
    lower = lambda low, x: F.when(low.isNull() | (low == 0) | (x["low"] < low), x["low"]).otherwise(low)
    low = F.aggregate("lows", F.lit(None).cast(recent.schema["lowest_price"].dataType), lower)
    return rows.select("market_id", "base_volume", "quote_volume", "high", low.alias("low"), "open_price")


def tickers(markets: DataFrame, trades: DataFrame, candles: DataFrame, orders: DataFrame, as_of: str) -> DataFrame:
    """One ticker for each market; what a market lacks is 0."""
    joined = (
        markets_with_last_price(markets, trades, as_of)
        .join(best_prices(orders), "market_id", "left")
        .join(day_summary(candles, as_of), "market_id", "left")
    )
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    change = F.when(F.col("last_price").isNull() | F.col("open_price").isNull(), F.lit(0.0)).otherwise(percent_change(F.col("open_price"), F.col("last_price")))
    names = ("last_price", "base_volume", "quote_volume", "bid", "ask", "high", "low", "open_price")
    return joined.select("base", "quote", "market_id", *map(number, names), round_percent(change).alias("change"))


def listing_tickers(rows: DataFrame) -> DataFrame:
    """The other ticker format: no open price and change, names of the listing site."""
    return rows.select(
        ticker_id(F.col("base"), F.col("quote")).alias("ticker_id"),
        F.col("base").alias("base_currency"),
        F.col("quote").alias("target_currency"),
        F.col("market_id").alias("pool_id"),
        "last_price", "base_volume", F.col("quote_volume").alias("target_volume"), "bid", "ask", "high", "low",
    )
