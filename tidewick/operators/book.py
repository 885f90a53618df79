"""Order books: best prices, depth, the two output formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.buckets import at
from ..functions.money import shown
from .ranks import ranked
from .requests import BookRequest, allowed_format

BUY, SELL = "buy", "sell"


def best_prices(orders: DataFrame) -> DataFrame:
    """Highest buy and lowest sell of each market."""
    side = lambda kind: F.when(F.col("order_type") == kind, F.col("price"))
    return orders.groupBy("market_id").agg(F.max(side(BUY)).alias("bid"), F.min(side(SELL)).alias("ask"))


def levels(orders: DataFrame, depth: int = 0) -> DataFrame:
    """Price levels with their position, half of ``depth`` on each side; a depth of 0 or 1 has no limit.

    Without a limit a side may have any size: it is ranked over as many tasks as it needs.

    Sells ascend from the best. Buys ascend too, so that the best of those chosen comes last.
    """
    limit = depth // 2
    best = F.when(F.col("order_type") == BUY, -F.col("price")).otherwise(F.col("price"))
    sides = ["market_id", "order_type"]
    if limit > 0:
        # No more than the limit is kept of a side before its rows meet.
        rows = orders.withColumn("place", F.row_number().over(Window.partitionBy(*sides).orderBy(best, "id"))).where(F.col("place") <= limit)
        rows = rows.withColumn("total", F.count("*").over(Window.partitionBy(*sides)))
    else:
        rows = ranked(orders, sides, [best, F.col("id")])
    position = F.when(F.col("order_type") == BUY, F.col("total") - F.col("place") + 1).otherwise(F.col("place").cast("long"))
    return rows.select("market_id", "order_type", position.alias("position"), "price", "amount")


def books(orders: DataFrame, as_of: str, depth: int = 0) -> DataFrame:
    """One row for each market: bids and asks as arrays of (price, volume) texts, the time in unix seconds."""
    entry = F.struct("position", shown(F.col("price")).alias("price"), shown(F.col("amount")).alias("volume"))
    side = lambda kind: F.transform(F.sort_array(F.collect_list(F.when(F.col("order_type") == kind, entry))), lambda x: F.struct(x["price"].alias("price"), x["volume"].alias("volume")))
    return levels(orders, depth).groupBy("market_id").agg(side(BUY).alias("bids"), side(SELL).alias("asks")).withColumn("timestamp", F.unix_seconds(at(as_of)).cast("string"))


def listing_books(rows: DataFrame) -> DataFrame:
    """The other book format: [price, volume] pairs under a ticker id."""
    pairs = lambda c: F.transform(c, lambda x: F.array(x["price"], x["volume"])).alias(c)
    return rows.select(F.replace("market_id", F.lit("/"), F.lit("_")).alias("ticker_id"), "timestamp", pairs("bids"), pairs("asks"))


def requested(orders: DataFrame, request: BookRequest, as_of: str) -> DataFrame:
    """The book that a request asks for, in the format it asks for; an unknown format is the default one."""
    rows = books(orders.where(F.col("market_id") == request.market), as_of, request.depth)
    return listing_books(rows) if allowed_format(request.format) else rows
