"""Charts without gaps: every bucket of a range, with zeros where nobody traded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.buckets import at, bucket_end, bucket_start, minutes_before
from .candles import OUT, candles_since, public_rows, trading_view
from .candles import candles as candles_of
from .requests import ChartRequest

#: Markets whose days are broadcast at most.
BROADCAST_MARKETS = 5_000
PRICES = ("lowest_price", "open_price", "average_price", "highest_price", "close_price", "base_volume", "quote_volume")


def ranges(markets: DataFrame, as_of: str, length: int, limit: int) -> DataFrame:
    """Where each market's chart begins: ``limit`` buckets ago, but not before the market; without a limit, at the market."""
    created = F.col("i_created_at").cast("timestamp")
    begin = F.greatest(minutes_before(as_of, limit * length), created) if limit > 0 else created
    return markets.select("market_id", begin.alias("begin"))


def found(candles: DataFrame, markets: DataFrame, as_of: str, length: int, limit: int) -> DataFrame:
    """Candles of each market's range, the newest ``limit`` of them."""
    rows = candles.where(F.col("length") == length).join(ranges(markets, as_of, length, limit), "market_id").where("start_at >= begin")
    if limit <= 0:
        return rows.drop("begin")
    place = F.expr("row_number() over (partition by market_id order by start_at desc)")
    return rows.withColumn("place", place).where(F.col("place") <= limit).drop("begin", "place")


def calendar(markets: DataFrame, as_of: str, length: int, limit: int) -> DataFrame:
    """The start of every bucket of each market's range."""
    lowest = bucket_start(F.timestamp_seconds(F.unix_seconds("begin") + 60 * length - 1), length)
    newest = bucket_start(at(as_of), length)
    starts = F.explode(F.sequence(lowest, newest, F.make_interval(mins=F.lit(length))))
    return ranges(markets, as_of, length, limit).where(lowest <= newest).select("market_id", starts.alias("start_at"))


def gapfilled(candles: DataFrame, markets: DataFrame, as_of: str, length: int, limit: int) -> DataFrame:
    """The last candles of each market up to ``as_of``, zero candles in the gaps; all candles of one length.

    A bucket belongs to the range if its start does, so a range that begins on a boundary has ``limit + 1`` buckets. A
    market with exactly ``limit`` candles gets just these.
    """
    held = found(candles, markets, as_of, length, limit).drop("length", "end_at").withColumn("traded", F.lit(True))
    buckets = calendar(markets, as_of, length, limit).withColumn("listed", F.lit(True))
    # Candles are computed once: how many a market has is counted over the joined rows.
    both = buckets.join(held, ["market_id", "start_at"], "full")
    full = F.count("traded").over(Window.partitionBy("market_id")) == limit
    kept = both.withColumn("full", full).where(F.when(F.col("full"), F.col("traded")).otherwise(F.col("listed")))
    zeros = [F.coalesce(F.col(c), F.lit(0).cast(held.schema[c].dataType)).alias(c) for c in PRICES]
    return kept.select("market_id", F.lit(length).alias("length"), "start_at", bucket_end(F.col("start_at"), length).alias("end_at"), *zeros).select(*OUT)


def from_trades(trades: DataFrame, markets: DataFrame, as_of: str, length: int, limit: int) -> DataFrame:
    """:func:`gapfilled` of candles that are made of no more trades than the ranges need."""
    made = candles_since(trades, minutes_before(as_of, (limit + 1) * length), (length,)) if limit > 0 else candles_of(trades, (length,))
    return gapfilled(made, markets, as_of, length, limit)


def from_table(spark: SparkSession, path: str, markets: DataFrame, as_of: str, length: int, limit: int, *, later: bool = False) -> DataFrame:
    """:func:`gapfilled` of candles stored by market and day (market_id, candle_date), of which only the days that ranges touch are read.

    Candles that start after ``as_of`` don't count, unless ``later``, which takes them as :func:`gapfilled` does: the newest
    candles of a market are its chart, whenever they start.

    Days outside of all ranges are left out by a filter on the folder names; of the others a market's days
    meet its folders in a join, which prunes while the query runs.
    """
    rows = spark.read.parquet(path).where(F.col("length") == length)
    spans = ranges(markets, as_of, length, limit).select("market_id", F.to_date("begin").alias("first_day"))
    if limit > 0:
        rows = rows.where(F.col("candle_date") >= F.to_date(minutes_before(as_of, limit * length)))
    few = limit > 0 and markets.limit(BROADCAST_MARKETS + 1).count() <= BROADCAST_MARKETS
    # A market has limit * length / 1440 + 2 days at most; many markets are left to Spark's own choice of a join.
    known = F.broadcast if few else lambda rows: rows
    if later:
        mine = rows.alias("c").join(known(spans).alias("s"), F.expr("c.market_id = s.market_id and candle_date >= first_day"), "left_semi")
    else:
        last = F.greatest("first_day", F.to_date(at(as_of)))
        days = spans.select("market_id", F.explode(F.sequence("first_day", last)).alias("candle_date"))
        until = (F.col("candle_date") <= F.to_date(at(as_of))) & (F.col("start_at") <= at(as_of))
        mine = rows.where(until).join(known(days), ["market_id", "candle_date"], "left_semi")
    return gapfilled(mine.drop("candle_date"), markets, as_of, length, limit)


def chart(candles: DataFrame, markets: DataFrame, request: ChartRequest, as_of: str) -> DataFrame:
    """The chart that a request asks for: of its market, length and limit; ``tv`` gives the rows that charts take."""
    mine = F.col("market_id") == request.market
    rows = gapfilled(candles.where(mine), markets.where(mine), as_of, request.minutes, request.rows)
    return trading_view(rows) if request.format == "tv" else public_rows(rows)
