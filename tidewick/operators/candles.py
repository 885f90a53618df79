"""OHLCV candles: trades to 5-minute candles in one shuffle, longer candles from those."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.buckets import LENGTHS, bucket_end, bucket_start
from ..functions.money import strict_divide
from ..sources.shared import stored
from . import fold

KEYS = fold.KEYS
OUT = ("market_id", "length", "start_at", "end_at", "lowest_price", "open_price", "average_price", "highest_price", "close_price", "base_volume", "quote_volume")
_SPAN = "10000000000000000000"
#: Shortest candles with dust whose marks are broadcast at most.
BROADCAST_MARKS = 20_000


def _moment(time: Column, rank: Column) -> Column:
    """Time and rank as one number, so that min_by and max_by run as hash aggregates; a struct key would sort."""
    return F.unix_micros(time).cast("decimal(38,0)") * F.lit(_SPAN).cast("decimal(20,0)") + rank.cast("decimal(20,0)")


def first_moment() -> Column:
    """Orders trades by time, then id."""
    return _moment(F.col("executed_at"), F.col("id").cast("decimal(20,0)"))


def last_moment() -> Column:
    """Orders trades by time, then id from the largest."""
    return _moment(F.col("executed_at"), F.lit(_SPAN).cast("decimal(20,0)") - 1 - F.col("id").cast("decimal(20,0)"))


def base_candles(trades: DataFrame, minutes: int, **details: Column) -> DataFrame:
    """Candles of one length, with the smallest price and quote amount that decide whether they need the exact fold, and further aggregates.

    Open is the price of the first trade, close that of the first of those at the last second; among equal seconds the
    smallest id is first.
    """
    first, last = first_moment(), last_moment()
    return (
        trades.groupBy("market_id", bucket_start(F.col("executed_at"), minutes).alias("start_at"))
        .agg(
            F.min("price").alias("lowest_price"),
            F.max("price").alias("highest_price"),
            F.min_by("price", first).alias("open_price"),
            F.max_by("price", last).alias("close_price"),
            F.sum("amount").alias("base_volume"),
            F.sum("i_quote_amount").alias("quote_volume"),
            F.min("i_quote_amount").alias("least_quote"),
            *[c.alias(name) for name, c in details.items()],
        )
        .withColumn("length", F.lit(minutes))
    )


def roll_up(small: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """Candles of longer lengths from shorter ones; each candle joins one of every length, and partial sums meet first."""
    each = small.drop("length").withColumn("length", F.explode(F.array(*map(F.lit, lengths)))).withColumn("into", bucket_start(F.col("start_at"), F.col("length")))
    place = F.unix_seconds("start_at")
    return (
        each.groupBy("market_id", "length", "into")
        .agg(
            F.min("lowest_price").alias("lowest_price"),
            F.max("highest_price").alias("highest_price"),
            F.min_by("open_price", place).alias("open_price"),
            F.max_by("close_price", place).alias("close_price"),
            F.sum("base_volume").alias("base_volume"),
            F.sum("quote_volume").alias("quote_volume"),
            F.min("least_quote").alias("least_quote"),
        )
        .withColumnRenamed("into", "start_at")
    )


def _averaged(rows: DataFrame, strict: bool) -> DataFrame:
    """The average: the price that a trade has set alone, else the price if low and high are equal, else quote by base volume."""
    exact = lambda c: F.col(c).cast("decimal(38,18)" if strict else "double")
    ratio = strict_divide(exact("quote_volume"), exact("base_volume")) if strict else exact("quote_volume") / exact("base_volume")
    alone = F.when(F.col("lowest_price") == F.col("highest_price"), exact("lowest_price"))
    if "set_price" in rows.columns:
        alone = F.coalesce(exact("set_price"), alone)
    return rows.withColumn("average_price", F.when(alone.isNotNull(), alone).otherwise(ratio)).withColumn("end_at", bucket_end(F.col("start_at"), F.col("length")))


def dusty(trades: DataFrame) -> DataFrame:
    """Trades without a price or a quote amount; their filters reach the scan, where row groups without any are skipped."""
    return trades.where((F.col("price") <= 0) | (F.col("i_quote_amount") <= 0))


MONEY = ("lowest_price", "highest_price", "open_price", "close_price", "base_volume", "quote_volume")


def marks(trades: DataFrame) -> DataFrame | None:
    """Of each shortest candle with a dusty trade the first moment with a quote amount and the last with a zero price, stored; None if there are none.

    Only trades of such candles are grouped. Marks are broadcast if they are few.
    """
    held = stored(dusty(trades).select("market_id", "start_at").distinct(), "dusty-candles")
    count = held.count()
    if not count:
        return None
    known = (lambda rows: F.broadcast(rows)) if count <= BROADCAST_MARKS else (lambda rows: rows)
    settled, zero = F.when(F.col("i_quote_amount") > 0, F.col("moment")), F.when(F.col("price") == 0, F.col("moment"))
    mine = trades.join(known(held), ["market_id", "start_at"], "left_semi").groupBy("market_id", "start_at")
    return known(stored(mine.agg(F.min(settled).alias("settled_at"), F.max(zero).alias("zero_at")), "candle-marks"))


def _placed(trades: DataFrame) -> DataFrame:
    return trades.withColumns({"start_at": bucket_start(F.col("executed_at"), LENGTHS[0]), "moment": first_moment()})


def _small_and_dust(placed: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The shortest candles, stored, with what longer ones need of their dust, and the dust itself."""
    small = stored(base_candles(fold.with_marks(placed, found, "left"), LENGTHS[0], **fold.details()), "small-candles")
    dust = fold.with_marks(placed, found, "inner").where("is_dust")
    money = [F.col(c).cast("decimal(38,18)").alias(n) for c, n in (("price", "p"), ("amount", "b"))]
    return small, dust.select("market_id", F.col("start_at").alias("place"), "moment", *money)


def folded(trades: DataFrame, lengths: tuple[int, ...], **options: int) -> DataFrame:
    """The candles that hold a dusty trade, by :func:`fold.exact`, which spreads a candle's trades over tasks."""
    placed = _placed(trades)
    found = marks(placed)
    if found is None:
        return _with_set_price(base_candles(trades, LENGTHS[0]).where(F.lit(False)))
    return fold.exact(*_small_and_dust(placed, found), lengths, **options)


def _with_set_price(rows: DataFrame) -> DataFrame:
    return rows.select(*KEYS, *[F.col(c).cast("decimal(38,18)").alias(c) for c in MONEY], F.lit(None).cast("decimal(38,18)").alias("set_price"))


def candles(trades: DataFrame, lengths: tuple[int, ...] = LENGTHS, *, exact: bool = True, strict: bool = False) -> DataFrame:
    """Candles of the given lengths, one row for each market, length and bucket with trades.

    ``exact`` sends candles with a zero price or quote amount through :func:`fold.exact`; others have a closed form.
    Which these are is asked while the plan is built: one scan, which statistics of the files usually answer, and, only
    where there are some, jobs that store their marks and dust and all shortest candles.
    ``strict`` averages with 18 decimal digits instead of as doubles.
    """
    rolled = lambda small: roll_up(small, lengths) if tuple(lengths) != (LENGTHS[0],) else small
    placed = _placed(trades)
    found = marks(placed) if exact else None
    if found is None:
        return _averaged(rolled(base_candles(trades, LENGTHS[0])), strict).select(*OUT)
    small, dust = _small_and_dust(placed, found)
    plain = (F.col("lowest_price") > 0) & (F.col("least_quote") > 0)
    return _averaged(_with_set_price(rolled(small).where(plain)).unionByName(fold.exact(small, dust, lengths)), strict).select(*OUT)


def candles_since(trades: DataFrame, begin: Column, lengths: tuple[int, ...] = LENGTHS, **options: bool) -> DataFrame:
    """Candles that start at ``begin`` or later. Trades are filtered before the fold: those of such candles are no older."""
    return candles(trades.where(F.col("executed_at") >= begin), lengths, **options).where(F.col("start_at") >= begin)


def latest(rows: DataFrame) -> DataFrame:
    """One candle for each market, length and start: of rows that repeat a start, the one updated last."""
    order = F.struct(F.coalesce("i_updated_at", "i_created_at"), "i_created_at")
    others = [c for c in rows.columns if c not in KEYS]
    return rows.groupBy(*KEYS).agg(F.max_by(F.struct(*others), order).alias("c")).select(*KEYS, *[F.col(f"c.{c}").alias(c) for c in others]).select(*rows.columns)


def public_rows(rows: DataFrame) -> DataFrame:
    """Candles under their public names: the length is called ``minutes``."""
    return rows.withColumnRenamed("length", "minutes")


def trading_view(rows: DataFrame, *keys: str) -> DataFrame:
    """Candles as charts take them: ``keys``, time in unix seconds, prices as doubles, ``value`` the base volume."""
    price = lambda c, n: F.col(c).cast("double").alias(n)
    return rows.select(*keys, F.unix_seconds("start_at").alias("time"), price("lowest_price", "low"), price("open_price", "open"), price("highest_price", "high"), price("close_price", "close"), price("base_volume", "value"))
