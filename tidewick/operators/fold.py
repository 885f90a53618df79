"""Candles with trades that have no price or no quote amount, folded exactly, with one candle spread over many tasks.

The rules follow trades in order of time and id. Low and high: a zero low is unset, so the low is the smallest price since
the last zero. Volumes: while the running average is zero, the next trade starts them anew and its price is the average;
else the average is the price if low and high are equal, else quote by base volume.

What depends on the order is little. The average of a candle that has any quote volume is never zero again, so all that
comes after the first trade with a quote amount is a sum. The trades before it, the candle's dust, pass a machine with one
bit of state, whether the average is zero. A stretch of dust is a function of that bit and of what the base volume was;
such functions combine in any grouping, so a candle's dust is cut into stretches wherever Spark's range partitions end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.buckets import bucket_start
from ..sources.shared import stored

KEYS = ("market_id", "length", "start_at")
MONEY = "decimal(38,18)"
#: Dust trades of a stretch, about.
STRETCH_ROWS = 200_000
#: What a stretch does for an average that isn't zero before it (0) and one that is (1): whether it is zero after, the base
#: volume, whether volumes started anew, and whether they did at the last trade.
EFFECT = [f"{name}{k} {kind}" for k in (0, 1) for name, kind in (("zero", "boolean"), ("base", MONEY), ("anew", "boolean"), ("last_anew", "boolean"))]
STRETCH = ", ".join(["market_id string", "length int", "start_at timestamp", "part int", *EFFECT, f"last_price {MONEY}"])


class Stretch:
    """The effect of dust trades, taken in one by one, after a high and a low (0 if unset)."""

    def __init__(self, high, low):
        self.high, self.low, self.price = high, low, None
        self.states = [[False, 0, False, False], [True, 0, False, False]]

    def add(self, price, amount) -> None:
        self.low = price if self.low == 0 or price < self.low else self.low
        self.high = price if self.high == 0 or price > self.high else self.high
        self.price = price
        for state in self.states:
            zero, base, anew, _ = state
            # Dust adds no quote volume, so an average by volumes is zero.
            state[:] = [price == 0, amount, True, True] if zero else [price == 0 if self.low == self.high else True, base + amount, anew, False]


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each stretch of dust trades, which come sorted by part, candle and moment."""
    key = stretch = kind = None

    def batch_of(done: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.int32(), pa.int64(), pa.int32(), *[pa.bool_(), pa.decimal128(38, 18), pa.bool_(), pa.bool_()] * 2, pa.decimal128(38, 18)]
        columns = list(zip(*done, strict=True)) if done else [()] * len(types)
        arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        arrays[2] = arrays[2].cast(kind)
        return pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in STRETCH.split(", ")])

    def row() -> tuple:
        return (*key, *stretch.states[0], *stretch.states[1], stretch.price)

    for batch in batches:
        kind, done = batch.schema.field("start_at").type, []
        columns = [batch.column(c) for c in (*KEYS, "part", "high", "low", "p", "b")]
        columns[2] = columns[2].cast(pa.int64())
        for market, length, start, part, high, low, price, amount in zip(*(c.to_pylist() for c in columns), strict=True):
            if (market, length, start, part) != key:
                if key is not None:
                    done.append(row())
                key, stretch = (market, length, start, part), Stretch(high, low)
            stretch.add(price, amount)
        if kind is not None:
            yield batch_of(done)
    if key is not None:
        yield batch_of([row()])


def before_stretches(dust: DataFrame) -> DataFrame:
    """(*KEYS, part, high, low): high and low of a candle before each of its stretches, 0 if unset."""
    zero_at = F.max(F.when(F.col("p") == 0, F.col("moment"))).over(Window.partitionBy(*KEYS, "part"))
    since = F.when(F.col("zero_at").isNull() | (F.col("moment") > F.col("zero_at")), F.col("p"))
    each = dust.withColumn("zero_at", zero_at).groupBy(*KEYS, "part").agg(F.max("p").alias("h"), F.min(since).alias("l"), F.max("zero_at").isNotNull().cast("int").alias("has_zero"))
    order = Window.partitionBy(*KEYS).orderBy("part")
    counted = each.withColumn("zeros", F.sum("has_zero").over(order))
    # The low so far: the smallest price of the stretches since the last one with a zero, of that one what follows it.
    running = counted.withColumn("tail", F.min("l").over(Window.partitionBy(*KEYS, "zeros").orderBy("part")))
    unset = lambda c: F.coalesce(c, F.lit(0).cast(MONEY))
    return running.select(*KEYS, "part", unset(F.max("h").over(order.rowsBetween(Window.unboundedPreceding, -1))).alias("high"), unset(F.lag("tail").over(order)).alias("low"))


def in_stretches(dust: DataFrame, parts: int) -> DataFrame:
    """``dust`` with the number of the range partition that holds a trade (``part``), and ``high`` and ``low`` before that stretch.

    With several parts it is stored, as ranges are drawn anew by each run.
    """
    if parts <= 1:
        unset = F.lit(0).cast(MONEY)
        return dust.withColumns({"part": F.lit(0), "high": unset, "low": unset})
    cut = stored(dust.repartitionByRange(parts, *KEYS, "moment").withColumn("part", F.spark_partition_id()), "candle-stretches")
    return cut.join(before_stretches(cut), [*KEYS, "part"])


def after_dust(dust: DataFrame, stretch_rows: int) -> DataFrame:
    """(*KEYS, zero, dust_base, dust_anew, dust_price) after the dust (*KEYS, moment, p, b) of each candle."""
    kept = stored(dust, "candle-dust")
    n = kept.count()
    rows = in_stretches(kept, -(-n // stretch_rows)).repartition("part").sortWithinPartitions("part", *KEYS, "moment", "p", "b").select(*KEYS, "part", "high", "low", "p", "b")
    # Where no trade precedes the first quote amount, no task has to start Python.
    each = rows.mapInArrow(stretches, STRETCH) if n else rows.sparkSession.createDataFrame([], STRETCH)
    # A candle has a row for each stretch, which are few: the functions are applied one after another.
    names = [f.split()[0] for f in EFFECT]
    listed = each.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("part", *names, "last_price"))).alias("steps"))
    start = F.struct(F.lit(True).alias("zero"), F.lit(0).cast(MONEY).alias("base"), F.lit(False).alias("anew"), F.lit(None).cast(MONEY).alias("price"))

    def step(state: Column, x: Column) -> Column:
        pick = lambda name: F.when(state["zero"], x[f"{name}1"]).otherwise(x[f"{name}0"])
        base = F.when(pick("anew"), pick("base")).otherwise((state["base"] + pick("base")).cast(MONEY))
        return F.struct(pick("zero").alias("zero"), base.alias("base"), pick("last_anew").alias("anew"), x["last_price"].alias("price"))

    done = listed.select(*KEYS, F.aggregate("steps", start, step).alias("s"))
    return done.select(*KEYS, F.col("s.zero").alias("zero"), F.col("s.base").alias("dust_base"), F.col("s.anew").alias("dust_anew"), F.col("s.price").alias("dust_price"))


def with_marks(trades: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    """``trades`` (with ``start_at`` of their small candle) beside its marks, and whether they are dust (``is_dust``)."""
    # One key more asks for exchanges that skewed partitions can be split behind.
    bit = F.xxhash64("market_id", "start_at") > 0
    met = trades.withColumn("bit", bit).join(marks.withColumns({"bit": bit, "marked": F.lit(True)}), ["market_id", "start_at", "bit"], how).drop("bit")
    return met.withColumn("is_dust", F.col("marked").isNotNull() & (F.col("settled_at").isNull() | (F.col("moment") < F.col("settled_at"))))


def details() -> dict[str, Column]:
    """What small candles hold besides their prices and volumes, of trades :func:`with_marks`, so that long ones need no trades."""
    settles = F.col("moment") == F.col("settled_at")
    return {
        "marked": F.max("marked").isNotNull(),
        "has_zero": F.max("zero_at").isNotNull(),
        "all_dust": F.min("is_dust"),
        "low_since": F.min(F.when(F.col("zero_at").isNull() | (F.col("moment") > F.col("zero_at")), F.col("price"))),
        "undusted": F.sum(F.when(~F.col("is_dust"), F.col("amount"))),
        # Without marks the first trade is the one with a quote amount.
        "settling_price": F.coalesce(F.max(F.when(settles, F.col("price"))), F.min_by("price", "moment")),
        "settled_last": F.max("moment") == F.coalesce(F.max("settled_at"), F.min("moment")),
    }


def whole_candles(small: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """Candles that hold a marked small one, from all of their small ones, of which even a day has only 288."""
    each = small.drop("length").withColumnRenamed("start_at", "place").withColumn("length", F.explode(F.array(*map(F.lit, lengths))))
    each = each.withColumn("start_at", bucket_start(F.col("place"), F.col("length")))
    candle = Window.partitionBy(*KEYS)
    rows = each.join(each.where("marked").select(*KEYS).distinct(), list(KEYS), "left_semi").withColumns(
        {"settled_in": F.min(F.when(~F.col("all_dust"), F.col("place"))).over(candle), "zero_in": F.max(F.when(F.col("has_zero"), F.col("place"))).over(candle)}
    )
    settles = F.col("place") == F.col("settled_in")
    money = lambda c: c.cast(MONEY)
    return rows.groupBy(*KEYS).agg(
        money(F.coalesce(F.min(F.when(F.col("zero_in").isNull() | (F.col("place") >= F.col("zero_in")), F.col("low_since"))), F.lit(0))).alias("lowest_price"),
        money(F.max("highest_price")).alias("highest_price"),
        money(F.min_by("open_price", "place")).alias("open_price"),
        money(F.max_by("close_price", "place")).alias("close_price"),
        money(F.sum("quote_volume")).alias("quote_volume"),
        money(F.sum(F.when(settles, F.col("undusted")).when(F.col("place") > F.col("settled_in"), F.col("base_volume")))).alias("undusted"),
        money(F.max(F.when(settles, F.col("settling_price")))).alias("settling_price"),
        ((F.max("place") == F.max("settled_in")) & F.max(F.when(settles, F.col("settled_last")))).alias("settled_last"),
        F.max("settled_in").alias("settled_in"),
    )


def exact(small: DataFrame, dust: DataFrame, lengths: tuple[int, ...], *, stretch_rows: int = STRETCH_ROWS) -> DataFrame:
    """Candles with dust: low, high, open, close, volumes and the average where a trade alone sets it.

    ``small`` are the shortest candles with :func:`details`, ``dust`` (market_id, place, moment, p, b) the trades that are
    dust of theirs. Dust of a longer candle lies in the small ones up to the first that holds a quote amount.
    """
    whole = whole_candles(small, lengths)
    each = dust.withColumn("length", F.explode(F.array(*map(F.lit, lengths)))).withColumn("start_at", bucket_start(F.col("place"), F.col("length")))
    unsettled = F.col("settled_in").isNull()
    mine = each.join(whole.select(*KEYS, "settled_in"), list(KEYS)).where(unsettled | (F.col("place") <= F.col("settled_in")))
    joined = whole.join(after_dust(mine.select(*KEYS, "moment", "p", "b"), stretch_rows), list(KEYS), "left")
    # Without dust the average is zero before the first trade, so that one starts volumes.
    starts = F.coalesce("zero", F.lit(True))
    base = F.when(unsettled, F.col("dust_base")).otherwise(F.when(starts, F.col("undusted")).otherwise((F.col("dust_base") + F.col("undusted")).cast(MONEY)))
    alone = F.when(unsettled, F.when(F.col("dust_anew"), F.col("dust_price"))).otherwise(F.when(F.col("settled_last") & starts, F.col("settling_price")))
    return joined.select(*KEYS, "lowest_price", "highest_price", "open_price", "close_price", base.cast(MONEY).alias("base_volume"), "quote_volume", alone.alias("set_price"))
