"""From pages of trades to stored trades and candles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from .. import schema
from ..operators.assets import convert_trades, with_exponents
from ..sinks.versions import Table, Tables
from ..sources.shared import stored
from .listener import store_trades, trade_tables
from .sync import FAILURES

NO_UNIT = "no display denom"


def history_tables(spark, folder: str) -> Tables:
    """Trades, candles and failures."""
    return Tables(spark, folder, {**trade_tables(StructType([f for f in schema.TRADES.fields])), "failures": Table(FAILURES)})


def converted(pages: DataFrame, markets: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """History rows of pages (market_id, id, .., error), and the failures: markets that weren't read, are unknown, or whose assets have no display unit.

    Prices keep 18 digits on both sides of the point; amounts are whole numbers of up to 19 digits.
    """
    named = pages.join(markets.select("market_id", "base", "quote"), "market_id", "left")
    judged = with_exponents(named, units).withColumn(
        "error",
        F.coalesce("error", F.when(F.col("base").isNull(), "unknown market").when(F.col("base_exponent").isNull() | F.col("quote_exponent").isNull(), NO_UNIT)),
    )
    failures = judged.where("error is not null").groupBy("market_id").agg(F.min("error").alias("error")).select("market_id", F.lit("history").alias("process"), "error")
    raw = judged.where("error is null").drop("base_exponent", "quote_exponent").withColumns({"price": F.col("price").cast("decimal(36,18)"), "amount": F.col("amount").cast("decimal(19,0)")})
    rows = convert_trades(raw, units, strict=False)
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in schema.TRADES.fields]), failures


def handler(tables: Tables, markets: Callable[[], DataFrame], units: Callable[[], DataFrame], writer: str = "history") -> Callable[[DataFrame, int], None]:
    """Handler of a micro-batch of pages: its trades, their candles and what failed become visible together, once."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        if tables.state().batches.get(writer, -1) >= batch_id:
            return
        # Pages are read once; what is stored and what candles are made of has to be the same.
        pages, commit = stored(batch, "pages"), tables.begin()
        rows, failed = converted(pages, markets(), units())
        if not rows.isEmpty():
            store_trades(commit, rows)
        others = commit.read("failures").join(pages.select("market_id").distinct(), "market_id", "left_anti")
        commit.replace("failures", others.unionByName(failed))
        commit.publish(**{writer: batch_id})

    return handle


def run(pages: DataFrame, tables: Tables, markets: Callable[[], DataFrame], units: Callable[[], DataFrame], checkpoint: str) -> StreamingQuery:
    """Start storing a stream of pages; backfills go on where they were left."""
    return pages.writeStream.foreachBatch(handler(tables, markets, units)).option("checkpointLocation", checkpoint).start()
