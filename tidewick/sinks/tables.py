"""Upserts on Parquet tables by overwriting the partitions that change.

Each function returns or writes the new content of the touched partitions only. A write goes to all touched partitions
of one table in one job; markers and watermarks are moved after it, never before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` and those of ``old`` whose key ``new`` doesn't have."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.select(*old.columns))


def upsert_markets(old: DataFrame, new: DataFrame) -> DataFrame:
    """New markets are added; of known ones only the time of the last sync changes."""
    latest = new.groupBy("market_id").agg(F.min_by(F.struct(*[c for c in old.columns if c != "market_id"]), "id").alias("m"))
    times = latest.select("market_id", F.col("m.i_created_at").alias("synced"))
    kept = old.join(times, "market_id", "left").withColumn("i_created_at", F.coalesce("synced", "i_created_at")).select(*old.columns)
    added = latest.join(old.select("market_id"), "market_id", "left_anti").select("market_id", "m.*").select(*old.columns)
    return kept.unionByName(added)


def replace_trades(old: DataFrame, new: DataFrame) -> DataFrame:
    """Trades of the markets and seconds in ``new`` are replaced by it, whole batches at a time; replaced rows count as unprocessed."""
    fresh = new.withColumn("i_added_to_interval", F.lit(False)).select(*old.columns)
    return merged(old, fresh, ["market_id", "executed_at"])


def replace_books(old: DataFrame, new: DataFrame, *, clear_empty: bool = False, synced: DataFrame | None = None) -> DataFrame:
    """The books of the markets in ``new`` are replaced whole.

    A market whose new book is empty keeps its old one, unless ``clear_empty``; then ``synced`` names what was read.
    """
    if clear_empty and synced is None:
        raise ValueError("clear_empty needs the markets that were read")
    touched = synced.select("market_id") if clear_empty else new.select("market_id")
    return old.join(touched.distinct(), "market_id", "left_anti").unionByName(new.select(*old.columns))


def upsert_candles(old: DataFrame, new: DataFrame, now: str) -> DataFrame:
    """Candles of ``new`` replace those of the same market, length and start; ``i_updated_at`` is set where one was there."""
    keys = ["market_id", "length", "start_at"]
    known = old.select(*keys, F.col("i_created_at").alias("was"))
    stamped = new.join(known, keys, "left").select(
        *new.columns, F.coalesce("was", F.lit(now).cast("timestamp")).alias("i_created_at"), F.when(F.col("was").isNotNull(), F.lit(now).cast("timestamp")).alias("i_updated_at")
    )
    return merged(old, stamped, keys)


def mark_processed(trades: DataFrame, ids: DataFrame) -> DataFrame:
    """Trades whose id is in ``ids`` are flagged as part of candles."""
    done = ids.select("id").distinct().withColumn("done", F.lit(True))
    return trades.join(done, "id", "left").withColumn("i_added_to_interval", F.coalesce("done", "i_added_to_interval")).select(*trades.columns)


def dirty_days(trades: DataFrame) -> DataFrame:
    """(market_id, since): the UTC day of each market's oldest unprocessed trade; candles are recomputed from there."""
    open_trades = trades.where(~F.col("i_added_to_interval"))
    return open_trades.groupBy("market_id").agg(F.date_trunc("day", F.min("executed_at")).alias("since"))


def rebalanced(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """``rows`` with those of a partition in few tasks, in more than one where a partition is large; adaptive execution decides."""
    return rows.hint("rebalance", *by) if by else rows


def write_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Overwrite just the partitions that ``rows`` has, each in as few files as its size allows."""
    rebalanced(rows, by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
