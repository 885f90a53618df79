"""Readers: stored tables, landed documents of the chain and of other services, event streams."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.text import market_id


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def jdbc(spark: SparkSession, url: str, name: str, *, key: str | None = None, bounds: tuple[int, int] = (0, 0), parts: int = 1, **options: str) -> DataFrame:
    """A database table; with a numeric ``key`` and its bounds it is read in ``parts`` range queries at a time."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if key:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


def raw_trades(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages of the trade history, one JSON object a line; seconds may be text."""
    rows = spark.read.schema("market_id string, order_type string, price string, amount string, maker string, taker string, executed_at string").json(path)
    return rows.withColumn("executed_at", F.col("executed_at").cast("long"))


def raw_orders(spark: SparkSession, path: str) -> DataFrame:
    """Landed order books, one JSON object for each price level."""
    return spark.read.schema(schema.RAW_ORDER).json(path)


def raw_markets(spark: SparkSession, path: str) -> DataFrame:
    """Landed market list (base, quote, creator) with market ids."""
    rows = spark.read.schema("base string, quote string, creator string").json(path)
    return rows.select(market_id(F.col("base"), F.col("quote")).alias("market_id"), "base", "quote", F.col("creator").alias("created_by"))


def registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.REGISTRY).option("multiLine", True).json(path)


def coin_lists(spark: SparkSession, path: str, column: str = "supply") -> DataFrame:
    """Landed supply ('supply'), pool ('pool') or balance ('balances') lists."""
    return spark.read.schema(f"{column} array<struct<denom: string, amount: string>>").option("multiLine", True).json(path)


def price_maps(spark: SparkSession, path: str) -> DataFrame:
    """Landed price documents as a column ``prices`` of maps of maps."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema.PRICES).alias("prices"))


def feed(spark: SparkSession, path: str) -> DataFrame:
    """Items of a landed RSS feed, numbered in the order of the file, newest first as feeds have them."""
    items = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, description string, `content:encoded` string, pubDate string, `dc:creator` string").load(path)
    when = F.try_to_timestamp(F.regexp_replace("pubDate", "^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss z"))
    return items.select(
        F.monotonically_increasing_id().alias("position"), "title", "link", F.col("`content:encoded`").alias("content"), "description", when.alias("published"), F.array_compact(F.array("`dc:creator`")).alias("authors")
    )


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of events from a folder in which JSON files land."""
    return spark.readStream.schema(schema.EVENT).option("maxFilesPerTrigger", files_per_batch).json(path)


def trade_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of trades from a folder in which Parquet files land."""
    return spark.readStream.schema(schema.TRADES).option("maxFilesPerTrigger", files_per_batch).parquet(path)


@dataclass(frozen=True)
class Settings:
    """Settings from the environment; maps are written 'key=value,key=value'."""

    database_url: str = ""
    rest_url: str = ""
    rpc_url: str = ""
    native_denom: str = ""
    nodes: dict[str, str] = field(default_factory=dict)
    prefixes: dict[str, str] = field(default_factory=dict)

    @classmethod
    def from_environment(cls, environment: dict[str, str] | None = None) -> Settings:
        env = os.environ if environment is None else environment

        def pairs(name: str) -> dict[str, str]:
            return dict(part.strip().split("=", 1) for part in env.get(name, "").split(",") if "=" in part)

        return cls(env.get("DATABASE_URL", ""), env.get("REST_URL", ""), env.get("RPC_URL", ""), env.get("NATIVE_DENOM", ""), pairs("HEALTH_NODES"), pairs("ADDRESS_ENDPOINTS"))
