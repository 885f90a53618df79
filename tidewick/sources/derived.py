"""The logical tables, derived from the generated star-schema tables that tests and the bench read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.history import created_at
from .tables import table

KINDS = ("click", "error", "purchase", "signup", "view")


def utc(column: str) -> Column:
    return F.col(column).cast("timestamp")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades from events; money in decimals just wide enough for the data."""
    price = F.col("value").cast("decimal(18,2)")
    amount = (F.get_json_object("props", "$.k").cast("int") + 1).cast("decimal(18,0)")
    second = F.date_trunc("second", utc("ts"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.concat("event_type", F.lit("/usd")).alias("market_id"), F.when(F.col("event_id") % 2 == 0, "buy").otherwise("sell").alias("order_type"),
        amount.alias("amount"), price.alias("price"), second.alias("executed_at"), F.col("user_id").cast("string").alias("maker"), ((F.col("user_id") * 7 + 3) % 150).cast("string").alias("taker"),
        (price * amount).cast("decimal(28,2)").alias("i_quote_amount"), second.alias("i_created_at"), (F.col("event_id") % 10 != 0).alias("i_added_to_interval"),
    )


def markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A market for each kind of event, created a minute before its first trade, and one without trades."""
    first = created_at(trades(spark, sf_dir))
    names = spark.createDataFrame([(i + 1, k) for i, k in enumerate(KINDS)] + [(len(KINDS) + 1, "idle")], "id long, base string")
    rows = names.select("id", F.concat("base", F.lit("/usd")).alias("market_id"), "base", F.lit("usd").alias("quote"), F.lit("genesis").alias("created_by"))
    return rows.join(first, "market_id", "left").select("id", "market_id", "base", "quote", "created_by", F.coalesce("i_created_at", F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("i_created_at"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price levels from the lines of open orders."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    open_orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("l_orderkey") % 5 + 1).cast("int"))
    rows = line.join(open_orders, "l_orderkey").select(
        F.concat(kind, F.lit("/usd")).alias("market_id"), F.when(F.col("l_linenumber") % 2 == 0, "buy").otherwise("sell").alias("order_type"), F.col("l_extendedprice").cast("decimal(18,2)").alias("price"), F.col("l_quantity").cast("decimal(18,0)").alias("n")
    )
    levels = rows.groupBy("market_id", "order_type", "price").agg(F.sum("n").alias("amount"))
    return levels.withColumn("price_dec", F.col("price").cast("double")).withColumn("id", (F.col("price") * 100).cast("long"))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An asset for each nation, exponents 3 to 9; the last nation's display unit is missing."""
    name = F.lower(F.replace("n_name", F.lit(" "), F.lit("")))
    base = F.concat(F.lit("u"), name)
    unit = lambda d, e: F.struct(d.alias("denom"), e.cast("int").alias("exponent"), F.array().cast("array<string>").alias("aliases"))
    shown = F.when(F.col("n_nationkey") == 24, F.lit("other")).otherwise(name)
    asset = F.struct(F.array(unit(base, F.lit(0)), unit(shown, F.col("n_nationkey") % 7 + 3)).alias("denom_units"), base.alias("base"), F.col("n_name").alias("name"), name.alias("display"), F.upper(name).alias("symbol"))
    return table(spark, sf_dir, "nation").groupBy().agg(F.lit("testchain").alias("chain_name"), F.collect_list(asset).alias("assets"))


def nation_denom(key: Column, spark: SparkSession, sf_dir: str, rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with the denomination of the nation with number ``key`` as column ``name``."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("u"), F.lower(F.replace("n_name", F.lit(" "), F.lit("")))).alias(name))
    return rows.join(nations, key == F.col("k")).drop("k")


def raw_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades in chain units from order lines: base and quote by supplier and part, nations 0 to 23."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    rows = nation_denom(F.col("l_suppkey") % 24, spark, sf_dir, line, "base")
    rows = nation_denom(F.col("l_partkey") % 24, spark, sf_dir, rows, "quote")
    return rows.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "base", "quote", F.when(F.col("l_linenumber") % 2 == 0, "buy").otherwise("sell").alias("order_type"),
        (F.col("l_extendedprice").cast("decimal(18,2)") / 100).cast("decimal(20,4)").alias("price"), (F.col("l_quantity").cast("long") * 12345).cast("decimal(19,0)").alias("amount"),
        F.lit("m").alias("maker"), F.lit("t").alias("taker"), F.unix_seconds(utc("l_shipdate")).alias("executed_at"),
    )


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One landed supply list: a coin for each nation, from its suppliers' balances."""
    rows = nation_denom(F.col("s_nationkey"), spark, sf_dir, table(spark, sf_dir, "supplier"), "denom").groupBy("denom").agg(F.sum((F.abs("s_acctbal") * 1000000).cast("long")).alias("n"))
    return rows.groupBy().agg(F.collect_list(F.struct("denom", F.col("n").cast("string").alias("amount"))).alias("supply"))


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The community pool, from customers' balances."""
    rows = nation_denom(F.col("c_nationkey"), spark, sf_dir, table(spark, sf_dir, "customer"), "denom").groupBy("denom").agg(F.sum((F.abs("c_acctbal") * 1000).cast("long")).alias("n"))
    return rows.groupBy().agg(F.collect_list(F.struct("denom", F.col("n").cast("string").alias("amount"))).alias("pool"))


def price_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A landed price document: dollars for all nations, euros for the even ones."""
    key = F.col("n_nationkey")
    quotes = F.map_from_entries(F.array_compact(F.array(F.struct(F.lit("usd").alias("k"), (key + F.lit(0.5)).alias("v")), F.when(key % 2 == 0, F.struct(F.lit("eur").alias("k"), (key * 2.0).alias("v"))))))
    rows = table(spark, sf_dir, "nation").groupBy().agg(F.map_from_entries(F.collect_list(F.struct(F.lower("n_name"), quotes))).alias("m"))
    return rows.select(F.to_json("m").alias("document"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes from nations: heights 100 to 104, two of them unknown."""
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.when(key % 12 != 11, (100 + key % 5).cast("long")).alias("height"))


def balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances of customers at addresses named by market segment."""
    coin = F.struct(F.lit("uusd").alias("denom"), F.abs(F.col("c_acctbal") * 100).cast("long").cast("string").alias("amount"))
    return table(spark, sf_dir, "customer").select(address().alias("address"), F.array(coin).alias("balances"))


def address() -> Column:
    return F.concat(F.lower("c_mktsegment"), F.col("c_custkey").cast("string"))


def balance_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A check for each customer; a fifth asks for a coin that nobody holds."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(address().alias("address"), (key % 1000 * 500).alias("min_amount"), F.when(key % 5 == 0, "uother").otherwise("uusd").alias("denom"))


def prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([("auto", "https://a.example"), ("automobile1", "https://a1.example"), ("build", "https://b.example"), ("furn", "https://f.example"), ("house", "https://h.example")], "prefix string, endpoint string")


def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed items from web pages; every third has its text as the description, every fifth a picture."""
    key = F.col("page_id")
    image = F.when(key % 5 == 0, F.concat(F.lit('<img alt="x" src="https://cdn.example/'), key.cast("string"), F.lit('.png">'))).when(key % 5 == 1, '<img src="https://else.example/x.png">').otherwise("")
    body = F.concat(image, "html")
    return table(spark, sf_dir, "pages").select(
        key.alias("position"), F.concat(F.lit("Page "), key.cast("string")).alias("title"), F.col("url").alias("link"), F.when(key % 3 == 0, "").otherwise(body).alias("content"), F.when(key % 3 == 0, body).alias("description"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("published"), F.when(key % 2 == 0, F.array(F.concat(F.lit("author "), key.cast("string")))).otherwise(F.array().cast("array<string>")).alias("authors"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chain events: error events name an unknown market, the others quote theirs."""
    kind = F.element_at(F.create_map(*[F.lit(x) for p in zip(KINDS, ("OrderSavedEvent", "OrderCanceledEvent", "OrderExecutedEvent", "MarketCreatedEvent", "OrderSavedEvent"), strict=True) for x in p]), F.col("event_type"))
    market = F.when(F.col("event_type") == "error", '"none/usd"').otherwise(F.concat(F.lit('"'), "event_type", F.lit('/usd"')))
    attributes = F.array(F.struct(F.lit("id").alias("key"), F.col("event_id").cast("string").alias("value")), F.struct(F.lit("market_id").alias("key"), market.alias("value")))
    return table(spark, sf_dir, "events").select(F.concat(F.lit("chain.trade."), kind).alias("type"), attributes.alias("attributes"))
