"""Schemas of the logical tables. Money is DECIMAL(38,18) at rest; computations may use narrower decimals."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(38, 18)


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


TEXT, LONG, INT, DOUBLE, TIME, FLAG = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.TimestampType(), T.BooleanType()

MARKETS = _table(id=LONG, market_id=TEXT, base=TEXT, quote=TEXT, created_by=TEXT, i_created_at=TIME)
TRADES = _table(
    id=LONG, market_id=TEXT, order_type=TEXT, amount=MONEY, price=MONEY, executed_at=TIME, maker=TEXT, taker=TEXT, i_quote_amount=MONEY, i_created_at=TIME, i_added_to_interval=FLAG
)
ORDERS = _table(id=LONG, market_id=TEXT, order_type=TEXT, amount=MONEY, price=MONEY, price_dec=DOUBLE, i_quote_amount=MONEY, i_created_at=TIME)
CANDLES = _table(
    market_id=TEXT, length=INT, start_at=TIME, end_at=TIME, lowest_price=MONEY, open_price=MONEY, average_price=DOUBLE, highest_price=MONEY, close_price=MONEY, base_volume=MONEY, quote_volume=MONEY
)
DENOM_UNIT = T.StructType([T.StructField("denom", TEXT), T.StructField("exponent", INT), T.StructField("aliases", T.ArrayType(TEXT))])
ASSET = T.StructType([T.StructField("denom_units", T.ArrayType(DENOM_UNIT)), *[T.StructField(n, TEXT) for n in ("base", "name", "display", "symbol")]])
REGISTRY = T.StructType([T.StructField("chain_name", TEXT), T.StructField("assets", T.ArrayType(ASSET))])
COIN = T.StructType([T.StructField("denom", TEXT), T.StructField("amount", TEXT)])
COIN_LIST = T.StructType([T.StructField("supply", T.ArrayType(COIN))])
RAW_TRADE = _table(market_id=TEXT, order_type=TEXT, price=TEXT, amount=TEXT, maker=TEXT, taker=TEXT, executed_at=LONG)
RAW_ORDER = _table(market_id=TEXT, order_type=TEXT, price=TEXT, amount=TEXT)
PRICES = T.MapType(TEXT, T.MapType(TEXT, DOUBLE))
EVENT = T.StructType([T.StructField("type", TEXT), T.StructField("attributes", T.ArrayType(T.StructType([T.StructField("key", TEXT), T.StructField("value", TEXT)])))])
