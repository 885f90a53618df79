"""Assets: display units, conversion of chain units, supply and prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from ..functions.money import shift, shown, unshifted
from ..functions.text import market_id

#: Digits of a quote amount whose asset has no display unit.
DEFAULT_DIGITS = 6


def display_units(registry: DataFrame) -> DataFrame:
    """(base, display, exponent) of each asset; the exponent is that of the first unit named as the display, or null."""
    asset = registry.select(F.explode("assets").alias("a"))
    unit = F.get(F.filter("a.denom_units", lambda u: u["denom"] == F.col("a.display")), 0)
    return asset.select(F.col("a.base").alias("denom"), F.col("a.display").alias("display"), unit["exponent"].alias("exponent"))


def with_exponents(rows: DataFrame, units: DataFrame) -> DataFrame:
    """``rows`` (base, quote, ..) with both exponents, null where an asset or its display unit is unknown. Spark broadcasts small registries."""
    side = lambda c: units.select(F.col("denom").alias(c), F.col("exponent").alias(f"{c}_exponent"))
    return rows.join(side("base"), "base", "left").join(side("quote"), "quote", "left")


def only_known(rows: DataFrame) -> DataFrame:
    """``rows`` with exponents; an error if one is missing. A filter is evaluated whatever columns are read, also by a count."""
    missing = lambda what: F.raise_error(F.lit(f"no display denom for {what} asset")).cast("boolean")
    return rows.where(F.when(F.col("base_exponent").isNull(), missing("base")).when(F.col("quote_exponent").isNull(), missing("quote")).otherwise(True))


def display_price(price: Column, base_exponent: Column, quote_exponent: Column, compat: bool = False, kind: DecimalType | None = None) -> Column:
    """Price of a whole base unit in whole quote units; ``kind`` is the type of ``price``, if it is a decimal.

    The factor 10**(base - quote) is exact; ``compat`` rounds it to two digits first, so that differences of -3 and
    less give 0.
    """
    difference = base_exponent - quote_exponent
    whole = shift(price, difference, kind)
    return F.when(difference <= -3, F.lit(0).cast("decimal(38,18)")).otherwise(whole) if compat else whole


def display_amount(amount: Column, exponent: Column, kind: DecimalType | None = None) -> Column:
    """Whole units of an integer amount; ``kind`` is its type, if it is a decimal."""
    return shift(amount, -exponent, kind)


def decimal_kind(rows: DataFrame, name: str) -> DecimalType | None:
    kind = rows.schema[name].dataType
    return kind if isinstance(kind, DecimalType) else None


def quote_amount(amount: Column, price: Column, exponent: Column, *, wide: bool = False) -> Column:
    """Quote amount in whole units, cut (not rounded) to the digits of the quote asset, from chain units.

    The exponent of the base cancels out: chain amount * chain price is the amount in chain units of the quote, and its
    fraction is what is cut. Pass decimals whose precisions sum to 37 at most, so that the product keeps all digits, or
    ``wide``: then the whole and the fraction of a price of up to 18 digits each are multiplied apart by a whole amount.
    """
    if wide:
        units, left = F.abs(price).cast("decimal(36,18)"), F.abs(amount).cast("decimal(19,0)")
        ones = F.floor(units).cast("decimal(18,0)")
        whole = left * ones + F.floor(left * (units - ones.cast("decimal(36,18)")).cast("decimal(18,18)"))
        product = F.signum(amount) * F.signum(price)
    else:
        product = amount * price
        whole = F.floor(F.abs(product))
    cut = unshifted(whole.cast("decimal(38,0)"), F.coalesce(exponent, F.lit(DEFAULT_DIGITS)))
    return F.when(product < 0, -cut).otherwise(cut)


def is_wide(rows: DataFrame) -> bool:
    """Whether a product of price and amount might lose digits."""
    kinds = [decimal_kind(rows, c) for c in ("price", "amount")]
    return None not in kinds and sum(k.precision for k in kinds) > 37 + 2 and kinds[0].scale > 4


def convert_trades(raw: DataFrame, units: DataFrame, *, compat: bool = False, strict: bool = True) -> DataFrame:
    """Raw trades (id, base, quote, order_type, price, amount, maker, taker, executed_at in seconds) as history rows.

    ``strict`` raises where an asset is unknown or has no display unit, whatever columns are read; otherwise these rows
    have null prices and amounts, and quote amounts have 6 digits.
    """
    e = lambda c: F.col(f"{c}_exponent")
    rows = with_exponents(raw, units)
    rows = only_known(rows) if strict else rows
    priced = rows.withColumns({"shown_price": display_price(F.col("price"), e("base"), e("quote"), compat, decimal_kind(raw, "price")), "shown_amount": display_amount(F.col("amount"), e("base"), decimal_kind(raw, "amount"))})
    quote = quote_amount(F.col("amount"), F.col("price"), F.col("quote_exponent"), wide=is_wide(raw))
    if compat:
        quote = F.when(F.col("shown_price") == 0, F.lit(0).cast("decimal(38,18)")).otherwise(quote)
    return priced.select(
        "id", market_id(F.col("base"), F.col("quote")).alias("market_id"), "order_type", F.col("shown_amount").alias("amount"), F.col("shown_price").alias("price"),
        F.timestamp_seconds("executed_at").alias("executed_at"), "maker", "taker", quote.alias("i_quote_amount"), F.timestamp_seconds("executed_at").alias("i_created_at"), F.lit(False).alias("i_added_to_interval"),
    )


def convert_orders(raw: DataFrame, units: DataFrame, as_of: str, *, compat: bool = False, strict: bool = True) -> DataFrame:
    """Raw price levels (id, base, quote, order_type, price, amount) as book rows; buys and sells come in one frame.

    ``strict`` raises where an asset is unknown or has no display unit; otherwise these rows have null prices and amounts.
    """
    rows = with_exponents(raw, units)
    rows = only_known(rows) if strict else rows
    shown_price = display_price(F.col("price"), F.col("base_exponent"), F.col("quote_exponent"), compat, decimal_kind(raw, "price"))
    amount = display_amount(F.col("amount"), F.col("base_exponent"), decimal_kind(raw, "amount"))
    known = rows.withColumn("i_quote_amount", quote_amount(F.col("amount"), F.col("price"), F.col("quote_exponent"), wide=is_wide(raw))).withColumns({"price": shown_price, "amount": amount})
    return known.select(
        "id", market_id(F.col("base"), F.col("quote")).alias("market_id"), "order_type", "amount", "price", F.col("price").cast("double").alias("price_dec"),
        F.when(F.col("price") == 0, F.lit(0).cast("decimal(38,18)")).otherwise(F.col("i_quote_amount")).alias("i_quote_amount"), F.lit(as_of).cast("timestamp").alias("i_created_at"),
    )


def total_supply(coins: DataFrame, units: DataFrame) -> DataFrame:
    """(denom, total) as text with two digits; coins whose asset has no display unit drop out."""
    whole = F.col("amount").cast("double") / F.pow(F.lit(10.0), F.col("exponent"))
    return coins.join(units, "denom").where("exponent is not null").select("denom", F.format_string("%.2f", whole).alias("total"))


def circulating_supply(coins: DataFrame, pool: DataFrame, units: DataFrame, native: str) -> DataFrame:
    """(denom, circulating): of the native denomination the total less what the pool holds, of others the total.

    A native total without a pool is '0', as where the pool can't be read.
    """
    total = total_supply(coins, units)
    held = pool.where(F.col("denom") == native).groupBy("denom").agg(F.first("amount").alias("held"))
    rest = F.col("total").cast("double") - F.col("held").cast("double") / F.pow(F.lit(10.0), F.col("exponent"))
    shown_rest = F.when(F.col("held").isNull(), "0").otherwise(F.format_string("%.2f", rest))
    rows = total.join(units.select("denom", "exponent"), "denom").join(held, "denom", "left")
    return rows.select("denom", F.when(F.col("denom") == native, shown_rest).otherwise(F.col("total")).alias("circulating"))


def coins_of(lists: DataFrame, column: str = "supply") -> DataFrame:
    """(denom, amount) rows of landed coin lists."""
    return lists.select(F.explode(column).alias("c")).select("c.denom", "c.amount")


def prices(landed: DataFrame, column: str, currency: str) -> DataFrame:
    """(denom, price, price_denom) of a map of maps, one row for each id that has the currency."""
    rows = landed.select(F.explode(column).alias("denom", "quotes"))
    return rows.select("denom", F.try_element_at("quotes", F.lit(currency)).alias("price"), F.lit(currency).alias("price_denom")).where("price is not null")


def shown_amounts(rows: DataFrame, *columns: str) -> DataFrame:
    """Decimal columns as trimmed text, for output."""
    return rows.withColumns({c: shown(F.col(c)) for c in columns})


