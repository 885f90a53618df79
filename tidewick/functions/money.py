"""Fixed-point helpers: trimming, rounding, exact shifts by powers of ten, strict division."""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Context, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

MONEY = "decimal(38,18)"


def trim_zeros(text: Column) -> Column:
    """A decimal as text without trailing zeros: 1.500 -> 1.5, 10.0 -> 10; text without a dot stays."""
    shorter = F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))
    return F.when(text.contains("."), shorter).otherwise(text)


def shown(value: Column) -> Column:
    """A decimal column as trimmed text."""
    return trim_zeros(value.cast(MONEY).cast("string"))


def shift(value: Column, exponent: Column, kind: DecimalType | None = None) -> Column:
    """value * 10**exponent with 18 digits, half to even.

    A decimal times a power of ten is a move of the point. Where ``kind``, the type of ``value``, leaves room for the
    power, this is a product that keeps all digits; otherwise, and for powers out of that room, the point moves in the
    text of the integer form, as a product of two decimal(38,18) would lose some.
    """
    moved = shift_text(F.replace(value.cast(MONEY).cast("string"), F.lit("."), F.lit("")), exponent.cast("int"))
    room = 37 - kind.precision if kind else 0
    scale = min(room // 2, 18 - kind.scale) if kind else 0
    if room < 1 or scale < 0:
        return moved
    powers = F.array(*[F.lit(f"{Decimal(1).scaleb(k):f}").cast(DecimalType(room, scale)) for k in range(-scale, room - scale)])
    product = (value * F.get(powers, exponent.cast("int") + scale)).cast(MONEY)
    return F.when(exponent.between(-scale, room - scale - 1), product).otherwise(moved)


def shift_text(digits: Column, exponent: Column) -> Column:
    """digits * 10**(exponent - 18) with 18 digits, half to even; ``digits`` is a whole number as text.

    The cast rounds halves up, so halves whose last digit came out odd are cut instead.
    """
    up = F.concat(digits, F.lit("E"), (exponent - 18).cast("string")).cast(MONEY)
    half = (exponent < 0) & (F.right(digits, -exponent) == F.rpad(F.lit("5"), -exponent, F.lit("0")))
    odd = F.right(up.cast("string"), F.lit(1)).isin("1", "3", "5", "7", "9")
    cut = F.concat(F.left(digits, F.length(digits) + exponent), F.lit("0E-19")).cast(MONEY)
    return F.when(half & odd, cut).otherwise(up)


def unshifted(whole: Column, digits: Column) -> Column:
    """A whole number / 10**digits, exactly, for numbers of up to 20 digits before the point then.

    What fits a long is divided as one: the quotient and the rest times a power are both exact. Others move the point in
    the text.
    """
    held, at = whole.try_cast("bigint"), digits.cast("int")
    power = F.get(F.array(*[F.lit(10**k).cast("bigint") for k in range(19)]), at)
    part = F.get(F.array(*[F.lit(f"{Decimal(1).scaleb(-k):f}").cast("decimal(19,18)") for k in range(19)]), at)
    rest = ((held % power).cast("decimal(18,0)") * part).cast("decimal(18,18)")
    divided = (F.call_function("div", held, power).cast("decimal(19,0)") + rest).cast(MONEY)
    moved = F.bround(F.concat(whole.cast("string"), F.lit("E"), (-at).cast("string")).cast(MONEY), 18)
    return F.when(held.isNotNull() & at.between(0, 18), divided).otherwise(moved)


def percent_change(open_price: Column, last_price: Column) -> Column:
    """Change from open to last in percent; 0 where there was no positive open price."""
    return F.when(open_price <= 0, F.lit(0.0)).otherwise((last_price - open_price).cast("double") / open_price.cast("double") * 100)


def round_percent(value: Column) -> Column:
    """Two digits, halves away from zero, on the double: 1.005 gives 1.0."""
    return F.round(value * 100) / 100


@F.pandas_udf(DecimalType(38, 18))
def strict_divide(a: pd.Series, b: pd.Series) -> pd.Series:
    """a / b with 18 digits, half to even; for aggregated rows, where Spark's own division would keep 6 digits."""
    wide, unit = Context(prec=78, rounding=ROUND_HALF_EVEN), Decimal(1).scaleb(-18)
    return pd.Series([None if x is None or not y else wide.quantize(wide.divide(x, y), unit) for x, y in zip(a, b, strict=True)], dtype=object)
