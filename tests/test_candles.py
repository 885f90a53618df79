import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone
from decimal import ROUND_HALF_EVEN, Decimal

import pytest
from pyspark.sql import functions as F

from tidewick.functions.buckets import LENGTHS
from tidewick.operators import candles as ohlc
from tidewick.operators import gapfill, tickers

START = datetime(2024, 1, 1, 0, 0)
FIELDS = "id long, market_id string, order_type string, price decimal(18,2), amount decimal(18,0), i_quote_amount decimal(28,2), executed_at timestamp"


def frame(spark, rows):
    """rows: (second, price, amount, quote)"""
    data = [(i + 1, "a/b", "buy", Decimal(str(p)), Decimal(b), Decimal(str(q)), START + timedelta(seconds=s)) for i, (s, p, b, q) in enumerate(rows)]
    return spark.createDataFrame(data, FIELDS)


def model(rows, minutes):
    """Fold trades one by one, as the rules of the candle say."""
    groups = defaultdict(list)
    for i, (s, p, b, q) in sorted(enumerate(rows), key=lambda x: (x[1][0], x[0])):
        groups[s // (60 * minutes)].append((s, Decimal(str(p)), Decimal(b), Decimal(str(q))))
    out = {}
    for k, trades in groups.items():
        low = high = base = quote = average = Decimal(0)
        for _, p, b, q in trades:
            low = p if low == 0 or p < low else low
            high = p if high == 0 or p > high else high
            if average == 0:
                base, quote, average = b, q, p
                continue
            base, quote = base + b, quote + q
            average = p if high == low else (quote / base).quantize(Decimal(1).scaleb(-18), ROUND_HALF_EVEN)
        last = max(t[0] for t in trades)
        out[k * 60 * minutes] = (low, high, trades[0][1], next(t[1] for t in trades if t[0] == last), base, quote, average)
    return out


def result(df):
    seconds = lambda t: int((t - START).total_seconds())
    return {seconds(r.start_at): (r.lowest_price, r.highest_price, r.open_price, r.close_price, r.base_volume, r.quote_volume, r.average_price) for r in df.collect()}


def test_volumes_start_anew_after_a_zero_average(spark):
    df = ohlc.candles(frame(spark, [(0, 0.01, 5, 0), (1, 0.02, 5, 0), (2, 0.03, 7, 0.21)]), (5,))
    (row,) = df.collect()
    assert (row.base_volume, row.quote_volume) == (7, Decimal("0.21")) and row.average_price == pytest.approx(0.03)


def test_ties_take_the_first_trade_for_open_and_close(spark):
    (row,) = ohlc.candles(frame(spark, [(7, 1, 1, 1), (7, 2, 1, 2)]), (5,)).collect()
    assert (row.open_price, row.close_price) == (1, 1)


@pytest.mark.parametrize("zeros", [False, True])
def test_random_trades_match_the_fold(spark, zeros):
    r = random.Random(5 + zeros)
    rows = []
    for _ in range(1500):
        p = r.choice([0, 1, 2, 3]) if zeros and r.random() < 0.4 else r.randint(1, 900) / 100
        b = r.randint(1, 9)
        rows.append((r.randint(0, 2 * 86400), p, b, 0 if zeros and r.random() < 0.3 else round(p * b, 2)))
    found = ohlc.candles(frame(spark, rows), strict=True).cache()
    for minutes in LENGTHS:
        assert result(found.where(F.col("length") == minutes)) == model(rows, minutes)


def test_no_trades_no_candles(spark):
    assert ohlc.candles(frame(spark, [])).count() == 0


def market(spark, created=START):
    return spark.createDataFrame([(1, "a/b", "a", "b", "x", created)], "id long, market_id string, base string, quote string, created_by string, i_created_at timestamp")


@pytest.mark.parametrize("as_of, rows", [("2024-01-20 12:02:30", 10), ("2024-01-20 12:00:00", 11)])
def test_gap_fill_of_an_aligned_moment_has_one_bucket_more(spark, as_of, rows):
    filled = gapfill.gapfilled(ohlc.candles(frame(spark, []), (5,)), market(spark), as_of, 5, 10)
    assert filled.count() == rows and filled.where("close_price <> 0").count() == 0


def test_full_charts_are_not_filled(spark):
    now = "2024-01-01 00:50:00"
    rows = [(300 * k, 5, 1, 5) for k in range(1, 11)]
    filled = gapfill.gapfilled(ohlc.candles(frame(spark, rows), (5,)), market(spark, START - timedelta(days=1)), now, 5, 10)
    assert filled.count() == 10 and filled.where("close_price = 5").count() == 10


@pytest.mark.parametrize("lows, low", [((5, 0, 3), 3), ((5, 3, 0), 0), ((5, 3, 4), 3), ((0, 0, 2), 2)])
def test_a_zero_low_gives_way_to_the_next(spark, lows, low):
    rows = [("a/b", 5, START + timedelta(minutes=5 * i), Decimal(x), Decimal(9), Decimal(1), Decimal(1), Decimal(1)) for i, x in enumerate(lows)]
    df = spark.createDataFrame(rows, "market_id string, length int, start_at timestamp, lowest_price decimal(18,2), highest_price decimal(18,2), open_price decimal(18,2), base_volume decimal(18,2), quote_volume decimal(18,2)")
    assert tickers.day_summary(df, "2024-01-01 01:00:00").first().low == low


def test_utc():
    assert START.replace(tzinfo=timezone.utc).timestamp() % 86400 == 0
