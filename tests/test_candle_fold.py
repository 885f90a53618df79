import random

import pytest
from test_candles import frame, model, result

from tidewick.operators import candles as ohlc
from tidewick.operators import fold


def test_no_candle_is_collected(spark):
    rows = [(k, 2, 3, 6) for k in range(3000)] + [(5000, 0, 4, 0)]
    found = ohlc.folded(frame(spark, rows), (5, 1440))
    assert found.count() == 2
    # Of a candle only one row for each stretch of its dust is listed.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") <= 2 and "struct(part" in plan


def test_one_candle_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(k // 2, k % 5, 3, 3 * (k % 5) * (k > 40)) for k in range(300)] + [(90000, 0, 4, 0), (90001, 2, 1, 2)]
        found = ohlc.candles(frame(spark, rows), (1440,), strict=True)
        assert result(found) == model(rows, 1440)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def candle(r):
    """Dust with few prices, zeros, equal prices that come back after a zero; then, perhaps, trades with a quote amount."""
    prices, rows = r.choice([[0], [1], [0, 1], [1, 2], [0, 2, 1], [0, 3, 3, 2]]), []
    for k in range(r.randint(0, 25)):
        if r.random() < 0.2:
            prices = r.choice([[0], [3], [0, 1], [1, 2], [5]])
        rows.append((k, r.choice(prices), r.randint(1, 9), 0))
    for k in range(r.choice([0, 0, 1, 2, 6])):
        p, b = r.choice([0, 1, 2, 5]), r.randint(1, 9)
        rows.append((30 + k, p, b, r.choice([0, p * b])))
    return rows


@pytest.mark.parametrize("rows_of_a_stretch", [1, 2, 5, 1000])
def test_dust_split_anywhere(spark, monkeypatch, rows_of_a_stretch):
    """Many dusty candles, whose dust is cut into stretches at whatever places range partitions end."""
    r, rows = random.Random(rows_of_a_stretch), []
    for k in range(120):
        rows += [(300 * k + s, p, b, q) for s, p, b, q in candle(r)]
    monkeypatch.setattr(fold.exact, "__kwdefaults__", {"stretch_rows": rows_of_a_stretch})
    assert result(ohlc.candles(frame(spark, rows), (5,), strict=True)) == model(rows, 5)
    assert result(ohlc.candles(frame(spark, rows), (60,), strict=True)) == model(rows, 60)


def test_stretches_combine_in_any_grouping():
    """The machine over a whole sequence equals its stretches, each after the high and low of what precedes it."""
    r = random.Random(9)
    for _ in range(300):
        dust = [(r.choice([0, 1, 1, 2]), r.randint(1, 5)) for _ in range(r.randint(2, 30))]
        ends = sorted(r.sample(range(1, len(dust)), min(3, len(dust) - 1)))
        whole = fold.Stretch(0, 0)
        for x in dust:
            whole.add(*x)
        zero, base, before = True, 0, fold.Stretch(0, 0)
        for a, b in zip([0, *ends], [*ends, len(dust)], strict=True):
            part = fold.Stretch(before.high, before.low)
            for x in dust[a:b]:
                part.add(*x)
                before.add(*x)
            zero_after, amount, anew, last = part.states[int(zero)]
            zero, base = zero_after, amount if anew else base + amount
        assert [zero, base] == whole.states[1][:2] and last == whole.states[1][3]


def test_a_price_set_after_a_zero_average_is_the_average(spark):
    """The trade that starts volumes anew sets the average to its price, though its own quote amount is cut to nothing."""
    rows = [(0, 0.01, 5, 0), (1, 0.02, 5, 0), (2, 0.03, 1, 0), (3, 0.05, 2, 0.1)]
    (found,) = ohlc.candles(frame(spark, rows), (5,)).collect()
    assert found.base_volume == 3
    (found,) = ohlc.candles(frame(spark, rows[:3]), (5,)).collect()
    assert found.base_volume == 1 and found.average_price == pytest.approx(0.03)
