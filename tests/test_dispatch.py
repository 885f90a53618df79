"""Events to stale tables: few pairs meet the markets, on tables and on streams."""

from tidewick.sources import tables
from tidewick.streaming import listener


def test_pairs_are_distinct_before_they_meet_markets(spark, tmp_path):
    rows = [(f"x.{kind}", [("market_id", f'"{m}"')]) for m in ("a/b", "q/q") for kind in ("OrderExecutedEvent", "OrderSavedEvent", "MarketCreatedEvent", "Other") for _ in range(3)]
    events, markets = spark.createDataFrame(rows, tables.schema.EVENT), spark.createDataFrame([("a/b",), ("c/d",)], "market_id string")
    found = listener.dispatch(events, markets)
    want = [("", "markets"), ("a/b", "candles"), ("a/b", "history"), ("a/b", "orders")]
    assert sorted((r.market_id or "", r.process) for r in found.collect()) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Join") :]
    events.write.json(str(tmp_path / "in"))
    stream = listener.dispatch(tables.event_stream(spark, str(tmp_path / "in"), 1), markets)
    stream.writeStream.format("memory").queryName("stale_pairs").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.market_id or "", r.process) for r in spark.table("stale_pairs").collect()) == want
