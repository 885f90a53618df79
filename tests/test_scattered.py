from pyspark.sql import functions as F
from test_candles import frame

from tidewick.plans import catalog
from tidewick.sources import derived


def test_landed_files_stay_small(spark):
    trades = frame(spark, [(k, 1, 1, 1) for k in range(4000)])
    sizes = [r["count"] for r in catalog.scattered(trades, 100).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 200


def test_trades_of_a_second_land_together(spark):
    trades = derived.trades(spark, "/root/testdata/sf0.01")
    placed = catalog.scattered(trades, 100).withColumn("part", F.spark_partition_id())
    assert placed.groupBy("market_id", "executed_at").agg(F.count_distinct("part").alias("n")).where("n > 1").count() == 0
