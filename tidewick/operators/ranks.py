"""Ranks within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

PART = "rank_part"


def ranked(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """``rows`` with ``place``, from 1 in each group in ``order``, and ``total``, the rows of the group.

    Rows are sorted over range partitions, so a group lies in as many of them as it needs. A partition numbers the rows it
    has of a group; what partitions exchange is one count for each group and partition. The partition is stored with its
    rows, as ranges are drawn anew by each run.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = stored(rows.repartitionByRange(parts, *by, *order).withColumn(PART, F.spark_partition_id()), "ranked")
    local = F.row_number().over(Window.partitionBy(*by, PART).orderBy(*order))
    counts = cut.groupBy(*by, PART).agg(F.count("*").alias("n"))
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("n").over(group.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*[F.col(c).alias(f"of_{c}") for c in (*by, PART)], before.alias("before"), F.sum("n").over(group).alias("total"))
    same = F.lit(True)
    for c in (*by, PART):
        same = same & F.col(c).eqNullSafe(F.col(f"of_{c}"))
    return cut.withColumn("place", local).join(offsets, same).withColumn("place", F.col("place") + F.col("before")).select(*rows.columns, "place", "total")
