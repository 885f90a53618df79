"""Shared helpers of the corpus operators: words, row numbers and cut points."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

#: The six ASCII white-space characters that separate words in every contract.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"


def word_array(text: Column) -> Column:
    """Words of a text, in order; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, SPACE_CLASS + "+"))).cast("long")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have yet (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; lambdas would otherwise re-evaluate it per element."""
    return F.transform(F.array(value), body)[0]


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with row numbers, written to the shared folder once.

    A number depends on how a scan is split, which may follow the cores that are there when it runs; so numbers are
    read from the files, by all sides of a join, and never computed again.
    """
    return cut(docs.withColumn(name, F.monotonically_increasing_id()), "numbered", compression="zstd")


def row_key(*columns: Column) -> list[Column]:
    """``k1`` and ``k2``, hashes of some columns of a row (96 bits): a key that every scan computes alike, equal for equal rows."""
    return [F.xxhash64(*columns).alias("k1"), F.shiftright(F.xxhash64(F.lit(1), *columns), 32).cast("int").alias("k2")]


#: Names of the open scratch folders, the innermost last.
_SCRATCH: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    return "/".join([shared_dir(spark), "tidewick", spark.sparkContext.applicationId, *_SCRATCH, f"{name}-{uuid.uuid4().hex}"])


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is cut within goes at the end: a step's tables, once its result is stored at a path taken before."""
    folder = new_path(spark, "scratch")
    _SCRATCH.append(folder.rpartition("/")[2])
    try:
        yield
    finally:
        _SCRATCH.pop()
        delete(spark, folder)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps and lost executors start from the files."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path, **options)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete what :func:`cut` and the archive writer left in the shared folder for this application."""
    delete(spark, f"{shared_dir(spark)}/tidewick/{spark.sparkContext.applicationId}")


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_skewed(large: DataFrame, counted: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join rows with an aggregate by the same keys, where one key may have many rows.

    The aggregate already lies by its keys, and Spark would join it in place; it splits a skewed partition only if both
    sides come from exchanges made for the join. A key more, one bit of the others, asks for these exchanges.
    """
    extra = fresh(large, "join_key")
    key = F.xxhash64(*keys) > 0
    return large.withColumn(extra, key).join(counted.withColumn(extra, key), [*keys, extra], how).drop(extra)
