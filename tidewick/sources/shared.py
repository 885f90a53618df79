"""The folder that the driver and all executors share, for tables that a job writes and reads again."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where it isn't set, in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidewick-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tidewick/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def arrow_files(url: str) -> tuple[fs.FileSystem, str]:
    """The Arrow file system of a folder's URL or path, and the path in it."""
    scheme, colon, rest = url.partition(":")
    if not colon or "/" in scheme or scheme == "file":
        return fs.LocalFileSystem(), os.path.normpath("/" + rest.lstrip("/")) if scheme == "file" else url
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", url))


def stored(rows: DataFrame, name: str) -> DataFrame:
    """``rows``, written to the shared folder and read back: later steps and lost executors start from the files."""
    spark, path = rows.sparkSession, shared_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
