"""Results as JSON documents, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_documents(rows: DataFrame, name: str = "document") -> DataFrame:
    """One JSON object for each row; null fields are written too."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias(name))


def from_documents(documents: DataFrame, schema: str, name: str = "document") -> DataFrame:
    """The rows that the objects hold."""
    return documents.select(F.from_json(name, schema).alias("d")).select("d.*")
