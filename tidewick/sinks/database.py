"""Upserts into a database through JDBC: rows are staged in parallel, then take effect in one transaction.

Each task inserts its partition into a staging table in batches. Only when all are there, one transaction on the driver
deletes and inserts by key, inside the database; so a partition that fails leaves the target as it was, and readers never
see half a batch. A task that is repeated may stage rows twice: rows carry a number, which counts once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import stored

#: Rows that a task sends at a time.
BATCH_ROWS = 1000
ROW = "stage_row"


@dataclass(frozen=True)
class Database:
    spark: SparkSession
    url: str
    #: Properties of connections, such as user, password and driver.
    properties: dict[str, str] = field(default_factory=dict)
    #: Types of columns for staging tables, e.g. those of texts: databases may not compare or group their largest kind of text.
    types: dict[str, str] = field(default_factory=dict)

    @contextmanager
    def transaction(self) -> Iterator[JavaObject]:
        jvm = self.spark.sparkContext._jvm
        properties = jvm.java.util.Properties()
        for name, value in self.properties.items():
            properties.setProperty(name, value)
        connection = jvm.java.sql.DriverManager.getConnection(self.url, properties)
        try:
            connection.setAutoCommit(False)
            yield connection
            connection.commit()
        except BaseException:
            connection.rollback()
            raise
        finally:
            connection.close()

    def quoted(self, name: str) -> str:
        """A column of a staging table, whose names Spark quotes; those of the target are written plainly."""
        return self.spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(self.url).quoteIdentifier(name)

    def run(self, *statements: str) -> None:
        """All statements in one transaction."""
        with self.transaction() as connection:
            for text in statements:
                statement = connection.createStatement()
                statement.executeUpdate(text)
                statement.close()

    @contextmanager
    def staged(self, rows: DataFrame) -> Iterator[str]:
        """A table with ``rows`` and their numbers, which goes at the end."""
        name = f"stage_{uuid.uuid4().hex[:24]}"
        numbered = stored(rows.withColumn(ROW, F.monotonically_increasing_id()), "staged")
        writer = numbered.write.option("batchsize", BATCH_ROWS)
        if types := ", ".join(f"{c} {t}" for c, t in self.types.items() if c in rows.columns):
            writer = writer.option("createTableColumnTypes", types)
        try:
            writer.jdbc(self.url, name, mode="error", properties=self.properties)
            yield name
        finally:
            try:
                self.run(f"DROP TABLE {name}")
            except Exception:  # noqa: BLE001 - a table that couldn't be created needs no end
                pass


def _matches(database: Database, keys: list[str], staged: str, target: str) -> str:
    return " AND ".join(f"{staged}.{database.quoted(k)} = {target}.{k}" for k in keys)


def _rows(database: Database, columns: list[str], stage: str) -> str:
    """The staged rows, each number once."""
    return f"(SELECT DISTINCT {', '.join(map(database.quoted, [ROW, *columns]))} FROM {stage}) d"


def _insert(database: Database, table: str, columns: list[str], stage: str, condition: str = "") -> str:
    return f"INSERT INTO {table} ({', '.join(columns)}) SELECT {', '.join(map(database.quoted, columns))} FROM {_rows(database, columns, stage)}{condition}"


def replace(database: Database, rows: DataFrame, table: str, keys: list[str]) -> None:
    """The rows of the target whose ``keys`` are among those of ``rows`` give way to these.

    Keys: (market_id, executed_at) for trades, (market_id, length, start_at) for candles, market_id for books.
    """
    with database.staged(rows) as stage:
        found = f"SELECT 1 FROM {stage} s WHERE {_matches(database, keys, 's', table)}"
        database.run(f"DELETE FROM {table} WHERE EXISTS ({found})", _insert(database, table, rows.columns, stage))


def add_new(database: Database, rows: DataFrame, table: str, keys: list[str], update: list[str]) -> None:
    """Rows with new ``keys`` are added; of known ones only the columns of ``update`` change. Keys are unique in ``rows``."""
    with database.staged(rows) as stage:
        match = f"FROM {stage} s WHERE {_matches(database, keys, 's', table)}"
        changes = ", ".join(f"{c} = (SELECT MAX(s.{database.quoted(c)}) {match})" for c in update)
        known = [f"UPDATE {table} SET {changes} WHERE EXISTS (SELECT 1 {match})"] if update else []
        fresh = f" WHERE NOT EXISTS (SELECT 1 FROM {table} t WHERE {_matches(database, keys, 'd', 't')})"
        database.run(*known, _insert(database, table, rows.columns, stage, fresh))


def mark(database: Database, ids: DataFrame, table: str, column: str = "i_added_to_interval") -> None:
    """Rows whose id is among ``ids`` are flagged."""
    with database.staged(ids.select("id").distinct()) as stage:
        database.run(f"UPDATE {table} SET {column} = TRUE WHERE EXISTS (SELECT 1 FROM {stage} s WHERE {_matches(database, ['id'], 's', table)})")
