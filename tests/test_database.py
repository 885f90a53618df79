"""Sinks of a database, on the Derby that comes with Spark."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidewick.sinks import database

DRIVER = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
FIELDS = "id long, market_id string, price decimal(18,2), executed_at timestamp, i_added_to_interval boolean"


@pytest.fixture
def db(spark, tmp_path):
    made = database.Database(spark, f"jdbc:derby:{tmp_path}/db;create=true", DRIVER, {"market_id": "VARCHAR(64)"})
    made.run("CREATE TABLE history (id BIGINT, market_id VARCHAR(64), price DECIMAL(18,2), executed_at TIMESTAMP, i_added_to_interval BOOLEAN)")
    return made


def trades(spark, *rows):
    return spark.createDataFrame([(i, m, Decimal(p), datetime(2024, 1, 1, 0, 0, s), False) for i, m, p, s in rows], FIELDS)


def held(db):
    return sorted((r.ID, r.MARKET_ID, int(r.PRICE), r.EXECUTED_AT.second, r.I_ADDED_TO_INTERVAL) for r in db.spark.read.jdbc(db.url, "history", properties=DRIVER).collect())


def tables(db):
    return db.spark.read.jdbc(db.url, "sys.systables", properties=DRIVER).where("TABLETYPE = 'T'").select("TABLENAME").collect()


KEYS = ["market_id", "executed_at"]


def test_trades_of_a_second_are_replaced(spark, db):
    database.replace(db, trades(spark, (1, "a", 5, 1), (2, "a", 6, 1), (3, "a", 7, 2), (4, "b", 8, 1)), "history", KEYS)
    again = trades(spark, (5, "a", 9, 1), (6, "a", 9, 1), (6, "a", 9, 1))
    for _ in range(2):
        database.replace(db, again, "history", KEYS)
        assert held(db) == [(3, "a", 7, 2, False), (4, "b", 8, 1, False), (5, "a", 9, 1, False), (6, "a", 9, 1, False), (6, "a", 9, 1, False)]
    database.mark(db, trades(spark, (3, "a", 7, 2), (3, "a", 7, 2)), "history")
    assert [r for r in held(db) if r[4]] == [(3, "a", 7, 2, True)] and len(tables(db)) == 1


def test_a_partition_that_fails_changes_nothing(spark, db):
    database.replace(db, trades(spark, (1, "a", 5, 1)), "history", KEYS)
    before = held(db)
    # One of the partitions has a value that the column of the staging table can't take.
    rows = trades(spark, *[(k, "a", 1, k % 50) for k in range(3000)]).repartition(4).withColumn("market_id", F.when(F.col("id") == 2999, F.repeat(F.lit("x"), 100)).otherwise(F.col("market_id")))
    with pytest.raises(Exception):
        database.replace(db, rows, "history", KEYS)
    assert held(db) == before and len(tables(db)) == 1
    database.replace(db, rows.where("id < 2999"), "history", KEYS)
    assert len(held(db)) == 2999


def test_rows_that_a_repeated_task_stages_twice_count_once(spark, db):
    rows = trades(spark, (1, "a", 5, 1), (2, "a", 5, 1))
    with db.staged(rows) as stage:
        db.run(f"INSERT INTO {stage} SELECT * FROM {stage}")
        db.run(database._insert(db, "history", rows.columns, stage))
    assert [r[0] for r in held(db)] == [1, 2]


def test_a_transaction_that_fails_is_undone(spark, db):
    database.replace(db, trades(spark, (1, "a", 5, 1)), "history", KEYS)
    with pytest.raises(Exception):
        db.run("DELETE FROM history", "INSERT INTO nowhere VALUES (1)")
    assert len(held(db)) == 1


def test_known_markets_change_only_their_time(spark, db):
    db.run("CREATE TABLE market (market_id VARCHAR(64), base VARCHAR(64), i_created_at TIMESTAMP)")
    make = lambda *rows: spark.createDataFrame([(m, b, datetime(2024, 1, d)) for m, b, d in rows], "market_id string, base string, i_created_at timestamp")
    typed = database.Database(spark, db.url, DRIVER, {"market_id": "VARCHAR(64)", "base": "VARCHAR(64)"})
    for rows in (make(("a/x", "a", 1)), make(("a/x", "other", 2), ("b/x", "b", 2)), make(("a/x", "other", 2), ("b/x", "b", 2))):
        database.add_new(typed, rows, "market", ["market_id"], ["i_created_at"])
    found = spark.read.jdbc(db.url, "market", properties=DRIVER).collect()
    assert sorted((r.MARKET_ID, r.BASE, r.I_CREATED_AT.day) for r in found) == [("a/x", "a", 2), ("b/x", "b", 2)]
