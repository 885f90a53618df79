"""Interaction of filters: what each of five filters removes in every order, as products of a histogram and matrices.

Which filters a document fails doesn't depend on their order, so a part of the corpus is known by how many documents
fail each of the 32 sets of filters. These counts, and those of good and of toxic documents, are the rows that integer
matrices of 32 by 600 (a column for each order and step) turn into what is kept, removed, redundant and unique.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, cut, join_skewed

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
SETS, STEPS = 1 << len(FILTERS), len(FILTERS)
#: Thresholds: words of a text, percent of distinct words, percent of capitals.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 100, 80, 10
OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
#: Parts whose rows are made at a time.
PARTS = 64

#: The filter, by its place in FILTERS, of each order and step.
PLACES = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])


def matrices() -> dict[str, np.ndarray]:
    """For each outcome the sets of failed filters (rows) that have it, for each order and step (columns)."""
    failed = np.arange(SETS)[:, None, None]
    here = 1 << PLACES
    before = np.cumsum(here, axis=1) - here
    fails, gone = (failed & here) != 0, (failed & before) != 0
    outcomes = {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": np.broadcast_to(failed == here, fails.shape)}
    return {k: v.reshape(SETS, -1).astype(np.int64) for k, v in outcomes.items()}


def failures(words: Column, body: Column) -> list[Column]:
    """Conditions under which a text fails the filters that look at it alone (A to D)."""
    capitals = F.char_length(F.regexp_replace(body, "[^A-Z]+", "")).cast("long")
    return [
        F.size(words) < MIN_WORDS,
        100 * F.size(F.array_distinct(words)).cast("long") < MIN_DISTINCT * F.size(words).cast("long"),
        100 * capitals > MAX_CAPITALS * F.char_length(body).cast("long"),
        body.rlike("[#$%&*|]"),
    ]


def failed_sets(docs: DataFrame, labels: DataFrame, *, text: str, doc_id: str, part: str) -> DataFrame:
    """(part, failed, good, toxic): a row for each document, ``failed`` as bits in the order of FILTERS."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    worded = rows.withColumn("words", F.array_remove(F.split("body", SPACE_CLASS + "+"), ""))
    bits = [F.when(condition, 1 << k).otherwise(0) for k, condition in enumerate(failures(F.col("words"), F.col("body")))]
    judged = worded.select("doc_id", "part", sum(bits[1:], bits[0]).alias("own"), F.unhex(F.sha2("body", 256)).alias("same"))
    is_one = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(c)
    marks = labels.groupBy("doc_id").agg(is_one("quality"), is_one("toxic"))
    # Texts are read once: what their other copies decide follows from this table, which holds no text.
    told = cut(join_skewed(judged, marks, ["doc_id"], "left"), "filter-sets")
    first = told.groupBy("same").agg(F.min("doc_id").alias("first_id"))
    again = F.when(F.col("doc_id") > F.col("first_id"), 1 << FILTERS.index("E")).otherwise(0)
    one = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return join_skewed(told, first, ["same"]).select("part", (F.col("own") + again).alias("failed"), one("quality"), one("toxic"))


def outcomes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each part from its histogram."""
    by_outcome = matrices()
    own = (PLACES.reshape(-1)[:, None] == np.arange(STEPS)).astype(np.int64)
    for whole in batches:
        for at in range(0, whole.num_rows, PARTS):
            batch = whole.slice(at, PARTS)
            n, lists = batch.num_rows, batch.column("cells")
            row = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy())
            cells = lists.flatten()
            counts = {}
            for name in ("n", "good", "toxic"):
                counts[name] = np.zeros((n, SETS), dtype=np.int64)
                counts[name][row, cells.field("failed").to_numpy()] = cells.field(name).to_numpy()
            found = {name: counts["n"] @ matrix for name, matrix in by_outcome.items()}
            found["good_lost"], found["toxic_lost"] = counts["good"] @ by_outcome["removed"], counts["toxic"] @ by_outcome["removed"]
            found["shapley"] = found["removed"] @ own @ own.T
            columns = [
                batch.column("part").take(pa.array(np.repeat(np.arange(n), len(ORDERS) * STEPS))),
                pa.array(np.repeat(ORDERS, STEPS).tolist() * n, pa.string()),
                pa.array(np.tile(np.arange(1, STEPS + 1, dtype=np.int32), n * len(ORDERS))),
                *[pa.array(found[name].reshape(-1)) for name in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")],
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in OUT.split(", ")])


def audit(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", part: str = "lang") -> DataFrame:
    """One row for each part, order of the filters and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A text fails A with under 100 words, B if under 80 % of its words are distinct, C if over 10 % of its characters are
    A to Z, D if it holds one of ``#$%&*|``, E if a smaller id has the same text anywhere in the table. Counts are of
    documents of the part: kept after the step; removed here; redundant, which fail the filter and were removed earlier;
    failing this filter alone; removed here though labelled good (quality 1); removed here and labelled toxic; and what
    the filter removes, summed over all orders.

    Equal texts meet by SHA-256 of the whole text, with partial minima before the shuffle, and rows of many copies are
    split. A histogram has 32 counts for each part, so what is multiplied doesn't grow with documents.

    A null text is empty, a null part ''. A null id is no smaller than any other and none is smaller than it, and it has
    no labels; rows that repeat an id are copies of none of each other. Of several labels of an id the largest count.
    Other columns are not read. An empty table gives an empty table.
    """
    cells = failed_sets(docs, labels, text=text, doc_id=doc_id, part=part).groupBy("part", "failed").agg(F.count("*").alias("n"), F.sum("quality").alias("good"), F.sum("toxic").alias("toxic"))
    return cells.groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("cells")).mapInArrow(outcomes, OUT)
