"""Exact dedup by a tree-merge of sorted digest runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, cut, fresh, numbered, parallelism

#: Runs that meet in one merge.
FAN_IN = 8
#: A run's order: by digest, and among equal digests the row that stays first.
ORDER = ("lane", "digest", "shortness", "no_id", "doc", "row")


def signatures(docs: DataFrame, text: str, doc_id: str, row: str) -> DataFrame:
    """Digest of each text without white space, what ranks it among equals, and what verifies that texts are equal."""
    body = F.coalesce(F.col(text), F.lit(""))
    bare = F.translate(body, SPACES, "")
    return docs.select(
        F.sha2(bare, 256).alias("digest"),
        (-F.char_length(body)).cast("long").alias("shortness"),
        F.col(doc_id).isNull().alias("no_id"),
        F.col(doc_id).alias("doc"),
        F.col(row).alias("row"),
        F.lit(1).cast("long").alias("group_size"),
        F.octet_length(bare).cast("long").alias("n_bytes"),
        F.xxhash64(bare).alias("second"),
    )


def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each digest of sorted rows: the first, with the sum of ``group_size``.

    Rows of one digest have to agree in length and in a hash of another family; otherwise two texts share a digest. A
    digest that goes on in the next batch is held back, so memory doesn't grow with its rows.
    """
    held = None
    for batch in batches:
        table = pa.Table.from_batches([b for b in (held, batch) if b is not None and b.num_rows]).combine_chunks()
        if not table.num_rows:
            continue
        rows = table.to_batches()[0]

        def follows(name: str, rows: pa.RecordBatch = rows) -> np.ndarray:
            column = rows.column(name)
            return pc.equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)

        same = follows("digest") & follows("lane")
        if not (follows("n_bytes") & follows("second"))[same].all():
            raise ValueError("two texts share a digest")
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        sums = np.add.reduceat(rows.column("group_size").to_numpy(), first)
        found = rows.take(pa.array(first))
        found = found.set_column(found.schema.get_field_index("group_size"), "group_size", pa.array(sums))
        yield found.slice(0, len(first) - 1)
        held = found.slice(len(first) - 1)
    if held is not None:
        yield held


def merge_runs(signed: DataFrame, lanes: int, fan_in: int = FAN_IN) -> DataFrame:
    """The row that stays of each digest, with the number of its rows: digest, doc, row, group_size.

    At first each partition is a lane, whose rows are sorted and merged into one run. In each round ``fan_in``
    neighbouring lanes exchange runs: a run is cut into as many digest ranges as lanes have become fewer, the runs of one
    range meet in one task, which merges them in digest order and keeps the verified first of equals. So the tasks stay as
    many and as large as at the beginning, the lanes become one in log(lanes) rounds, and a digest sends one row from
    each lane at most, however many copies it has.
    """
    every, kind = lanes, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in signed.schema.fields)
    runs = signed.withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(lanes))).sortWithinPartitions(*ORDER).mapInArrow(merge, f"{kind}, lane int")
    while lanes > 1:
        lanes = -(-lanes // fan_in)
        ranges = -(-every // lanes)
        part = F.floor(F.conv(F.substring("digest", 1, 7), 16, 10).cast("long") * ranges / F.lit(float(1 << 28)))
        met = runs.withColumn("lane", F.floor(F.col("lane") / fan_in).cast("int")).repartition("lane", part)
        runs = met.sortWithinPartitions(*ORDER).mapInArrow(merge, f"{kind}, lane int")
    return runs.select("digest", "doc", "row", "group_size")


def dedup_exact(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Mark the row that stays of each group of texts that are equal without white space.

    The row with the most code points in the original text stays, then the smallest id (null: last), then the first
    row. Adds ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` (columns of these names are replaced), for
    dropped rows too. Null text counts as ''. Rows repeated whole are copies: one of them is kept. Texts count as equal
    if SHA-256, length and a second hash agree; a digest of unequal texts is an error. An empty table gives an empty
    table.
    """
    row = fresh(docs, "exact_row")
    whole = numbered(docs, row)
    signed = cut(signatures(whole, text, doc_id, row), "exact-signed")
    best = merge_runs(signed, max(FAN_IN, parallelism(docs.sparkSession))).select("digest", F.col("doc").alias("keep_id"), F.col("row").alias("best_row"), "group_size")
    verdict = signed.select("row", "digest").join(best, "digest").select(
        F.col("row").alias(row), "keep_id", F.col("group_size"), (F.col("row") == F.col("best_row")).alias("kept"), F.col("digest").alias("text_sha256")
    )
    return whole.drop("keep_id", "group_size", "kept", "text_sha256").join(verdict, row).drop(row)
