"""Line dedup: lines that several documents hold stay in one of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, bind, cut, fresh, join_skewed, row_key

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """A line without outer white space, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, UPPER.lower())


def dedup_lines(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", min_docs: int = 2, min_chars: int = 10
) -> DataFrame:
    """Drop each line whose key ``min_docs`` or more documents hold, except in the document with the smallest id.

    Lines are exploded, normalised, hashed (two 64-bit hashes) and stored without their text; distinct documents are
    counted per hash; the positions to drop meet their text again and the rest is joined in order. Only hashes, ids and
    positions are shuffled by key; each text is shuffled once.

    Adds ``n_lines``, ``n_dropped`` and ``kept_text`` (columns of these names are replaced). Null or empty text is one
    empty line, and ``kept_text`` is then ''. Keys under ``min_chars`` code points always stay. Rows that repeat an id
    are one document: both keep the line. A null id counts as one document and as the largest id. An empty table gives
    an empty table.
    """
    # What a row loses follows from its id and text, so rows meet by hashes of these, which every scan computes alike.
    k1, k2, gone = fresh(docs, "line_k1"), fresh(docs, "line_k2"), fresh(docs, "line_gone")
    whole = docs.withColumns(dict(zip((k1, k2), row_key(F.col(doc_id), F.col(text)), strict=True)))
    body = F.coalesce(F.col(text), F.lit(""))
    lines = cut(
        whole.select(F.col(k1).alias("k1"), F.col(k2).alias("k2"), F.col(doc_id).alias("doc"), F.posexplode(F.split(body, "\n")).alias("pos", "line"))
        .withColumn("key", line_key(F.col("line")))
        .where(F.char_length("key") >= min_chars)
        .select("k1", "k2", "pos", "doc", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")),
        "line-hashes",
    )
    frequent = (
        lines.groupBy("h1", "h2", "doc")
        .agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2")
        .agg(F.count("one").alias("n_docs"), F.min(F.struct(F.col("doc").isNull().alias("last"), "doc")).alias("first"))
        .where(F.col("n_docs") >= min_docs)
        .select("h1", "h2", F.col("first.doc").alias("home"))
    )
    # Rows that repeat whole have one key; each of their lines is dropped once.
    dropped = (
        join_skewed(lines, frequent, ["h1", "h2"])
        .where(~F.col("doc").eqNullSafe(F.col("home")))
        .groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2))
        .agg(F.sort_array(F.collect_set("pos")).alias(gone))
    )
    return (
        whole.join(dropped, [k1, k2], "left")
        .withColumns(
            {
                "n_lines": F.size(F.split(body, "\n")).cast("long"),
                "n_dropped": F.coalesce(F.size(gone), F.lit(0)).cast("long"),
                "kept_text": F.when(F.col(gone).isNull(), body).otherwise(without(F.split(body, "\n"), F.col(gone))),
            }
        )
        .drop(k1, k2, gone)
    )


def without(lines: Column, gone: Column) -> Column:
    """The lines between the dropped positions, joined: one slice for each gap, so the work is linear in the lines."""

    def gaps(all_lines: Column) -> Column:
        starts = F.concat(F.array(F.lit(-1)), gone)
        ends = F.concat(gone, F.array(F.size(all_lines)))
        return F.array_join(F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(all_lines, a + 2, b - a - 1))), "\n")

    return bind(lines, gaps)
