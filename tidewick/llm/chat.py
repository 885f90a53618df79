"""Chat logs: snapshots that longer logs continue are dropped, the rest is rendered."""

from __future__ import annotations

from collections.abc import Iterator
from secrets import randbits

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_skewed, parallelism

#: Turns that one rendered row holds at most.
SEGMENT = 256


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the turns of each conversation within a sorted partition."""
    last, seen = object(), 0
    for batch in batches:
        conv, n = batch.column("conv"), batch.num_rows
        if not n:
            continue
        null = conv.is_null().to_numpy(zero_copy_only=False)
        same_as_before = pc.fill_null(pc.equal(conv[1:], conv[:-1]), False).to_numpy(zero_copy_only=False) | (null[1:] & null[:-1])
        starts = np.flatnonzero(np.concatenate([[True], ~same_as_before]))
        lengths = np.diff(np.append(starts, n))
        place = np.arange(n) - np.repeat(starts, lengths)
        if conv[0].as_py() == last:
            place[: lengths[0]] += seen
        last, seen = conv[-1].as_py(), int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], names=[*batch.schema.names, "place"])


def turn_digest() -> Column:
    """SHA-256 of a turn's role and text; null and '' differ."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-"))
    return F.unhex(F.sha2(F.concat(part("role"), part("text")), 256))


def turn_hash(key: int) -> Column:
    """Hash of a turn at its position."""
    return F.xxhash64(F.lit(key), "position", "digest")


def same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def positions(log: DataFrame, *, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, part, role, text, digest, position, n_turns): turns numbered across sorted partitions.

    A conversation may span partitions; what these exchange is one row for each partition and conversation.
    """
    kind = lambda c: log.schema[c].dataType.simpleString()
    turns = log.select(F.col(conv_id).alias("conv"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text")).distinct()
    order = ["conv", "turn", "role", "text"]
    ranged = cut(turns, "chat-turns").repartitionByRange(parallelism(log.sparkSession), *order).sortWithinPartitions(*order)
    fields = f"conv {kind(conv_id)}, turn {kind(turn)}, role string, text string, part int, place long"
    placed = cut(ranged.withColumn("part", F.spark_partition_id()).mapInArrow(_places, fields), "chat-placed")
    blocks = placed.groupBy(F.col("conv").alias("of"), F.col("part").alias("in")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy("of")
    offsets = blocks.select(
        "of", "in", F.coalesce(F.sum("n").over(whole.orderBy("in").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"), F.sum("n").over(whole).alias("n_turns")
    )
    return placed.join(offsets, same("conv", "of") & (F.col("part") == F.col("in"))).select("conv", "part", "role", "text", turn_digest().alias("digest"), (F.col("place") + F.col("offset") + 1).alias("position"), "n_turns")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv, position, n_turns, h1, h2): the rolling hash of the first ``position`` turns of each conversation.

    A prefix's hash is the exclusive or of the hashes of its turns at their positions, 64 bits twice: one more turn
    costs one step, and partial hashes of partitions combine in any grouping. Turns can be chosen so that exclusive ors
    agree, if their hashes are known; these are seeded with numbers drawn for this run.
    """
    keyed = turns.select("conv", "part", "position", "n_turns", turn_hash(randbits(63)).alias("z1"), turn_hash(randbits(63)).alias("z2"))
    up_to = Window.partitionBy("conv", "part").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    local = keyed.select("conv", "part", "position", "n_turns", *[F.bit_xor(z).over(up_to).alias(z) for z in ("z1", "z2")])
    earlier = Window.partitionBy("of").orderBy("in").rowsBetween(Window.unboundedPreceding, -1)
    blocks = keyed.groupBy(F.col("conv").alias("of"), F.col("part").alias("in")).agg(F.bit_xor("z1").alias("b1"), F.bit_xor("z2").alias("b2"))
    before = blocks.select("of", "in", *[F.coalesce(F.bit_xor(b).over(earlier), F.lit(0).cast("long")).alias(b) for b in ("b1", "b2")])
    joined = local.join(before, same("conv", "of") & (F.col("part") == F.col("in")))
    return joined.select("conv", "position", "n_turns", F.col("z1").bitwiseXOR(F.col("b1")).alias("h1"), F.col("z2").bitwiseXOR(F.col("b2")).alias("h2"))


KEY = ["position", "h1", "h2"]


def claims(rolled: DataFrame) -> DataFrame:
    """(conv, by, continued): for each conversation one that begins with all its turns, if hashes are right.

    That is a longer one, if there is any, else the smallest id of the equal ones, which may be the conversation itself.
    """
    last, who = F.col("position") == F.col("n_turns"), F.struct(F.col("conv").isNull().alias("last"), "conv")
    ends = rolled.where(last).select("conv", *KEY)
    met = rolled.groupBy(*KEY).agg(F.min(F.when(~last, who)).alias("longer"), F.min(F.when(last, who)).alias("first")).where("first is not null")
    return join_skewed(ends, met, KEY).select("conv", F.coalesce("longer", "first")["conv"].alias("by"), F.col("longer").isNotNull().alias("continued"))


def refuted(turns: DataFrame, claimed: DataFrame) -> DataFrame:
    """The claims (conv, by) in which a turn of ``conv`` isn't that of ``by`` at its position.

    Turns are compared by SHA-256. Those that many claims have in common are one row before they meet the turns of the
    conversation that is to replace them all.
    """
    of = claimed.select(F.col("conv").alias("of"), "by")
    said = cut(turns.select("conv", "position", "digest").join(of, same("conv", "of")).select("of", "by", "position", "digest"), "chat-said")
    spoken = turns.select(F.col("conv").alias("speaker"), F.col("position").alias("at"), F.col("digest").alias("is"))
    match = same("by", "speaker") & (F.col("position") == F.col("at")) & (F.col("digest") == F.col("is"))
    other = said.select("by", "position", "digest").distinct().join(spoken, match, "left_anti")
    wrong = other.select(F.col("by").alias("wrong"), F.col("position").alias("at"), F.col("digest").alias("is"))
    return said.join(wrong, same("by", "wrong") & (F.col("position") == F.col("at")) & (F.col("digest") == F.col("is"))).select("of", "by").distinct()


def collapse(log: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """Rendered maximal conversations: conv_id, segment, n_turns, n_logs, first_turn, turns, rendered.

    A logged conversation that is a prefix of a longer one goes; of equal ones the smallest id stays and ``n_logs``
    says how many there were. Hashes of prefixes only say which conversation may replace another: it does if each of
    the other's turns is equal, by SHA-256, to its own at that position, and a conversation of which that isn't so stays. A row holds up to ``segment`` turns, in order, each as ``<|role|>``, its text and a line
    end; long conversations have several rows.

    Turns are ordered by turn number (null first), then role and text; rows repeated whole are one turn. A null id is
    a conversation, the largest one. A null role or text renders as '' but isn't equal to ''. Other columns are not
    read. An empty table gives an empty table.
    """
    turns = cut(positions(log, conv_id=conv_id, turn=turn, role=role, text=text), "chat-turns")
    claimed = cut(claims(cut(prefix_hashes(turns), "chat-hashes")), "chat-claims")
    own = F.col("conv").eqNullSafe(F.col("by"))
    wrong = cut(refuted(turns, claimed.where(~own)), "chat-refuted")
    judged = claimed.join(wrong.select("of", F.lit(True).alias("wrong")), same("conv", "of"), "left").withColumn("stays", own | F.coalesce("wrong", F.lit(False)))
    logs = judged.where("not continued and wrong is null").groupBy(F.col("by").alias("head")).agg(F.count("*").alias("logs"))
    maximal = judged.where("stays").select("conv", "wrong").join(logs, same("conv", "head"), "left").select(F.col("conv").alias("kept"), F.when(F.col("wrong"), 1).otherwise(F.col("logs")).cast("long").alias("n_logs"))
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    return (
        turns.join(maximal, same("conv", "kept"))
        .select(F.col("conv").alias("conv_id"), F.floor((F.col("position") - 1) / segment).alias("segment"), "n_turns", "n_logs", "position", line.alias("line"))
        .groupBy("conv_id", "segment")
        .agg(F.first("n_turns").alias("n_turns"), F.first("n_logs").alias("n_logs"), F.min("position").alias("first_turn"), F.count("*").alias("turns"), F.sort_array(F.collect_list(F.struct("position", "line"))).alias("lines"))
        .select("conv_id", "segment", "n_turns", "n_logs", "first_turn", "turns", F.array_join("lines.line", "").alias("rendered"))
    )
