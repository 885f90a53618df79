"""Mixing sources to target weights by repeating documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, word_count

WEIGHTS = (3, 1, 2)
#: Steps in which the limit of a draw is set.
DRAW_STEPS = 4096


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Target and repetition rate of each source, from (source, source_size): one row per source.

    Sources in code-point order, null last, take the weights in turn and share ``budget`` times all words. A target
    stops at ``cap`` times its source; sources are filled in the order in which they reach their caps, which gives the
    fixed point of resharing the excess by weight. The windows run over one row per source.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    n = F.row_number().over(every) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (n % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * cap)
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fill = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    before = ranked.select(
        "*",
        (F.sum("source_size").over(all_rows) * budget).alias("words"),
        F.sum("weight").over(all_rows).alias("all_weight"),
        F.coalesce(F.sum("most").over(fill), F.lit(0.0)).alias("given"),
        F.coalesce(F.sum("weight").over(fill), F.lit(0)).alias("used"),
    )
    capped = before.withColumn("full", F.col("most") * (F.col("all_weight") - F.col("used")) <= (F.col("words") - F.col("given")) * F.col("weight"))
    left = capped.select(
        "*",
        (F.col("words") - F.sum(F.when(F.col("full"), F.col("most")).otherwise(0.0)).over(all_rows)).alias("rest"),
        (F.col("all_weight") - F.sum(F.when(F.col("full"), F.col("weight")).otherwise(0)).over(all_rows)).alias("rest_weight"),
    )
    target = F.when(F.col("full"), F.col("most")).otherwise(F.col("rest") * F.col("weight") / F.col("rest_weight"))
    rate = F.when(F.col("source_size") == 0, 0.0).otherwise(F.col("target") / F.col("source_size"))
    return left.withColumn("target", target).select("source", "source_size", "target", rate.alias("rate"))


def draw_of(seed: str, doc_id: Column, text: Column) -> Column:
    """The step, of DRAW_STEPS, on which a document's draw falls: hashed from the seed and its id, from its text without one."""
    return F.floor(unit_hash(F.lit(seed), F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit(""))))) * DRAW_STEPS).cast("int")


def thresholds(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` with the step under which a draw wins: the one at which a source's drawn words come nearest to its fraction.

    ``drawn`` has the words of each source and step, so a source has DRAW_STEPS rows at most, however many documents.
    """
    so_far = Window.partitionBy("source").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wanted = (F.col("rate") - F.floor("rate")) * F.col("source_size")
    ends = (
        drawn.withColumn("won", F.sum("words").over(so_far))
        .withColumnRenamed("source", "of")
        .join(targets, F.col("of").eqNullSafe(F.col("source")))
        .groupBy("source", "source_size", "target", "rate")
        .agg(F.min(F.struct(F.abs(F.col("won") - wanted).alias("miss"), (F.col("step") + 1).alias("limit"))).alias("end"))
    )
    nothing = F.struct(wanted.alias("miss"), F.lit(0).alias("limit"))
    return ends.select("source", "source_size", "target", "rate", F.least("end", nothing)["limit"].alias("limit"))


def mix_sources(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, budget: float = 1.5, cap: float = 2.0
) -> DataFrame:
    """Each document with ``size``, ``source_size``, ``target``, ``rate`` and ``copies`` (columns of these names are replaced).

    A document is taken floor(rate) times, and once more if its draw, hashed from the seed and its id, is under the
    fraction that is left. Sizes are heavy-tailed, so draws under the bare fraction would miss the target of a small
    source by a third of it; the limit that draws are held against is therefore the fraction as measured in words: the
    step of the hash at which the words drawn so far come nearest to the fraction of the source's words. It tends to
    the fraction as sources grow, and a source misses its target by half a document or half a step's words.

    Null text has size 0. A null source is a source, the last one. Sources without words have target 0 and no copies;
    an empty table gives an empty table. Rows of one id are counted on their own and drawn alike; rows without an id are
    drawn by their text. Reruns agree. Nothing but the sums of each source and step is shuffled.
    """
    size, step = word_count(F.col(text)), draw_of(seed, F.col(doc_id), F.col(text))
    drawn = docs.select(F.col(source).cast("string").alias("source"), size.alias("size"), step.alias("step")).groupBy("source", "step").agg(F.sum("size").alias("words"))
    drawn = cut(drawn, "mix-drawn")
    targets = source_targets(drawn.groupBy("source").agg(F.sum("words").alias("source_size")), weights, budget, cap)
    # A table, so that Spark knows its size when it chooses the join: broadcast under its threshold, sorted beyond.
    limits = cut(thresholds(drawn, targets), "mix-limits")
    keep = docs.drop("size", "source_size", "target", "rate", "copies")
    of, limit = fresh(keep, "mix_of"), fresh(keep, "mix_limit")
    limits = limits.withColumnsRenamed({"source": of, "limit": limit})
    extra = (step < F.col(limit)).cast("long")
    return (
        keep.join(limits, F.col(source).cast("string").eqNullSafe(F.col(of)))
        .withColumns({"size": size, "copies": F.floor("rate").cast("long") + extra})
        .select(*[F.col(f"`{c}`") for c in keep.columns], "size", "source_size", "target", "rate", "copies")
    )


def emit_copies(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each document as often as ``copies`` says."""
    copy = fresh(mixed, "copy")
    names = [F.col(f"`{c}`") for c in columns]
    return mixed.where(F.col("copies") > 0).select(*names, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(copy)).select(*names)
