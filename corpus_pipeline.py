"""From raw documents to packed training sequences: five stages, each one operator over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns of ``documents``.
``run`` writes each result as Parquet in the shared folder and reads it back, so that a lost executor costs tasks of
one stage only; what a stage itself has stored is deleted then.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewick.llm import lines, mixing, near, packing, toxicity
from tidewick.llm.common import new_path, scratch


#: What stages read or change; operators add no columns of these names.
READ = ("doc_id", "text", "source", "n_chars")
#: The struct that holds all other columns while operators add theirs, so that none of them is replaced.
OTHERS = "other_columns"


def packed(docs: DataFrame) -> DataFrame:
    others = [F.col(f"`{c}`") for c in docs.columns if c not in READ]
    return docs.select(*READ, (F.struct(*others) if others else F.lit(None)).alias(OTHERS))


def unpacked(found: DataFrame, columns: list[str]) -> DataFrame:
    return found.select(*[F.col(c) if c in READ else F.col(f"{OTHERS}.`{c}`") for c in columns])


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches 0.7 go; the lexicon is learned from the labelled rows of ``docs``."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return unpacked(toxicity.score(packed(docs), model).where("predicted = 0"), docs.columns)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that other documents hold go from the texts; every document stays, ``n_chars`` follows its text."""
    shorter = lines.dedup_lines(packed(docs))
    changed = F.col("n_dropped") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    n_chars = F.when(changed, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return unpacked(shorter.withColumns({"text": text, "n_chars": n_chars}), docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, that with the smallest id."""
    return unpacked(near.dedup_near(packed(docs)).where("kept"), docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources come near their targets."""
    mixed = mixing.mix_sources(packed(docs))
    return unpacked(mixing.emit_copies(mixed, mixed.columns), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 ids."""
    return packing.pack(docs, tokenizer=public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_common_lines),
    ("near dedup", keep_one_of_near_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL can't express the learned lexicon, the signatures or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, "pipeline-" + name.replace(" ", "-"))
        with scratch(spark):
            found = stage(spark, docs, sf_dir)
            found.write.parquet(path)
        docs = spark.read.schema(found.schema).parquet(path)
    return docs
