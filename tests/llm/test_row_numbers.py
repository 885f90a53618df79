"""Row numbers stay what they are when later scans of the input are split in another way."""

import random

import pytest

from tidewick.llm import common, exact, mixing, near, substrings

SPLITS = "spark.sql.files.minPartitionNum"


@pytest.fixture
def files(spark, tmp_path):
    """Documents in eight files, which one task reads together or eight tasks one by one."""
    r = random.Random(4)
    rows = [(k, " ".join(f"w{r.randrange(40)}" for _ in range(60)) if k % 3 else "the same words in each third text " * 9, f"s{k % 2}") for k in range(160)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(8).write.parquet(path)
    yield spark.read.parquet(path)
    spark.conf.unset(SPLITS)


def split(spark, n):
    spark.conf.set(SPLITS, str(n))


def test_numbers_are_stored(spark, files):
    split(spark, 1)
    whole = common.numbered(files, "n")
    before = {r.doc_id: r.n for r in whole.collect()}
    split(spark, 64)
    assert {r.doc_id: r.n for r in common.numbered(files, "n").collect()} != before
    assert {r.doc_id: r.n for r in whole.select("doc_id", "n").collect()} == before and len(set(before.values())) == 160


@pytest.mark.parametrize("operator", [exact.dedup_exact, mixing.mix_sources, substrings.dedup_substrings, near.dedup_near])
def test_no_row_is_lost(spark, files, operator):
    split(spark, 64)
    want = sorted(map(str, operator(files).collect()))
    split(spark, 1)
    found = operator(files)
    split(spark, 64)
    assert sorted(map(str, found.collect())) == want and len(want) == 160
