"""Tables in the shared folder go once they aren't needed."""

from pathlib import Path

import pytest

import corpus_pipeline
from tidewick.llm import common


def folder(spark):
    return Path(f"{common.shared_dir(spark)}/tidewick/{spark.sparkContext.applicationId}".removeprefix("file://"))


def test_scratch_goes_and_results_stay(spark):
    path = common.new_path(spark, "result")
    with common.scratch(spark):
        made = common.cut(spark.range(3), "inner")
        with pytest.raises(ZeroDivisionError), common.scratch(spark):
            inner = Path(common.cut(made, "innermost").inputFiles()[0].removeprefix("file://")).parent
            assert inner.exists() and 1 // 0
        assert not inner.exists()
        made.write.parquet(path)
    assert not list(folder(spark).glob("scratch-*")) and spark.read.parquet(path).count() == 3


def test_pipeline_leaves_its_stages_only(spark, data):
    before = set(folder(spark).glob("*"))
    assert corpus_pipeline.run(spark, data).count() > 0
    left = [p.name for p in set(folder(spark).glob("*")) - before]
    assert len(left) == 5 and all(n.startswith("pipeline-") for n in left)
