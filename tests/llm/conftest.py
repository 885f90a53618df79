import pytest
from odd_rows import ODD
from pyspark.sql import functions as F

@pytest.fixture(scope="session")
def docs(spark):
    """Make documents from (doc_id, text) pairs, with extra columns whose names operators use inside."""

    def make(pairs, **more):
        rows = [(i, t, "en", f"s{(i or 0) % 2}", len(t or ""), 1, "x", 2, 3, 4) for i, t in pairs]
        names = "doc_id long, text string, lang string, source string, n_chars long, row long, line_row string, pos long, kept long, score long"
        return spark.createDataFrame(rows, names).withColumns({k: F.lit(v) for k, v in more.items()}).repartition(3)

    return make


@pytest.fixture(scope="session")
def odd(docs):
    return docs(ODD)
