from __future__ import annotations

import pytest

#: Columns that operators use inside, as extra columns of an input.
CLASHES = ("bucket", "payload", "cover", "_id", "unit", "split", "n", "n_tokens", "score", "cluster", "component_id", "items", "rank", "text_key", "label", "ids")


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, clashing extra columns."""
    from pyspark.sql import functions as F

    rows = [(1, "the cat sat. " * 4), (1, "the cat sat. " * 4), (2, None), (3, ""), (None, "a b c"), (None, None), (4, "x" * 40_000), (5, "wörd　é \t\n" * 3000), (6, " \n\t "), (7, "the cat sat. " * 4), (8, "😀 token = \"abcdefgh1\" a.b@c.de +49 30 1234567")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(None).cast("string") for c in CLASHES})
    return df.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")}).repartition(3).cache()


@pytest.fixture(scope="session")
def empty_docs(spark, edge_docs):
    return spark.createDataFrame([], edge_docs.schema)


@pytest.fixture(scope="session")
def small(spark):
    """Documents of the smallest driver tables."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3).cache()
