"""Tables for the tests of the text operators."""

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


LONG = "word " * 30_000 + "x" * 50_000
ODD = [
    (1, None, None),
    (2, "", "a"),
    (2, "", "a"),
    (None, "some words without an id", None),
    (3, LONG, "b"),
    (4, " \n\t\n", "b"),
    (5, "Élan «vital» \U0001f642 ﬁn", "c"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, clashing extra columns."""
    rows = spark.createDataFrame(ODD, "doc_id long, text string, source string")
    clash = ["id", "fp", "__x", "kept", "score", "spans", "word", "line", "a.b", "token", "host", "shard", "number", "slot"]
    for name in clash:
        rows = rows.withColumn(name, F.lit(None).cast("string"))
    return rows.withColumn("lang", F.lit("xx"))


@pytest.fixture(scope="session")
def no_rows(odd):
    return odd.limit(0)
