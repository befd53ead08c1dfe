import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_fixtures import EXTRA, SCHEMA, edge_rows, prose  # noqa: E402


@pytest.fixture(scope="session")
def edge_docs(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(edge_rows(), SCHEMA).repartition(3, "n_chars")
    return docs.select("*", *[F.lit(f"own {c}").alias(c) for c in EXTRA])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def some_docs(spark):
    """A few dozen texts with copies, for comparisons with brute force."""
    rows = []
    for k in range(60):
        text = prose(k % 40, 30 + 7 * (k % 23))
        if k % 9 == 0:
            text = text.replace("alpha", "beta", 1) + "\nsame line here\nsame line here"
        if k % 13 == 0:
            text = "&&& ".join(text.split())
        rows.append((k, text, ["en", "de"][k % 2], f"s{k % 4}" if k % 5 else None, len(text)))
    return spark.createDataFrame(rows, SCHEMA).repartition(4)
