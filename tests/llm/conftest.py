import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent), str(Path(__file__).resolve().parent.parent)]


@pytest.fixture(scope="session")
def docs(spark):
    from brute import SCHEMA, rows, texts

    return spark.createDataFrame(rows(texts()), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    from brute import SCHEMA

    return spark.createDataFrame([], SCHEMA)
