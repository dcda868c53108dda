import os

import pytest

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def small():
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables")
    return SMALL


@pytest.fixture
def docs(spark):
    """A helper that makes (doc_id, text) rows with extra columns whose names clash with the operators' own."""

    def make(rows, **more):
        data = [(i, t, "en", "s", "x", "y", "z") for i, t in rows]
        return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, _hash string, doc string, n string")

    return make
