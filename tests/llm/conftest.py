import pytest

from gazette.session import table

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small(spark):
    return lambda name: table(spark, SMALL, name)


@pytest.fixture(scope="session")
def frame(spark):
    """A frame of rows; columns that an operator does not read can be added with names of its own inner columns."""

    def make(rows, schema):
        return spark.createDataFrame(rows, schema).coalesce(2)

    return make
