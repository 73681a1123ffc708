import pytest

from ownerlens.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("4", shuffle_partitions=4, app="tests")


@pytest.fixture
def value(spark):
    """Evaluate an expression over one row per argument."""

    def run(fn, rows, schema):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
        return [r["v"] for r in df.select("i", fn.alias("v")).orderBy("i").collect()]

    return run
