import pytest

from sitefold.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        **{"spark.master": "local[4]", "spark.sql.shuffle.partitions": "4"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Value of an expression over the row (s)."""

    def run(expression, s=None):
        frame = spark.createDataFrame([(s,)], "s string").repartition(1)
        return frame.select(expression.alias("v")).first()["v"]

    return run
