import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from docweave.session import build_session

    session = build_session(
        "tests",
        spark__master="local[4]",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="6g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluates a Column over a single row of given string columns."""

    def run(column, **values):
        schema = ", ".join(f"{name} string" for name in values) or "nothing string"
        row = tuple(values.values()) or (None,)
        return spark.createDataFrame([row], schema).select(column.alias("out")).first()["out"]

    return run
