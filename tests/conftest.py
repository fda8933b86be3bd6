import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from cohort_spark.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", spark__sql__shuffle__partitions=4,
                            spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    def make(rows, schema):
        return spark.createDataFrame(rows, schema)
    return make


def values(df, *cols):
    """Rows as a sorted list of tuples, missing values last."""
    rows = [tuple(row[c] for c in (cols or df.columns)) for row in df.collect()]
    return sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])
