import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyboard.session import report_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = report_session(
        "tests",
        **{
            "spark.master": "local[8]",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            # Many small plans: quick compilation beats fast code here.
            "spark.driver.extraJavaOptions": "-XX:TieredStopAtLevel=1",
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    def make(rows, schema):
        return spark.createDataFrame(rows, schema)

    return make


def values(df, *columns):
    """Rows as tuples, in the order of the query."""
    names = columns or df.columns
    return [tuple(row[name] for name in names) for row in df.collect()]
