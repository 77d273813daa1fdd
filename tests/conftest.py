import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pagesieve.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, partitions=4, app="tests")


@pytest.fixture(scope="session")
def value(spark):
    """Evaluate one Column on one row."""

    def run(column):
        row = spark.range(1).select(column.alias("v")).first()
        return row["v"]

    return run
