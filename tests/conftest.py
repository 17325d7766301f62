import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from loomcite.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, partitions=4, memory="4g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session


@pytest.fixture
def one(spark):
    """Value of a column expression."""

    def value(column):
        return spark.range(1).select(column.alias("v")).first()["v"]

    return value
