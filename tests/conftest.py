import os
import sys
import tempfile
from datetime import date

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from factorloom.session import MAX_GROUP_ROWS_KEY, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", "4", 4)
    session.sparkContext.setLogLevel("ERROR")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="factorloom-"))
    return session


@pytest.fixture
def sliced(spark):
    """Make every group larger than four rows take the sliced path."""
    spark.conf.set(MAX_GROUP_ROWS_KEY, "4")
    yield
    spark.conf.unset(MAX_GROUP_ROWS_KEY)


def day(n: int, start: date = date(2024, 1, 1)) -> date:
    return date.fromordinal(start.toordinal() + n)
