import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from frames import SAMPLE_COLS, SNAP_COLS, frame  # noqa: E402

from vacfleet.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, shuffle_partitions=8, app="vacfleet-tests")
    yield s


@pytest.fixture
def samples_df(spark):
    return lambda rows: frame(spark, SAMPLE_COLS, rows)


@pytest.fixture
def snaps_df(spark):
    return lambda rows: frame(spark, SNAP_COLS, rows)
