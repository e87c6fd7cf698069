"""Shares the session fixture of the other tests."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from vacfleet.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    yield local_session(4, shuffle_partitions=8, app="vacfleet-tests")
