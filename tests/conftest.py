import datetime as dt
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from retentia.context import local_session

    s = local_session("*", app="retentia-tests", shuffle_partitions=8)
    yield s
    s.stop()


def T(s: str) -> dt.datetime:
    """Naive UTC timestamp from 'YYYY-mm-dd HH:MM:SS[.ffffff]'."""
    return dt.datetime.fromisoformat(s)
