import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panelrisk.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4, memory="4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows(spark):
    """Rows of a frame as a set of tuples in column order."""
    return lambda df, *cols: {tuple(r) for r in df.select(*(cols or df.columns)).collect()}
