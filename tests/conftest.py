import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from scholion.session import local_session

    return local_session("4", 4, "4g")


@pytest.fixture
def rows():
    """Sorted rows of a frame, as tuples."""

    def get(df):
        return sorted((tuple(r) for r in df.collect()), key=repr)

    return get
