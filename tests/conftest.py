import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from fieldloom.session import local_session
    return local_session(8, "6g", partitions=4)


@pytest.fixture(scope="session")
def sf_dir():
    """The smallest of the given tables."""
    return SF_DIR


@pytest.fixture
def small_chunks(monkeypatch):
    """Chunks of eight weeks, so that even short series cross chunk borders."""
    from fieldloom.operators import splits
    monkeypatch.setattr(splits, "CHUNK_WEEKS", 8)
