import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from affinis.session import local_session
    s = local_session("*", 8, app="affinis-tests",
                      checkpoint=tempfile.mkdtemp(prefix="affinis-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="affinis-test-")


def rows(df, *cols):
    """Sorted list of tuples (optionally of selected columns)."""
    d = df.select(*cols) if cols else df
    return sorted(tuple(r) for r in d.collect())
