import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from flowlake.session import build_local  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return build_local("4", 4, "flowlake-tests")


@pytest.fixture(scope="session")
def sf_dir():
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test data")
    return path
