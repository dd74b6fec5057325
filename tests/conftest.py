import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from platewise.session import build_session

    s = build_session("local[*]", shuffle_partitions=8)
    yield s


@pytest.fixture(scope="session")
def sf001():
    return "/root/testdata/sf0.001"
