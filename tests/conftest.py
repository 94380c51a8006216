import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

# Python workers import the package wherever pytest was started
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from small_data import SF_SMALL  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from quantloom.session import build_session
    s = build_session("local[*]", 8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    from oracle import duck as make
    return make(SF_SMALL)
