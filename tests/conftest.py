import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))
sys.path.insert(0, HERE)


@pytest.fixture(scope="session")
def spark():
    from check import session

    s = session(8, 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
