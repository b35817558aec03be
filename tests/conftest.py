import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from fathom.session import local_session
    s = local_session("*", 8, app="fathom-tests")
    yield s
    s.stop()
