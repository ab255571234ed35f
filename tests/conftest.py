import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from respondo.session import local_session
    s = local_session(cores="*", shuffle_partitions=8, app="respondo-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s


SF_SMALL = os.environ.get("RESPONDO_TEST_SF", "/root/testdata/sf0.001")
