import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from hourcast.session import get_session, checkpoint_dir
    s = get_session("local[4]", app="hourcast-tests", shuffle_partitions=8)
    s.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(s)  # tests only: a private scratch dir when none is configured
    yield s


@pytest.fixture
def tmpdir_path():
    return tempfile.mkdtemp(prefix="hourcast-test-")
