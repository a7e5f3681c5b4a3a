import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from segmint.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", app_name="segmint-tests", shuffle_partitions=4)
    if not s.sparkContext.getCheckpointDir():
        # tests only: the cluster would name the shared folder
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="segmint-test-"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_small():
    return "/root/testdata/sf0.001"
