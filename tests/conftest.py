import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from paraspark.session import build_session
    ckpt = tempfile.mkdtemp(prefix="paraspark-test-ckpt-")
    s = build_session(master="local[*]", shuffle_partitions=8, extra={"spark.checkpoint.dir": ckpt})
    yield s


@pytest.fixture(scope="session")
def sf_small():
    return SF_SMALL
