import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from sitelens.session import ensure_checkpoint_dir, get_session
    s = get_session("local[4]", app="sitelens-tests", shuffle_partitions=8,
                    extra={"spark.driver.memory": "6g"})
    ensure_checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="sitelens-test-")
