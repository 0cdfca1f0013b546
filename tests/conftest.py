import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from flipside.session import build_session, checkpoint_dir
    s = build_session("*", 8)
    checkpoint_dir(s, tempfile.mkdtemp(prefix="flipside-test-chk-"))
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="flipside-test-")
