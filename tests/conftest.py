import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from weftline.session import build_session

    shared = tmp_path_factory.mktemp("shared")
    session = build_session(4, "tests", spark__driver__memory="4g", spark__checkpoint__dir=f"file://{shared}", spark__sql__warehouse__dir=f"{shared}/warehouse")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
