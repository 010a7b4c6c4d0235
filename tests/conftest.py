import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from lectern.session import build_session

    session = build_session(
        "tests",
        f"local[{os.environ.get('LECTERN_TEST_CORES', '8')}]",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="8g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def root():
    return os.environ.get("LECTERN_TEST_DIR", "/root/testdata/sf0.001")


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="lectern-test-")
