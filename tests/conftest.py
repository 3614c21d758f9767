"""One small session for all tests."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from weftline.session import local_session

    s = local_session(4, "tests", spark__sql__shuffle__partitions="4", spark__driver__memory="3g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    if not DATA.exists():
        pytest.skip("no test tables here")
    return str(DATA)
