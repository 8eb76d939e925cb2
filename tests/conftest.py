from __future__ import annotations

import os

import pytest

from seqloom.session import build_session

os.environ.setdefault("TZ", "UTC")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return build_session("4", 4, app="tests")


@pytest.fixture(scope="session")
def data() -> str:
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    return DATA
