"""One local session for all tests."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from placewright.session import build_session

    session = build_session("tests", spark__sql__shuffle__partitions="8", spark__driver__memory="6g")
    yield session
    session.stop()
