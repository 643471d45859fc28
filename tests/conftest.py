from __future__ import annotations

import os

import pytest

from textloom.session import local_session, ship_package

SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, partitions=4, app="tests", **{"spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("OFF")
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables")
    return SMALL


@pytest.fixture(scope="session")
def middle():
    if not os.path.isdir(MIDDLE):
        pytest.skip("no test tables")
    return MIDDLE
