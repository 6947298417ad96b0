from __future__ import annotations

import pytest

from surveyspan.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "surveyspan-tests", "4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return "/root/testdata/sf0.001"
