import tempfile

import pytest

from packetloom.session import local_session, release

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", 8, **{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="packetloom-test-")})
    yield session
    release(session)
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def medium():
    return MEDIUM
