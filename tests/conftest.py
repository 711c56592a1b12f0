import pytest

from seqloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, partitions=4, name="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
