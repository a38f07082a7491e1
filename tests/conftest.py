import pytest

from tagloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "tagloom-tests")
    yield session
    session.stop()
