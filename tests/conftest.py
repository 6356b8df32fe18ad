import pytest

from veritrace.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=8, app="tests", memory="8g")
    yield session
    session.stop()
