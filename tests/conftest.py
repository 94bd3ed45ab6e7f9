import pytest

from tagweave.session import get_spark


@pytest.fixture(scope="session")
def spark():
    session = get_spark(8, 8, "6g")
    yield session
    session.stop()
