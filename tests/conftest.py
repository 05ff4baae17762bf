import pytest

from reqloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", cores=4, partitions=4, memory="4g")
    yield s
    s.stop()
