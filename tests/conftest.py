import pytest

from tessera.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(cpus=4, app="tests", **{"spark__sql__shuffle__partitions": "4"})
    yield s
    s.stop()
