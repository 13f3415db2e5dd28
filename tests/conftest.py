import pytest

from eventfold.session import local_session

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tiny():
    return f"{DATA}/sf0.001"
