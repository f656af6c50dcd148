import pytest

from loomstone.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", cores=4, shuffle_partitions=4)
