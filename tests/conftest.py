import sys

import pytest

sys.path.insert(0, "/root/repo")


@pytest.fixture(scope="session")
def spark():
    from scrubspark.session import get_spark

    s = get_spark(master="local[4]", shuffle_partitions=4)
    yield s
