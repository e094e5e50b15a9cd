import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from wardline.session import builder

    s = builder(master="local[4]", shuffle_partitions=8).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
