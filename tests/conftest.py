import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.path.dirname(os.path.dirname(os.path.abspath(__file__))) + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from tessera.session import local_session

    s = local_session("tests", cores="4", memory="4g")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s
    s.stop()
