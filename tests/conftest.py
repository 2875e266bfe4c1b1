import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from vacantry.session import clean_work, local_session

    session = local_session("4", memory="4g", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    clean_work(session)
    session.stop()
