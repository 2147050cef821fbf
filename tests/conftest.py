import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tarn.session import get_session

    session = get_session("tests", "local[4]", spark__sql__shuffle__partitions="8", spark__driver__memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir("file://" + str(tmp_path_factory.mktemp("checkpoint")))
    yield session
    session.stop()
