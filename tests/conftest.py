import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))


@pytest.fixture(scope="session")
def spark():
    from shelfwork.session import local_session

    session = local_session("*", shuffle_partitions=8, app="tests")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()
