import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from codelode.session import local_session

    session = local_session(2, shuffle_partitions="2")
    yield session
    session.stop()
