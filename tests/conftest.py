import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from tidemill.session import local_session

    session = local_session("tests", cores="4", shuffle=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables():
    """The smallest test tables, if they are there."""
    folder = "/root/testdata/sf0.001"
    if not Path(folder).exists():
        pytest.skip("no test tables")
    return folder
