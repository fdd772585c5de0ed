import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from lodestone.session import local_session, ship  # noqa: E402

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
