import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lodestone.session import guard_unions, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "tests", 4)
    session.sparkContext.setLogLevel("ERROR")
    guard_unions(session)
    yield session
    session.stop()
