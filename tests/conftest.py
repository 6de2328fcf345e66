import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from peregrin.session import get_session

    session = get_session("4", 4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    return session
