import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from phasemill.session import local_session

    s = local_session("8", 4, "8g")
    yield s
    s.stop()
