import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tidemill.session import build_session, prepare  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = prepare(build_session(8, shuffle_partitions=4, memory="4g"))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
