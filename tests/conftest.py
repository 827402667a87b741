from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tanzaku.session import local_session
    from tanzaku.shipping import ship

    s = local_session(4, "tests", shuffle_partitions=4)
    ship(s)
    yield s
    s.stop()
