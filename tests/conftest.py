from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tapeloom.session import local_session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", "6g", **{"spark.sql.shuffle.partitions": "4"})
    ship(s)
    yield s
    s.stop()
