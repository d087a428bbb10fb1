from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    from swathline.session import build_session

    session = build_session("local[8]", "tests", spark__sql__shuffle__partitions="4")
    yield session
    session.stop()
