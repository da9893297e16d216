from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from millrace.session import build_local, configure_streaming  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_local(cores=8, shuffle_partitions=4, memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    configure_streaming(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables():
    return "/root/testdata/sf0.001"
