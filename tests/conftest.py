import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from scholium.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session("4", 4, "tests")
    session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    yield session
    session.stop()
