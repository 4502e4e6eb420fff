import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from matchloom.session import local_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    shared = f"file://{tempfile.mkdtemp(prefix='matchloom-tests-')}"
    session = local_session(
        "tests",
        "4",
        **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "8g", "spark.checkpoint.dir": shared},
    )
    ship_package(session)
    yield session
    session.stop()
