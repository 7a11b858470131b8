import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from plumbline.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(8, "tests", {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m"})  # small tables
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
