import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fathom.session import get_spark, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_spark("4", 4, "3g")
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    session.stop()
