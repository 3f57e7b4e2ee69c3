from __future__ import annotations

import pytest

from lumencat.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests", "12g")
    yield session
    session.stop()
