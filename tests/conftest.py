import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from readwindows.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8, 8)
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("staged")))
    yield session
    session.stop()
