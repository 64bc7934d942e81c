import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from savanto.session import discard, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    return local_session("tests", folder=str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="module", autouse=True)
def stored_tables(spark):
    """What a module stores goes with it."""
    yield
    discard(spark)
