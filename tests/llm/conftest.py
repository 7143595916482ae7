import os

import pytest


@pytest.fixture(scope="session")
def large():
    """The largest test tables, for what a classifier finds."""
    return f"{os.environ.get('TEST_DATA', '/root/testdata')}/sf0.1"
