import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from helpers import corpus, frame  # noqa: E402


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark):
    return frame(spark).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
