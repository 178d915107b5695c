import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from graphloom.sources.tables import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)
