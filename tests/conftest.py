import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from grainmill.session import local_session

    s = local_session(4, 4)
    yield s
    s.stop()


def rows(df, *columns):
    """Sorted tuples of a frame."""
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


@pytest.fixture(scope="session")
def got():
    return rows
