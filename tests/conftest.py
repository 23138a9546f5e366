import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from duelframe.session import build_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", 4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def rows(df, *order):
    """Plain tuples of a small result in a stable order."""
    names = sorted(df.columns)
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def same(a, b, places=9):
    """Two results are equal up to float noise, row order and column order."""
    assert sorted(a.columns) == sorted(b.columns)

    def norm(df):
        names = sorted(df.columns)
        out = []
        for r in df.collect():
            out.append(tuple(round(r[n], places) + 0.0 if isinstance(r[n], float) else r[n] for n in names))
        return sorted(out, key=repr)

    left, right = norm(a), norm(b)
    assert len(left) == len(right)
    assert left == right
