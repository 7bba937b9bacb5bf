"""Every catalogue query against its SQL at the smallest scale, whatever the partitioning."""

import math
import os

import duckdb
import pytest

from limen.plans import added, matrices, models, more, rest  # noqa: F401  register their queries
from limen.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def same(a, b):
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float) or isinstance(b, float):
        return math.isclose(float(a), float(b), rel_tol=1e-9, abs_tol=2e-6)
    return a == b


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    mine = [tuple(r[c] for c in cols) for r in got.collect()]
    rel = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({ORACLES[name]})")
    theirs = rel.fetchall()
    assert len(mine) == len(theirs)
    key = lambda r: tuple((x is None, round(x, 4) if isinstance(x, float) else x if not isinstance(x, bool) else int(x)) for x in r)
    for a, b in zip(sorted(mine, key=lambda r: str(key(r))), sorted(theirs, key=lambda r: str(key(r)))):
        assert all(same(x, y) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_repeats_itself(spark, name):
    once, again = ([tuple(r) for r in QUERIES[name](spark, SF).collect()] for _ in range(2))
    assert sorted(map(str, once)) == sorted(map(str, again))
