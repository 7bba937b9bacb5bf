"""Rank sums over ranges against ranks of all rows at once."""

import math

import pytest

from limen.operators import tests as T


def plain(rows):
    values = sorted(v for v, _ in rows)
    rank = {v: values.index(v) + (values.count(v) + 1) / 2 for v in set(values)}
    n1 = sum(f for _, f in rows)
    return sum(rank[v] for v, f in rows if f) - n1 * (n1 + 1) / 2, n1, len(rows) - n1


@pytest.mark.parametrize("values", [range(700), [i % 3 for i in range(300)], [5] * 40, [1.5, 1.5, 2.0]])
def test_auroc_and_u(spark, values):
    rows = [(float(v), (i * i + int(v)) % 5 < 2) for i, v in enumerate(values)]
    u, n1, n0 = plain(rows)
    df = spark.createDataFrame([(v, int(f), "x") for v, f in rows], "v double, y int, all string")
    a = T.auroc(df, "y", "v", "all").first()
    assert (a.n1, a.n0) == (n1, n0) and math.isclose(a.auroc, u / (n1 * n0))
    g = df.selectExpr("v", "if(y = 1, 'f', 'o') AS g", "all")
    r = T.rank_sum(g, "v", "g", "f", "all").first()
    assert r.u == u and (r.z is None) == (len(set(values)) == 1)


def test_groups_nulls_and_empty(spark):
    df = spark.createDataFrame([(1.0, 1, None), (2.0, 0, None), (None, 1, "b"), (3.0, 0, "b"), (3.0, 1, "b")], "v double, y int, k string")
    got = {r.k: (r.n1, r.n0, r.auroc) for r in T.auroc(df, "y", "v", "k").collect()}
    assert got == {None: (1, 1, 0.0), "b": (2, 1, 0.25)}
    assert T.auroc(df.limit(0), "y", "v", "k").count() == 0
