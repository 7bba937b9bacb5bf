"""Leave one group out: all rows of the others train, every row is scored."""

import numpy as np
import pytest

from limen.plans import more


def plain_logistic(x, y, l2=1.0, steps=50):
    z = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(z.shape[1]), l2 * np.diag([0.0] + [1.0] * x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(z @ w)))
        w = w + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
    return w


def test_every_row_is_scored(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2))
    y = (rng.random(300) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(int)
    rows = [(i, "abc"[i % 3], int(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(300)] + [(300, "a", 1, None, 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, quality int, x0 double, x1 double").repartition(3)
    found = {r.doc_id: r for r in more._left_out(df).collect()}
    assert sorted(found) == list(range(301)) and found[300].p is None
    whole = {i: r.p for i, r in found.items()}
    for lang in "abc":
        train = [r for r in rows[:300] if r[1] != lang]
        z = np.array([r[3:] for r in train])
        m, s = z.mean(axis=0), z.std(axis=0, ddof=1)
        w = plain_logistic((z - m) / s, np.array([r[2] for r in train], float))
        for r in rows[:300]:
            if r[1] == lang:
                p = 1 / (1 + np.exp(-(w[0] + (np.array(r[3:]) - m) / s @ w[1:])))
                assert (whole[r[0]], found[r[0]].y, found[r[0]].lang) == (pytest.approx(p, abs=2e-6), r[2], lang)
