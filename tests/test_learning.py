"""Fits over all rows against a plain solver, ratios of domains, weighted thresholds, order over ranges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from limen.operators import cohorts as H
from limen.operators import learning as G
from limen.operators import tests as T
from limen.operators.ranges import dealt, previous, running_total


def solved(x, y, ridge):
    z = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(z.shape[1]), ridge * np.diag([0.0] + [1.0] * x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-(z @ w)))
        w = w + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
    return w


def table(spark, seed=0, n=900, d=4, groups="abc"):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * [1, 10, 0.1, 1][:d] + [0, 1000, 0, -5][:d]
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] - 0.1 * (x[:, 1] - 1000))))).astype(int)
    g = [groups[i % len(groups)] for i in range(n)]
    df = spark.createDataFrame([(i, g[i], int(y[i]), *map(float, x[i])) for i in range(n)], ["id", "grp", "y", *[f"f{k}" for k in range(d)]]).repartition(4)
    return df, x, y, np.array([v or "" for v in g])


@pytest.mark.parametrize("leave_out", [False, True])
def test_weights_equal_a_plain_solver(spark, leave_out):
    df, x, y, g = table(spark, groups=["a", "b", None])
    fits = G.fit_logistic(df, ["f0", "f1", "f2", "f3"], "y", "grp", leave_out=leave_out, ridge=0.5)
    assert {f.group for f in fits} == {"a", "b", None}
    for f in fits:
        rows = (g == (f.group or "")) != leave_out
        m, s = x[rows].mean(axis=0), x[rows].std(axis=0, ddof=1)
        assert f.rows == rows.sum()
        assert f.weights == pytest.approx(solved((x[rows] - m) / s, y[rows], 0.5), abs=1e-6)
        assert f.steps < 20


def test_separable_constant_and_one_class(spark):
    rows = [(i, float(i), 1.0, int(i >= 20), 1) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int, one int")
    [f] = G.fit_logistic(df, ["a", "b"], "y", ridge=1.0)
    a = np.array([r[1] for r in rows])
    z = np.column_stack([(a - a.mean()) / a.std(ddof=1), np.zeros(40)])
    assert f.weights == pytest.approx(solved(z, np.array([r[3] for r in rows]), 1.0), abs=1e-6)
    [none] = G.fit_logistic(df, ["a", "b"], "one")
    assert none.weights is None
    assert {r.p for r in G.score_logistic(df, [none], ["a", "b"]).collect()} == {None}
    assert G.fit_logistic(df.limit(0), ["a"], "y")[0].weights is None


def test_domain_ratio(spark):
    df, x, _, g = table(spark, 1, d=2, groups="st")
    df = df.withColumn("f0", F.col("f0") + F.when(F.col("grp") == "t", 1.5).otherwise(0.0))
    x = x + np.outer(g == "t", [1.5, 0])
    out = {r.id: r for r in G.domain_ratio(df.where("grp = 's'"), df.where("grp = 't'"), ["f0", "f1"]).collect()}
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    w = solved(z, (g == "t").astype(float), 1e-2 * len(x))
    for i in np.flatnonzero(g == "s"):
        d = 1 / (1 + np.exp(-(w[0] + z[i] @ w[1:])))
        assert out[i].d == pytest.approx(d, abs=1e-6)
        assert out[i].weight == pytest.approx(np.clip(d / (1 - d) * (g == "s").sum() / (g == "t").sum(), 0.05, 20), rel=1e-5)
    assert len(out) == (g == "s").sum()


@pytest.mark.parametrize("equal", [True, False])
def test_weighted_thresholds(spark, equal):
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.random() < 0.3), float(np.round(rng.random(), 2)), 1.0 if equal else float(rng.integers(1, 9)) / 4) for i in range(700)]
    rows += [(700 + i, 1, 0.5, 1.0) for i in range(400)]  # many equal scores
    df = spark.createDataFrame(rows, "id long, y int, a double, w double").repartition(3)
    for alpha in (0.01, 0.1, 0.5, 0.9, 0.0005):
        got = {r.y: (r.n, r.threshold) for r in T.weighted_conformal_thresholds(df, "y", "a", "w", alpha, "id").collect()}
        for y in (0, 1):
            mine = sorted((r[2], r[0], r[3]) for r in rows if r[1] == y)
            cw = np.cumsum([r[2] for r in mine])
            at = np.searchsorted(cw / (cw[-1] + np.mean([r[2] for r in mine])), 1 - alpha)
            assert got[y] == (len(mine), mine[min(at, len(mine) - 1)][0])
    assert T.weighted_conformal_thresholds(df.limit(0), "y", "a", "w", 0.1, "id").count() == 0


def test_absent_class_takes_one(spark):
    df = spark.createDataFrame([(i, 1, 0.1 + i / 100) for i in range(30)], "id long, y int, s double")
    [r] = H.conformal_coverage(df, "y", "s", 0.1, "id").collect()
    assert r.singleton_share == pytest.approx(sum(0.1 + i / 100 < sorted(0.1 + j / 100 for j in range(30))[2] for i in range(30)) / 30, abs=0.07)
    assert r.coverage_1 >= 0.9


def test_running_totals_and_previous(spark):
    rng = np.random.default_rng(3)
    rows = [(["a", "b", None][int(rng.integers(0, 3))], int(rng.integers(0, 50)), i, int(rng.integers(-3, 9))) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, x long, id long, v long").repartition(5)
    placed = dealt(df, ["g"], ["x", "id"], "t")
    assert placed.select("_part").distinct().count() > 1
    out = previous(running_total(placed, ["g"], ["x", "id"], F.col("v"), "total"), ["g"], ["x", "id"], "x", "before")
    got = {r.id: (r.total, r.before) for r in out.collect()}
    for g in ("a", "b", None):
        total, before = 0, None
        for r in sorted(r for r in rows if r[0] == g and r) if g else sorted((r for r in rows if r[0] is None), key=lambda r: r[1:]):
            total += r[3]
            assert got[r[2]] == (total, before)
            before = r[1]
