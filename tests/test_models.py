"""Least squares, calibration curves, binomial draws, rank sums and joint quantiles against plain computations."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from limen.functions.numeric import hash_number
from limen.operators import exact as E
from limen.operators import regress as R
from limen.operators import tests as T


def test_least_squares(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 2)) * [1, 1000] + [0, 5000]
    cls = rng.integers(0, 3, 80)
    y = 2 + x @ [0.5, -0.01] + cls * 3.0 + rng.normal(size=80)
    df = spark.createDataFrame([(f"c{c}", float(a), float(b), float(v)) for c, (a, b), v in zip(cls, x, y)] + [("c0", None, 1.0, 1.0)], "cls string, a double, b double, y double").repartition(3)
    found = R.least_squares(df, F.col("y"), [F.col("a"), F.col("b"), *R.dummies("cls", df)])
    full = np.column_stack([np.ones(80), x, cls == 1, cls == 2]).astype(float)
    assert found == pytest.approx(np.linalg.lstsq(full, y, rcond=None)[0], rel=1e-6, abs=1e-6)
    assert np.isnan(R.least_squares(df.limit(0), F.col("y"), [F.col("a")])).all()


def test_dependent_columns_take_the_smallest_solution():
    x = np.column_stack([np.ones(20), np.arange(20.0), np.zeros(20)])
    y = 1 + 2 * np.arange(20.0)
    t = np.column_stack([x, y])
    a, b = np.triu_indices(4)
    assert R.coefficients((t.T @ t)[a, b])[0] == pytest.approx([1, 2, 0], abs=1e-8)


def pairs(spark, seed=1, donors=12, types=8):
    rng = np.random.default_rng(seed)
    rows = [(d, f"{'xyz'[t % 3]}{t}", float(abs(rng.normal()) * 0.08 * (t + 1)), float((t + 1) / 60), float(400 + 50 * d)) for d in range(donors) for t in range(types)]
    return rows, spark.createDataFrame(rows, "donor long, celltype string, z double, p double, n_eff double").withColumn("cls", F.substring("celltype", 1, 1))


def test_abundance_scaling(spark):
    rows, df = pairs(spark)
    got = R.abundance_scaling(df, "cls", 200)
    z, p, n = (np.array([r[k] for r in rows]) for k in (2, 3, 4))
    kappa, cls = z / np.sqrt(2 / n), np.array([r[1][0] for r in rows])
    x = lambda d, keep: np.column_stack([np.ones(len(keep)), np.log(p[keep]), *([cls[keep] == c for c in "yz"] if d else [])]).astype(float)
    fit = lambda d, keep: np.linalg.lstsq(x(d, keep), np.log(kappa[keep]), rcond=None)[0][1]
    every = np.arange(len(rows))
    assert got["gamma"] == pytest.approx(fit(False, every)) and got["gamma_adj_class"] == pytest.approx(fit(True, every))
    draws = spark.range(200).select("id", *[(hash_number(F.lit(0), F.col("id"), F.lit(i)) % 12).alias(f"d{i}") for i in range(12)]).orderBy("id").collect()
    for d, name in ((False, "gamma"), (True, "gamma_adj_class")):
        b = [fit(d, np.concatenate([np.flatnonzero([q[0] == k for q in rows]) for k in r[1:]])) for r in draws]
        assert (got[f"{name}_lo"], got[f"{name}_hi"]) == pytest.approx(tuple(np.percentile(b, [2.5, 97.5])), rel=1e-6)
    by = {t: np.array([r[1] == t for r in rows]) for t in {r[1] for r in rows}}
    use = [(kap2, n[m].mean(), p[m].mean()) for m in by.values() if (kap2 := (kappa[m] ** 2).mean()) > 1.02]
    k2, nn, pp = map(np.array, zip(*use))
    slope, inter = np.polyfit(np.log(nn * pp / (1 - pp)), np.log(k2 - 1), 1)
    c = np.sqrt((k2 - 1) * (1 - pp) / (nn * pp))
    assert [got[k] for k in ("model_slope", "c_implied", "c_median", "c_spread", "sd_log_c", "n_celltypes_used")] == pytest.approx([slope, math.exp(inter / 2), np.median(c), c.max() / c.min(), np.log(c).std(ddof=1), len(use)])


def test_calibration_curve(spark):
    rng = np.random.default_rng(2)
    rows = [(d, float(n), float(3 * n**-0.5 * math.exp(rng.normal() * 0.2))) for d in range(6) for n in rng.integers(20, 900, rng.integers(1, 5))]
    df = spark.createDataFrame(rows, "donor long, n_eff double, floor double")
    curve = {r.n_donors: r for r in R.calibration_curve(df, 300).collect()}
    n, y, donor = (np.array([r[k] for r in rows]) for k in (1, 2, 0))
    fit = lambda i: np.polyfit(np.log(n[i]), np.log(y[i]), 1)
    whole = math.exp(fit(np.arange(len(rows)))[1])
    draws = spark.range(300).select(*[(hash_number(F.lit(0), F.col("id"), F.lit(j)) % 6).alias(f"d{j}") for j in range(1, 7)]).collect()
    for m in range(1, 7):
        b, a = [], []
        for r in draws:
            i = np.concatenate([np.flatnonzero(donor == k) for k in r[:m]])
            if len(i) >= 5 and len(set(n[i])) > 1:
                s, t = fit(i)
                b.append(s)
                a.append(math.exp(t))
        if len(a) < 50:
            assert m not in curve
            continue
        lo, hi = np.percentile(a, [2.5, 97.5])
        assert (curve[m].n_fits, curve[m].coef_lo, curve[m].coef_hi, curve[m].coef_rel_halfwidth) == pytest.approx((len(a), lo, hi, (hi - lo) / 2 / whole), rel=1e-6)
        assert (curve[m].exponent_lo, curve[m].exponent_median) == pytest.approx((np.percentile(b, 2.5), np.median(b)), rel=1e-6)
    least = {r.tolerance: r.least_donors for r in R.least_donors(R.calibration_curve(df, 300), (0.0, 1e9)).collect()}
    assert least == {0.0: None, 1e9: min(curve)}


def cdf(n, p):
    terms = [math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)]
    return np.cumsum(terms)


def test_binomial_draws(spark):
    rows = [("a", 1, 0.5), ("b", 40, 0.03), ("c", 900, 0.4), ("d", 7, 0.999), ("e", 0, 0.3), ("f", 5, 0.0), ("g", 5, 1.0)]
    df = spark.createDataFrame(rows, "key string, n long, p double")
    got = {(r.key, r.rep): r.k for r in E.binomial_draws(df, "key", "n", "p", 500).collect()}
    u = {r[0]: r[1:] for r in df.select("key", *[((hash_number(F.lit(0), F.col("key"), F.lit(i)) + 0.5) / float(1 << 32)) for i in range(500)]).collect()}
    for key, n, p in rows:
        assert [got[key, i] for i in range(500)] == [min(n, int(x)) for x in np.searchsorted(cdf(n, p), u[key])]
    c = [got["c", i] for i in range(500)]
    assert abs(np.mean(c) - 360) < 3 and abs(np.std(c) - math.sqrt(216)) < 2


def test_odds_ratio_intervals(spark):
    rows = [("x", 30, 70, 300, 900), ("y", 0, 0, 5, 9), ("z", 0, 4, 10, 10)]
    got = {r.key: r for r in E.odds_ratio_intervals(spark.createDataFrame(rows, "key string, a long, b long, c long, d long"), "key", 800).collect()}
    assert got["y"].lo is None and got["y"].odds_ratio == pytest.approx(9.5 / 5.5)
    rng = np.random.default_rng(0)
    for key, a, b, c, d in rows[::2]:
        k = rng.binomial(a + b, (a + 0.5) / (a + b + 1), 200_000)
        lo, hi = np.percentile((k + 0.5) * (d + 0.5) / ((a + b - k + 0.5) * (c + 0.5)), [2.5, 97.5])
        assert (got[key].lo, got[key].hi) == pytest.approx((lo, hi), rel=0.12)


@pytest.mark.parametrize("n1, n0", [(1, 1), (2, 5), (4, 4), (5, 5), (3, 7)])
def test_rank_sums_by_enumeration(n1, n0):
    u = [sum(c) - n1 * (n1 + 1) // 2 for c in itertools.combinations(range(1, n1 + n0 + 1), n1)]
    counts = E.rank_sum_counts(n1, n0)
    assert counts == [u.count(k) for k in range(n1 * n0 + 1)]
    for k in range(n1 * n0 + 1):
        tail = min(sum(x <= k for x in u), sum(x >= k for x in u)) / len(u)
        assert E.rank_sum_exact(n1, n0, k) == pytest.approx(min(1, 2 * tail))


def test_rank_sum_p(spark):
    rng = random.Random(3)
    rows = [(g, rng.random() < 0.5, rng.random() if g != "tied" else float(rng.randint(0, 3))) for g in ("a", "b", "tied") for _ in range(20)] + [("big", i % 2 == 0, rng.random()) for i in range(120)] + [("one", True, 1.0)]
    df = spark.createDataFrame([(g, "x" if s else "y", v) for g, s, v in rows], "g string, side string, v double")
    tied = df.groupBy("g", "v").count().groupBy("g").agg(F.max(F.col("count") > 1).alias("tied"))
    s = T.rank_sum(df, "v", "side", "x", "g").join(tied, "g")
    got = {r.g: r for r in E.rank_sum_p(s, F.col("tied")).collect()}
    assert {g: r.exact for g, r in got.items()} == {"a": True, "b": True, "tied": False, "big": False, "one": False}
    for g in ("a", "b"):
        assert got[g].p_value == pytest.approx(E.rank_sum_exact(got[g].n1, got[g].n0, got[g].u))
    assert got["big"].p_value == pytest.approx(math.erfc(abs(got["big"].z) / math.sqrt(2)))
    assert got["one"].p_value is None


def bisected(a, r, n):
    lo, hi = 0.0, 1.0
    for _ in range(40):
        q = (lo + hi) / 2
        if ((a >= np.quantile(a, 1 - q)) & (r >= np.quantile(r, 1 - q))).sum() >= n:
            hi = q
        else:
            lo = q
    return np.quantile(a, 1 - hi), np.quantile(r, 1 - hi)


@pytest.mark.parametrize("per_type", [1, 30, 150, 10_000])
def test_joint_quantiles_equal_a_bisection(spark, per_type):
    rng = np.random.default_rng(4)
    rows = [(t, float(a), float(b)) for t, n in (("u", 200), ("v", 333), ("w", 1)) for a, b in zip(np.round(rng.lognormal(size=n), 2), rng.integers(0, 60, n))]
    df = spark.createDataFrame(rows, "celltype string, depth_a double, depth_r double").repartition(3)
    for r in E.joint_quantile_depths(df, per_type).collect():
        a, b = (np.array([x[k] for x in rows if x[0] == r.celltype]) for k in (1, 2))
        assert (r.depth_a, r.depth_r) == pytest.approx(bisected(a, b, per_type), abs=1e-6)
        assert r.eligible == ((a >= r.depth_a) & (b >= r.depth_r)).sum()
        assert r.eligible >= per_type or (r.depth_a, r.depth_r) == (a.min(), b.min())
