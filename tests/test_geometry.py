"""Singular vectors, neighbours, thinning and matching against dense or sequential computations."""

import random

import numpy as np
import pytest

from limen.functions.numeric import hash_number
from limen.operators import latent as Z
from limen.operators import neighbours as N
from limen.operators import sampling as S


def sparse(seed, n, m, density):
    rng = np.random.default_rng(seed)
    a = rng.random((n, m)) * (rng.random((n, m)) < density)
    return a + np.outer(rng.random(n), rng.random(m)) * (a > 0)


def as_table(spark, a):
    return spark.createDataFrame([(int(i), f"f{j:03d}", float(a[i, j])) for i, j in zip(*np.nonzero(a))], "obs long, feature string, w double").repartition(5)


def test_singular_values_and_vectors(spark):
    a = sparse(0, 120, 70, 0.3)
    found = Z.latent(as_table(spark, a), 6)
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    assert found.values == pytest.approx(s[:6], rel=1e-6)
    scores, loads = ({r[0]: np.array(r.a) for r in t.collect()} for t in (found.scores, found.loadings))
    for c in range(6):
        mine = np.array([scores[i][c] for i in range(120)])
        assert abs(mine @ u[:, c]) == pytest.approx(s[c], rel=1e-6)
        assert abs(np.array([loads[f"f{j:03d}"][c] for j in range(70)]) @ vt[c]) == pytest.approx(1, abs=1e-6)


def test_components_drop_the_first_and_fix_signs(spark):
    a = sparse(1, 60, 30, 0.5)
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    got = {(r.obs, r.component): r.x for r in Z.latent_components(as_table(spark, a), 3).collect()}
    for c in range(1, 4):
        sign = np.sign(vt[c][np.abs(vt[c]).argmax()])
        assert [got[i, c - 1] for i in range(60)] == pytest.approx(list(u[:, c] * s[c] * sign), abs=1e-4)


def test_low_rank_and_empty(spark):
    a = np.outer(np.arange(1, 9), [1.0, 2, 0, 3]) + np.outer([1, 0] * 4, [0, 0, 1.0, 1])
    assert Z.latent(as_table(spark, a), 5).values == pytest.approx(np.linalg.svd(a)[1][:2], rel=1e-9)
    none = spark.createDataFrame([], "obs long, feature string, w double")
    assert len(Z.latent(none, 3).values) == 0 and Z.latent_components(none, 3).count() == 0


def test_triangles_fold_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(Z, "FAN", 2)
    rows = np.random.default_rng(2).normal(size=(300, 4))
    t = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(rows)], "k long, a array<double>").repartition(9)
    r = Z._triangle(t, 4)
    assert r.T @ r == pytest.approx(rows.T @ rows)


def plain_nearest(ids, v, seeds, k):
    out = {}
    for s in seeds:
        q = v[ids.index(s)]
        d = np.sqrt(((v - q) ** 2).sum(axis=1))
        out[s] = [i for _, i in sorted((round(float(x), 12), i) for x, i in zip(d, ids) if i != s)[:k]]
    return out


@pytest.mark.parametrize("dims, n", [(2, 600), (16, 300), (3, 4)])
def test_neighbours(spark, dims, n):
    rng = np.random.default_rng(dims)
    v = np.round(rng.normal(size=(n, dims)) * 4) / 4  # ties
    v[: n // 3] = v[0]  # a crowd of equal vectors
    ids = list(range(100, 100 + n))
    rows = spark.createDataFrame([(i, list(map(float, x))) for i, x in zip(ids, v)], "vec_id long, v array<double>").repartition(3)
    seeds = ids[:: max(1, n // 20)]
    asked = rows.where(rows.vec_id.isin(seeds)).selectExpr("vec_id AS seed", "v AS sv")
    got = {}
    for r in sorted(N.nearest(rows, asked, 7, pivots=10, piece=50).collect(), key=lambda r: (r.seed, r["rank"])):
        got.setdefault(r.seed, []).append(r.vec_id)
    assert got == plain_nearest(ids, v, seeds, 7)


def test_zscored(spark):
    v = np.random.default_rng(4).normal(size=(50, 3)) * [1, 100, 0] + 7
    rows = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(v)], "vec_id long, v array<double>")
    z = np.array([r.v for r in N.zscored(rows, "v", 3).orderBy("vec_id").collect()])
    assert z == pytest.approx((v - v.mean(axis=0)) / np.maximum(v.std(axis=0), 1e-12))


@pytest.mark.parametrize("overlap", [0.0, 0.3, 0.8])
def test_thinning_is_the_sequential_rule(spark, overlap):
    rng = random.Random(5)
    groups = {s: set(rng.sample(range(30), 8)) for s in range(60)}
    groups |= {60 + s: set(groups[s]) for s in range(10)}
    kept = []
    for s in sorted(groups):
        if all(len(groups[s] & groups[o]) <= overlap * len(groups[s]) for o in kept):
            kept.append(s)
    df = spark.createDataFrame([(s, m) for s, g in groups.items() for m in g], "seed long, vec_id long").repartition(3)
    assert sorted(r.seed for r in N.thinned_groups(df, overlap).collect()) == kept


def sequential(cases, controls, caliper, order):
    used, out = set(), []
    for stratum, i, x in sorted(cases, key=lambda c: order[c[1]]):
        near = sorted((abs(x - kx), k) for s, k, kx in controls if s == stratum and k not in used and abs(x - kx) <= caliper)
        if near:
            used.add(near[0][1])
            out.append((stratum, i, near[0][1], near[0][0]))
    return sorted(out)


@pytest.mark.parametrize("caliper", [0.0, 1.0, 5.0, 1e9])
def test_matching_is_the_sequential_rule(spark, caliper):
    rng = random.Random(6)
    side = lambda low, n: [(rng.choice("ab"), low + i, float(rng.randint(0, 400)) / 2) for i in range(n)]
    cases, controls = side(0, 120), side(1000, 150)
    df = lambda rows: spark.createDataFrame(rows, "stratum string, id long, x double").repartition(3)
    odd = [(None, 5000, 1.0), ("a", 5001, None)]
    order = {r.id: (r.h, r.id) for r in df(cases).select("id", hash_number(__import__("pyspark.sql.functions", fromlist=["lit"]).lit(0), "id").alias("h")).collect()}
    got = S.caliper_match(df(cases + odd), df(controls + odd), caliper)
    assert sorted(map(tuple, got.collect())) == sequential(cases, controls, caliper, order)


def test_one_stratum_is_several_tasks(spark):
    rows = [("a", i, float(10 * (i // 2))) for i in range(200)]
    df = spark.createDataFrame(rows, "stratum string, id long, x double")
    got = S.caliper_match(df.where("id % 2 = 0"), df.where("id % 2 = 1"), 1.0)
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "segment" in plan
    assert sorted((r.case_id, r.control_id) for r in got.collect()) == [(i, i + 1) for i in range(0, 200, 2)]


@pytest.mark.parametrize("asked", [N.ASKED, 3])
def test_neighbours_of_a_crowd(spark, monkeypatch, asked):
    """Equal vectors tie to the smaller id, seeds come in parts, and no pair of a seed and a row is a row of a join."""
    monkeypatch.setattr(N, "ASKED", asked)
    v = np.concatenate([np.ones((150, 3)), np.random.default_rng(5).integers(-2, 3, (90, 3)) + 0.25])
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, v array<double>")
    seeds = rows.where("vec_id % 16 = 0").selectExpr("vec_id AS seed", "v AS sv")
    found = N.nearest(rows, seeds, 6, pivots=9, piece=40)
    want = plain_nearest(list(range(len(v))), v, range(0, len(v), 16), 6)
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.seed, r["rank"])):
        assert r.distance == pytest.approx(float(np.sqrt(((v[r.vec_id] - v[r.seed]) ** 2).sum())))
        got.setdefault(r.seed, []).append(r.vec_id)
    assert got == want
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
