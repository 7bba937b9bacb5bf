"""Elkan's bounds against the plain algorithm in whole numbers, ties and awkward rows included."""

import hashlib
import math
import random

import numpy as np
import pytest

pytest.importorskip("limen.llm")

from limen.llm import centroids  # noqa: E402
from limen.llm.queries import op11_elkan_centroids  # noqa: E402


def plain(rows, k, rounds, dims, scale=64):
    """{(id, position among the kept rows): (cluster, distance)}, centroids."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres = [list(v) for _, v in seeds]
    dist = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c))
    assign = lambda: [min((dist(v, c), j) for j, c in enumerate(centres)) for _, v in kept]
    for _ in range(rounds):
        at = assign()
        for j in range(len(centres)):
            own = [v for (_, v), (_, c) in zip(kept, at) if c == j]
            if own:
                centres[j] = [sum(x) // len(own) for x in zip(*own)]
    return sorted(((str(i), j, d) for (i, _), (d, j) in zip(kept, assign()))), centres


def check(spark, rows, k, rounds, dims, parts=3):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster string").repartition(parts)
    found = centroids.fit(df, k=k, rounds=rounds, dims=dims)
    expected, centres = plain(rows, k, rounds, dims)
    assert sorted((str(r.id), r.cluster, r.distance) for r in found.assigned.collect()) == expected
    assert found.centroids == centres
    out = centroids.clusters(df, k=k, rounds=rounds, dims=dims)
    got = out.collect()
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in got) == expected
    for r in got:
        assert r.inertia == sum(d for *_, d in expected)
        assert r.cluster_inertia == sum(d for _, j, d in expected if j == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centres[r.cluster])).encode()).hexdigest()
    return found


def test_groups_skip_distances(spark):
    rng = random.Random(1)
    places = [[rng.uniform(-3, 3) for _ in range(8)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, 0.05) for x in places[i % 6]]) for i in range(900)]
    found = check(spark, rows, 6, 3, 8)
    assert len(found.distances) == 4
    assert found.distances[-1] < 900 * 6 / 4  # the plain algorithm takes 5,400 each time


def test_ties_and_repeats(spark):
    """A grid of few values: many equal distances, equal vectors and equal ids; a third of all rows are one vector."""
    rng = random.Random(2)
    rows = [(i % 150, [rng.randint(-1, 1) / 64 for _ in range(3)]) for i in range(300)] + [(7, [0.0, 0.0, 0.0])] * 150
    check(spark, rows, 9, 3, 3)


def test_awkward_rows(spark):
    rows = [(1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0]), (7, [1.0, 2.0, 3.0]), (8, [0.5, -0.5]), (None, [-1e-9, 0.0]), (None, [2.0, 2.0]), (8, [0.5, -0.5])]
    check(spark, rows, 16, 3, 2)
    assert check(spark, rows[:7], 16, 3, 2).centroids == []
    assert check(spark, [], 16, 3, 2).assigned.columns == ["id", "cluster", "distance"]


def test_one_centroid_and_no_rounds(spark):
    rows = [(i, [float(i), -float(i)]) for i in range(20)]
    check(spark, rows, 1, 2, 2)
    check(spark, rows, 4, 0, 2)


def test_large_numbers_are_exact_or_refused(spark):
    rows = [(i, [(-1) ** i * (2.0**20 + i), float(i)]) for i in range(12)]
    check(spark, rows, 5, 3, 2)
    df = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        centroids.fit(df, dims=2)


def test_bounds_hold():
    """After any number of moves, every bound is on its side of the exact distance."""
    rng = np.random.default_rng(3)
    v, c = rng.integers(-50, 50, (400, 5)), rng.integers(-50, 50, (7, 5))
    b = centroids.Bounds(np.zeros(400, np.int32), np.full(400, np.inf), np.zeros((400, 7), np.float32))
    for _ in range(6):
        centroids.nearest(v, b, c, *centroids.halves(c))
        exact = ((v[:, None] - c[None]) ** 2).sum(2)
        assert (b.cluster == exact.argmin(1)).all()
        assert (b.lower.astype(float) ** 2 * np.sign(b.lower) <= exact).all()
        assert (b.upper**2 >= exact[np.arange(400), b.cluster]).all()
        new = c + rng.integers(-4, 5, c.shape)
        b.shift(centroids.above(((new - c) ** 2).sum(1)))
        c = new


def test_query_reads_the_whole_table(spark):
    assert op11_elkan_centroids(spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
