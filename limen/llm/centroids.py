"""Centroid clustering of whole-number vectors with Elkan's bounds.

Every vector keeps, in a written table, its centroid, an upper bound of the distance to it and a lower bound of the
distance to each centroid. A pass first moves the bounds by how far the centroids went, then leaves out each distance
that they, or half the distance between two centroids, show to be needless. What is left out is strictly farther:
bounds are rounded away from the truth (upper ones up, lower ones down) and only ``bound > upper`` excludes, so a tie
is always computed, in whole numbers, and goes to the smaller number. Results are those of the plain algorithm.

A pass reads the table once and writes it once. The sums behind the next centroids ride along: each task ends with a
row for each centroid that gained or lost vectors, with what the moved vectors change, committed in the task's own
file; the driver gets one total for each centroid and component. Nothing else leaves the executors, a task holds one
Arrow batch, and a lost executor costs the tasks that it ran.

Defined results: a component x becomes floor(scale * x), x as double; vectors that are null, have another length than
``dims`` or hold null or non-finite components take no part and get no row; whole numbers beyond 2**27 in size, whose
squared distances could leave a long, stop the job with a message; centroids start as the vectors with the smallest
sha256 of ``1:<id>``, a null id counting as no digits, ties by components; with fewer vectors than ``k`` each is a
centroid; repeated rows are vectors each; empty centroids stay where they are; an empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, saved, ship, work_dir

SCALE = 64
#: Size of the whole numbers at most: a squared distance of 64 components stays within a long.
MOST = 1 << 27
#: More than what a square root and a sum of doubles can be off by, relatively.
SLACK = 2.0**-50


def quantised(df: DataFrame, id_col: str, vector_col: str, dims: int, scale: int = SCALE) -> DataFrame:
    """(id, v array<int>): the vectors that take part."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where((F.size("v") == dims) & finite)
    small = F.forall("v", lambda x: F.abs(x) * scale <= MOST)
    stop = F.raise_error(F.concat(F.lit("components too large for exact distances, vector "), F.coalesce(F.col("id").cast("string"), F.lit("null")))).cast("array<int>")
    return rows.select("id", F.when(small, F.transform("v", lambda x: F.floor(x * scale).cast("int"))).otherwise(stop).alias("v"))


def above(squared: np.ndarray) -> np.ndarray:
    """A distance that is surely not smaller."""
    return np.sqrt(squared.astype(np.float64)) * (1 + SLACK)


def below(squared: np.ndarray) -> np.ndarray:
    """A distance that is surely not larger."""
    return np.sqrt(squared.astype(np.float64)) * (1 - SLACK)


def narrowed(bound: np.ndarray) -> np.ndarray:
    """Lower bounds in single precision, rounded down."""
    return np.nextafter(bound.astype(np.float32), np.float32(-np.inf))


def squared_distance(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    apart = v - c
    return np.einsum("ij,ij->i", apart, apart)


def halves(centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half the distances between centroids, rounded down, and the least of each centroid to another."""
    apart = centres[:, None, :] - centres[None, :, :]
    half = below((apart * apart).sum(axis=2)) / 2
    other = half.copy()
    np.fill_diagonal(other, np.inf)
    return half, other.min(axis=1)


@dataclass
class Bounds:
    """What a batch of vectors knows: centroid, upper bound, lower bounds; changed in place by nearest()."""

    cluster: np.ndarray
    upper: np.ndarray
    lower: np.ndarray

    def shift(self, drift: np.ndarray) -> None:
        """The centroids went this far (rounded up)."""
        self.upper[:] = (self.upper + drift[self.cluster]) * (1 + SLACK)
        self.lower[:] = narrowed(self.lower.astype(np.float64) - drift)


def nearest(v: np.ndarray, b: Bounds, centres: np.ndarray, half: np.ndarray, least: np.ndarray) -> int:
    """Put every vector to its nearest centroid (ties: the smaller number); how many distances that took."""
    at = np.flatnonzero(b.upper >= least[b.cluster])
    if not len(at):
        return 0
    own = b.cluster[at]
    upper = b.upper[at]
    may = (b.lower[at] <= upper[:, None]) & (half[own] <= upper[:, None])
    may[np.arange(len(at)), own] = False
    at = at[may.any(axis=1)]
    if not len(at):
        return 0
    # one exact distance mends the upper bound before any other is computed
    rows, own = v[at], b.cluster[at]
    best = squared_distance(rows, centres[own])
    b.upper[at], b.lower[at, own] = above(best), narrowed(below(best))
    took = len(at)
    for j in range(len(centres)):
        upper = b.upper[at]
        test = np.flatnonzero((own != j) & (b.lower[at, j] <= upper) & (half[own, j] <= upper))
        if not len(test):
            continue
        took += len(test)
        far = squared_distance(rows[test], centres[j])
        b.lower[at[test], j] = narrowed(below(far))
        wins = (far < best[test]) | ((far == best[test]) & (j < own[test]))
        won = test[wins]
        best[won], own[won] = far[wins], j
        b.upper[at[won]] = above(far[wins])
    b.cluster[at] = own
    return took


STATE = "id {id}, v array<int>, cluster int, upper double, lower array<float>, part int, part_sum array<long>"


def _pass(state: DataFrame, centres: np.ndarray, drift: np.ndarray | None, id_type: str) -> DataFrame:
    """The state after one assignment; drift None: no vector has bounds yet."""
    half, least = halves(centres)
    k, dims = centres.shape

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from limen.llm.centroids import Bounds, nearest

        gain = np.zeros((k, dims + 2), np.int64)  # of each centroid: sums, vectors gained, distances computed
        kinds = [pa.list_(pa.int32()), pa.int32(), pa.float64(), pa.list_(pa.float32()), pa.int32(), pa.list_(pa.int64())]
        names = ["id", "v", "cluster", "upper", "lower", "part", "part_sum"]
        id_kind = None

        def many(values, width, kind):
            return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, width), pa.int32()), pa.array(values.ravel(), kind))

        for b in batches:
            id_kind, n = b.column(0).type, b.num_rows
            if not n:
                continue
            v = b.column(1).flatten().to_numpy().reshape(n, dims).astype(np.int64)
            if drift is None:
                before, held = np.full(n, -1, np.int32), Bounds(np.zeros(n, np.int32), np.full(n, np.inf), np.zeros((n, k), np.float32))
            else:
                before = b.column(2).to_numpy()
                held = Bounds(before.copy(), b.column(3).to_numpy().copy(), b.column(4).flatten().to_numpy().reshape(n, k).copy())
                held.shift(drift)
            gain[0, -1] += nearest(v, held, centres, half, least)
            moved = np.flatnonzero(held.cluster != before)
            for side, sign in ((held.cluster, 1), (before, -1)):
                for j in np.unique(side[moved]):
                    if j >= 0:
                        rows = moved[side[moved] == j]
                        gain[j, :dims] += sign * v[rows].sum(axis=0)
                        gain[j, dims] += sign * len(rows)
            none = [pa.nulls(n, t) for t in kinds[4:]]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(kinds[0]), pa.array(held.cluster, pa.int32()), pa.array(held.upper), many(held.lower, k, pa.float32()), *none], names)
        if id_kind is not None:
            cols = [pa.nulls(k, id_kind), *(pa.nulls(k, t) for t in kinds[:4]), pa.array(np.arange(k), pa.int32()), many(gain, dims + 2, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names)

    return state.mapInArrow(run, STATE.format(id=id_type))


def _gathered(state: DataFrame, k: int, width: int) -> list[list[int]]:
    """Totals of the tasks' last rows: k x width numbers."""
    each = state.where("part IS NOT NULL").select("part", F.posexplode("part_sum").alias("d", "x")).groupBy("part", "d").agg(F.sum("x").alias("x"))
    out = [[0] * width for _ in range(k)]
    for r in each.collect():
        out[r["part"]][r["d"]] = r["x"]
    return out


@dataclass
class Clustering:
    """assigned: id, cluster, distance (a written table); distances: how many each pass computed."""

    assigned: DataFrame
    centroids: list[list[int]]
    distances: list[int] = field(default_factory=list)


def fit(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, rounds: int = 3, dims: int = 64, scale: int = SCALE) -> Clustering:
    """``rounds`` rounds of assignment and new centroids, then a last assignment."""
    spark = df.sparkSession
    ship(spark)
    rows = quantised(df, id_col, vector_col, dims, scale)
    id_type = rows.schema["id"].dataType.simpleString()
    by = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    centres = np.array([r["v"] for r in rows.orderBy(by, "v").select("v").limit(k).collect()], np.int64)
    if not len(centres):
        return Clustering(rows.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), [])
    k = len(centres)
    total = [[0] * (dims + 2) for _ in range(k)]
    state, drift, path, took = rows, None, None, []
    for step in range(rounds + 1):
        into = work_dir(spark, f"elkan-{step}")
        written = saved(_pass(state, centres, drift, id_type), "elkan", into)
        if path:
            remove(spark, path)
        state, path = written.where("part IS NULL").select("id", "v", "cluster", "upper", "lower"), into
        gained = _gathered(written, k, dims + 2)
        took.append(gained[0][-1])
        if step == rounds:
            break
        total = [[x + y for x, y in zip(*rows)] for rows in zip(total, gained)]
        new = np.array([[x // t[dims] for x in t[:dims]] if t[dims] else c for t, c in zip(total, centres.tolist())], np.int64)
        drift, centres = above(squared_distance(new, centres)), new
    assigned = saved(_distances(state, centres, id_type), "elkan-assigned")
    remove(spark, path)
    return Clustering(assigned, centres.tolist(), took)


def _distances(state: DataFrame, centres: np.ndarray, id_type: str) -> DataFrame:
    """id, cluster, squared distance to it: bounds may exclude the own centroid's exact distance until here."""
    dims = centres.shape[1]

    def run(batches):
        import pyarrow as pa

        from limen.llm.centroids import squared_distance

        for b in batches:
            v = b.column(1).flatten().to_numpy().reshape(b.num_rows, dims).astype("int64")
            far = squared_distance(v, centres[b.column(2).to_numpy()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(far)], ["id", "cluster", "distance"])

    return state.select("id", "v", "cluster").mapInArrow(run, f"id {id_type}, cluster int, distance long")


def clusters(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, rounds: int = 3, dims: int = 64, scale: int = SCALE) -> DataFrame:
    """Per vector: its id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = df.sparkSession
    found = fit(df, id_col, vector_col, k, rounds, dims, scale)
    per = {r["cluster"]: r["s"] for r in found.assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    named = [(j, per[j], sum(per.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(found.centroids) if j in per]
    about = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = found.assigned.join(F.broadcast(about), "cluster")  # k rows
    return joined.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
