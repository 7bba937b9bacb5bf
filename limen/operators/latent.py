"""Leading singular vectors of a sparse matrix of any size: subspace iteration from a random range.

The matrix is a table (obs, feature, w) and stays one; what multiplies it is a table of a few dozen numbers for each
row or column. Such tables are made orthonormal by a tree of small decompositions: a task folds its rows into one
triangle of ``l`` by ``l`` numbers, triangles are folded some at a time until one is left, and that one, the only thing
that reaches the driver, turns the table. ``l`` is the number of components asked for and a few more.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limen.sources.scratch import written

#: Triangles that one task folds.
FAN = 32


@dataclass
class Latent:
    """scores: (obs, a array), the left vectors times the values; loadings: (feature, a array), the right vectors."""

    values: np.ndarray
    scores: DataFrame
    loadings: DataFrame
    rounds: int


def _random_rows(keys: DataFrame, key: str, l: int, seed: int) -> DataFrame:  # noqa: E741
    """Normal numbers from hashes of the keys."""
    unit = lambda c, part: (F.pmod(F.xxhash64(F.lit(seed), F.lit(c), F.lit(part), key), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    return keys.select(key, F.array(*[F.sqrt(-2 * F.ln(unit(c, 0))) * F.cos(2 * math.pi * unit(c, 1)) for c in range(l)]).alias("a"))


def _times(weights: DataFrame, table: DataFrame, inner: str, outer: str, l: int) -> DataFrame:  # noqa: E741
    """(outer, a): the matrix (or its transpose) times a table of rows (inner, a)."""
    met = weights.join(table, inner)
    sums = met.groupBy(outer).agg(*[F.expr(f"sum(w * a[{c}]) AS s{c}") for c in range(l)])
    return sums.selectExpr(outer, f"array({', '.join(f's{c}' for c in range(l))}) AS a")


def _triangle(table: DataFrame, l: int) -> np.ndarray:  # noqa: E741
    """The triangular factor of the table's rows."""

    def fold(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        r = np.zeros((0, l))
        for b in batches:
            rows = b.column(b.schema.names.index("a")).flatten().to_numpy(zero_copy_only=False).reshape(-1, l)
            r = np.linalg.qr(np.vstack([r, rows]), mode="r")
        if len(r):
            flat = np.vstack([r, np.zeros((l - len(r), l))]).ravel()
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.ListArray.from_arrays(pa.array([0, l * l], pa.int32()), pa.array(flat))], ["at", "a"])

    parts = table.select("a").mapInArrow(fold, "at long, a array<double>")
    n = table.rdd.getNumPartitions()
    while n > FAN:
        parts, n = written(parts, "triangles"), -(-n // FAN)
        parts = parts.repartition(n, "at").mapInArrow(fold, "at long, a array<double>")
    stacked = [np.array(r["a"]).reshape(l, l) for r in parts.select("a").collect()]  # FAN of them at most
    return np.linalg.qr(np.vstack(stacked), mode="r") if stacked else np.zeros((l, l))


def _turned(table: DataFrame, key: str, turn: np.ndarray) -> DataFrame:
    """Each row times a small matrix."""
    l, r = turn.shape  # noqa: E741

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            new = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, l) @ turn
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * r, pa.int32()), pa.array(np.ascontiguousarray(new).ravel()))], [key, "a"])

    return table.select(key, "a").mapInArrow(run, f"{key} {table.schema[key].dataType.simpleString()}, a array<double>")


def _orthonormal(table: DataFrame, key: str, l: int, turns: int) -> tuple[DataFrame, int]:  # noqa: E741
    """An orthonormal basis of the table's columns, and how many there are. A second turn takes away what the first one
    leaves where columns are nearly dependent."""
    for _ in range(turns):
        _, s, vt = np.linalg.svd(_triangle(table, l))
        keep = int((s > 1e-12 * max(s.max(initial=0), 1e-300)).sum())
        if not keep:
            return table, 0
        table, l = written(_turned(table, key, vt[:keep].T / s[:keep]), "basis"), keep  # noqa: E741
    return table, l


#: How far the columns of a basis may be from each other in size before they are made orthonormal again: what is lost
#: of the small ones is as many times the precision of doubles.
SPREAD = 1e6


def latent(weights: DataFrame, k: int, extra: int = 24, tolerance: float = 1e-10, most: int = 40, seed: int = 0) -> Latent:
    """The k largest singular values of (obs, feature, w) and their vectors, fewer if the matrix has fewer.

    A round multiplies the basis by the matrix and its transpose, as often as its values' spread allows, and makes it
    orthonormal. Rounds go on until no value moves by more than tolerance, relatively; ``most`` bounds them. ``extra``
    more columns than asked for are carried: the more, the fewer rounds."""
    weights = written(weights.select("obs", "feature", F.col("w").cast("double").alias("w")), "weights")
    l = k + extra  # noqa: E741
    basis, l = _orthonormal(written(_random_rows(weights.select("feature").distinct(), "feature", l, seed), "range"), "feature", l, 2)
    if not l:
        return Latent(np.zeros(0), weights.select("obs", F.array().cast("array<double>").alias("a")).limit(0), basis, 0)
    before, rounds = None, 0
    while True:
        left = written(_times(weights, basis, "feature", "obs", l), "left")
        _, s, vt = np.linalg.svd(_triangle(left, l))
        rank = min(k, int((s > 1e-12 * max(s.max(initial=0), 1e-300)).sum()))
        if before is not None and (len(before) == rank and (np.abs(s[:rank] - before) <= tolerance * s[:rank]).all() or rounds >= most) or not rank:
            turn = vt[:rank].T
            return Latent(s[:rank], _turned(left, "obs", turn), _turned(basis, "feature", turn), rounds)
        spread = np.log(SPREAD) / max(2 * np.log(s[0] / max(s[-1], 1e-300)), 1e-9)
        before, rounds = s[:rank], rounds + 1
        right = _times(weights, left, "obs", "feature", l)
        for _ in range(min(3, int(spread)) - 1):
            right = _times(weights, _times(weights, right, "feature", "obs", l), "obs", "feature", l)
        basis, l = _orthonormal(written(right, "right"), "feature", l, 1)  # noqa: E741


def latent_components(weights: DataFrame, k: int, drop_first: bool = True) -> DataFrame:
    """(obs, component, x): scores on the leading singular vectors, signs fixed by the largest loading; drop_first:
    without the first one, which goes with depth."""
    first = 1 if drop_first else 0
    found = latent(weights, k + first)
    n = len(found.values)
    if n <= first:
        return weights.select("obs", F.lit(0).alias("component"), F.lit(0.0).alias("x")).limit(0)
    top = found.loadings.agg(*[F.max_by(F.col("a")[c], F.struct(F.abs(F.col("a")[c]))).alias(f"t{c}") for c in range(first, n)]).first()
    sign = [1.0 if top[f"t{c}"] >= 0 else -1.0 for c in range(first, n)]
    each = F.posexplode(F.array(*[F.col("a")[c] * s for c, s in zip(range(first, n), sign)])).alias("component", "x")
    return found.scores.select("obs", each)
