"""Exact nearest neighbours by pivots, and groups of them thinned by rank.

Rows go to the nearest of some pivots, a bounded hash sample. From a cell's size and radius follows, for each seed, a
distance within which k rows must lie; by the triangle inequality only cells, and in them only rows, whose distance
from their pivot differs from the seed's by no more than that can hold a neighbour. Seeds meet cells in tiles: a cell
is cut into pieces of bounded size, so a crowd of equal vectors is dealt over tasks, and seeds into parts. A tile gives
each seed's k nearest in it; distances of no other pairs leave it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from limen.sources.scratch import written

PIVOTS = 64
PIECE = 1 << 14
#: Seeds that meet a piece in one task.
ASKED = 1 << 13
#: Relative slack of the bounds: more than sums of squares in doubles can be off by.
SLACK = 1e-9
#: By how much, for each dimension, a square of a distance from a product of matrices may be off, of the squares of both.
SQUARES = 1e-14


def zscored(rows: DataFrame, vector: str, dims: int) -> DataFrame:
    """rows with each component less its mean, over its deviation (population); a constant one becomes 0."""
    m = rows.agg(*[F.avg(F.col(vector)[d]).alias(f"m{d}") for d in range(dims)], *[F.stddev_pop(F.col(vector)[d]).alias(f"s{d}") for d in range(dims)]).first()
    mean, spread = ([m[f"{k}{d}"] or 0.0 for d in range(dims)] for k in "ms")
    scaled = F.array(*[(F.col(vector)[d] - F.lit(mean[d])) / F.lit(max(spread[d], 1e-12)) for d in range(dims)])
    return rows.withColumn(vector, scaled)


def nearest(rows: DataFrame, seeds: DataFrame, k: int, pivots: int = PIVOTS, piece: int = PIECE) -> DataFrame:
    """(seed, vec_id, distance, rank): the k nearest of rows (vec_id, v) to each of a stated set of seeds (seed, sv),
    by distance, then id; a row with the seed's own id is none. Ids are unique, vectors of one length and not null."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("v").limit(pivots).collect()
    kinds = rows.schema["vec_id"].dataType.simpleString(), seeds.schema["seed"].dataType.simpleString()
    if not sample:
        return seeds.select("seed", F.lit(None).cast(kinds[0]).alias("vec_id"), F.lit(0.0).alias("distance"), F.lit(0).alias("rank")).limit(0)
    points = np.unique(np.array([r["v"] for r in sample], float), axis=0)
    dims = points.shape[1]

    def to_pivots(v):
        import numpy as np

        return np.sqrt(np.maximum(((v[:, None, :] - points[None]) ** 2).sum(axis=2), 0))

    def place(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for part in (b.slice(at, 1024) for at in range(0, b.num_rows, 1024)):
                v = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                far = to_pivots(v)
                cell = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cell, pa.int32()), pa.array(far[np.arange(len(far)), cell])], ["vec_id", "v", "cell", "r"])

    cells = written(rows.select("vec_id", F.col("v").cast("array<double>").alias("v")).mapInArrow(place, f"vec_id {kinds[0]}, v array<double>, cell int, r double"), "cells")
    size, radius = np.zeros(len(points), np.int64), np.zeros(len(points))
    for r in cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("r")).collect():  # a row for each pivot
        size[r["cell"]], radius[r["cell"]] = r["n"], r["r"]
    pieces = np.maximum(1, -(-size // piece))

    def ask(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for part in (b.slice(at, 64) for at in range(0, b.num_rows, 64)):
                v = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                far, out = to_pivots(v), []
                for i, d in enumerate(far):
                    # cells by where they surely end: k rows and the seed itself lie within the bound
                    order = np.argsort(d + radius)
                    enough = np.flatnonzero(np.cumsum(size[order]) >= k + 1)
                    bound = (d + radius)[order[enough[0]]] * (1 + SLACK) + SLACK if len(enough) else np.inf
                    for c in np.flatnonzero((size > 0) & (d - radius <= bound)):
                        out += [(i, c, p, d[c], bound) for p in range(pieces[c])]
                at, cell, p, d, bound = (list(x) for x in zip(*out)) if out else ([],) * 5
                taken = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0).take(taken), part.column(1).take(taken), pa.array(cell, pa.int32()), pa.array(p, pa.int32()), pa.array(d, pa.float64()), pa.array(bound, pa.float64())], ["seed", "sv", "cell", "piece", "d", "bound"])

    asked = seeds.select("seed", F.col("sv").cast("array<double>").alias("sv")).mapInArrow(ask, f"seed {kinds[1]}, sv array<double>, cell int, piece int, d double, bound double")
    parts = max(1, -(-seeds.count() // ASKED))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("seed"), F.lit(parts)).cast("int"))
    cut = F.array(*[F.lit(int(p)) for p in pieces])
    dealt = cells.withColumn("piece", F.pmod(F.xxhash64("vec_id"), F.element_at(cut, F.col("cell") + 1)).cast("int"))
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def meet(theirs, ours):
        import numpy as np
        import pyarrow as pa

        found = []
        if theirs.num_rows and ours.num_rows:
            r, d, bound = (t[c].to_numpy() for t, c in ((theirs, "r"), (ours, "d"), (ours, "bound")))
            rows, asks = np.argsort(r, kind="stable"), np.argsort(d, kind="stable")
            r, d, bound = r[rows], d[asks], bound[asks]
            x = theirs["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)[rows]
            s = ours["sv"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)[asks]
            ids, own = theirs["vec_id"].combine_chunks().take(pa.array(rows)), ours["seed"].combine_chunks().take(pa.array(asks))
            code = {v: i for i, v in enumerate(ids.to_pylist())}
            self_at = [code.get(v) for v in own.to_pylist()]
            order = np.argsort(np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
            xx, ss = (x * x).sum(axis=1), (s * s).sum(axis=1)
            for at in range(0, len(s), 64):
                to = min(at + 64, len(s))
                low, high = np.searchsorted(r, (d - bound)[at:to].min()), np.searchsorted(r, (d + bound)[at:to].max(), "right")
                if low == high:
                    continue
                # squares by a product of matrices, off by rounding: they choose whose distance is summed as it is defined
                near = xx[low:high, None] + ss[at:to] - 2 * (x[low:high] @ s[at:to].T)
                off = SQUARES * dims * (xx[low:high].max() + ss[at:to])
                for q in range(at, to):
                    column = near[:, q - at]
                    if self_at[q] is not None and low <= self_at[q] < high:
                        column[self_at[q] - low] = np.inf
                    most = np.partition(column, k - 1)[k - 1] if len(column) > k else np.inf
                    some = np.flatnonzero((column <= most + 2 * off[q - at]) & (column < np.inf)) + low
                    total = np.zeros(len(some))
                    for c in range(dims):
                        total = total + (x[some, c] - s[q, c]) ** 2
                    apart = np.sqrt(total)
                    first = np.lexsort((order[some], apart))[:k]
                    first = first[apart[first] <= bound[q]]
                    found.append((np.full(len(first), q), some[first], apart[first]))
        q, i, apart = (np.concatenate(z) for z in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        if not found:
            return pa.Table.from_arrays([ours["seed"].slice(0, 0), theirs["vec_id"].slice(0, 0), pa.array(apart)], ["seed", "vec_id", "distance"])
        return pa.Table.from_arrays([own.take(pa.array(q)), ids.take(pa.array(i)), pa.array(apart)], ["seed", "vec_id", "distance"])

    tile = ["cell", "piece", "part"]
    count = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(4096, int(pieces.sum())))  # pieces are work, whatever their bytes
    ours, theirs = (t.repartition(count, *tile).groupBy(*tile) for t in (asked, dealt))
    met = theirs.cogroup(ours).applyInArrow(meet, f"seed {kinds[1]}, vec_id {kinds[0]}, distance double")
    w = Window.partitionBy("seed").orderBy("distance", "vec_id")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def conflicts(members: DataFrame, overlap: float) -> DataFrame:
    """(lo, hi): seeds lo < hi whose groups share more than overlap of hi's members. members: (seed, vec_id).

    Groups that share so many must share one of their rarest: only those are joined, then groups are compared whole."""
    sets = written(members.groupBy("seed").agg(F.collect_set("vec_id").alias("m")), "groups")
    least = sets.agg(F.min(F.size("m"))).first()[0] or 0
    needed = int(np.floor(overlap * least)) + 1
    counts = members.groupBy("vec_id").agg(F.count(F.lit(1)).alias("_n"))
    rare = Window.partitionBy("seed").orderBy("_n", "vec_id")
    prefix = members.join(counts, "vec_id").withColumn("_at", F.row_number().over(rare)).join(sets.select("seed", F.size("m").alias("_size")), "seed").where(F.col("_at") <= F.col("_size") - needed + 1)
    a, b = prefix.select("vec_id", F.col("seed").alias("lo")), prefix.select("vec_id", F.col("seed").alias("hi"))
    pairs = a.join(b, "vec_id").where("lo < hi").select("lo", "hi").distinct()
    whole = pairs.join(sets.select(F.col("seed").alias("lo"), F.col("m").alias("_a")), "lo").join(sets.select(F.col("seed").alias("hi"), F.col("m").alias("_b")), "hi")
    return whole.where(F.size(F.array_intersect("_a", "_b")) > overlap * F.size("_b")).select("lo", "hi")


def thinned_groups(members: DataFrame, overlap: float) -> DataFrame:
    """(seed): those kept when seeds are taken in order and one is dropped that shares more than overlap of its members
    with a kept one. In rounds: whoever has no undecided seed before it is kept, and drops those it conflicts with."""
    members = written(members, "members")  # asked for four times: their neighbours are sought once
    edges = written(conflicts(members, overlap), "conflicts")
    open_seeds, kept = written(members.select("seed").distinct(), "seeds"), []
    while True:
        now = written(open_seeds.join(edges.select(F.col("hi").alias("seed")).distinct(), "seed", "left_anti"), "kept")
        kept.append(now)
        if not edges.limit(1).count():
            break
        gone = written(edges.join(now.select(F.col("seed").alias("lo")), "lo", "left_semi").select(F.col("hi").alias("seed")).distinct(), "dropped")
        open_seeds = written(open_seeds.join(now, "seed", "left_anti").join(gone, "seed", "left_anti"), "seeds")
        edges = written(edges.join(open_seeds.select(F.col("seed").alias("lo")), "lo", "left_semi").join(open_seeds.select(F.col("seed").alias("hi")), "hi", "left_semi"), "conflicts")
    out = kept[0]
    for part in kept[1:]:
        out = out.unionByName(part)
    return out
