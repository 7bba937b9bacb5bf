"""Exact top-k search by inner product over a bit-sliced index.

Index: rows are dealt into blocks of at most ``block_rows``; a block holds its ids and, for each attribute and
bit, a bitmap over its rows (attributes are made non-negative by the block's own least value). Search: for a
query the slices of all attributes, shifted by the bits of the query's weights, are added by bitmap arithmetic
(carry-save adders over packed words) into the slices of the score. The top rows are then selected from the most
significant slice of the score downward: the rows that stay are split by the slice, until k are found; the rows at
the boundary, equal in all slices, are resolved exactly by smaller id. Blocks give k rows each, and those are
merged by a ranked aggregate.

Queries meet blocks in groups: (query group, block) pairs are dealt over tasks; the work is queries times rows by
definition, the memory of a task one block and one group. Nothing is broadcast.

Defined results: a component x becomes floor(1024 * x), x as double; vectors that are null or hold null or
non-finite components take no part, as query or candidate; vectors of another length than the query's are no
candidates for it; rows with the query's own id are no candidates; ties go to the smaller id; equal rows of one
id are candidates each; query rows that share an id ask once, with the least of their vectors; with fewer candidates than k all are returned; null ids take no part; an empty table gives
an empty result. Other columns are not read. Components up to 2**20 and scores within a long are exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved, ship

SCALE = 1024
BLOCK_ROWS = 1 << 15
GROUP_ROWS = 64


def quantised(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): the vectors that take part, as whole numbers."""
    fine = F.col("v").isNotNull() & F.col("id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(fine)
    return rows.select("id", F.transform("v", lambda x: F.floor(x * SCALE).cast("long")).alias("v"))


def slices(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(least value of each attribute, packed slices [attribute, bit, word], bits) of rows [row, attribute]."""
    low = values.min(axis=0)
    up = (values - low).T.copy()
    bits = max(1, int(up.max()).bit_length()) if up.size else 1
    n = up.shape[1]
    words = -(-n // 64)
    out = np.zeros((up.shape[0], bits, words), np.uint64)
    for b in range(bits):
        packed = np.packbits((up >> b & 1).astype(np.uint8), axis=1, bitorder="little")
        out[:, b].view(np.uint8)[:, : packed.shape[1]] = packed
    return low, out, bits


def weighted_sum(index: np.ndarray, weights: np.ndarray, valid: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Slices of sum(w_d * x_d) plus a constant, least significant first, and the constant.

    A negative weight takes the complement of the attribute: -w * x = w * (top - x) - w * top."""
    bits = index.shape[1]
    top = (1 << bits) - 1
    most = int(np.abs(weights).sum()) * top
    columns: list[list[np.ndarray]] = [[] for _ in range(most.bit_length() + 2)]
    extra = 0
    for sign in (1, -1):
        w = np.where(sign * weights > 0, np.abs(weights), 0)
        if not w.any():
            continue
        if sign < 0:
            extra -= int(w.sum()) * top
        for j in range(int(w.max()).bit_length()):
            rows = np.flatnonzero(w >> j & 1)
            if len(rows):
                part = index[rows]
                if sign < 0:
                    part = ~part & valid
                for b in range(bits):
                    columns[j + b].append(part[:, b])
    out = []
    for at in range(len(columns)):
        x = np.concatenate(columns[at]) if columns[at] else np.zeros((0, len(valid)), np.uint64)
        columns[at] = []
        while len(x) > 1:
            n = len(x) // 3
            if n:
                a, b, c = x[:n], x[n : 2 * n], x[2 * n : 3 * n]
                half = a ^ b
                carry = (a & b) | (half & c)
                x = np.concatenate([half ^ c, x[3 * n :]])
            else:
                carry = x[:1] & x[1:]
                x = x[:1] ^ x[1:]
            if at + 1 == len(columns):
                columns.append([])
            columns[at + 1].append(carry)
        out.append(x[0] if len(x) else np.zeros(len(valid), np.uint64))
    return out, extra


def select_top(score: list[np.ndarray], among: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are surely in, rows tied at the boundary) as bitmaps, from the top slice downward."""
    count = lambda x: int(np.bitwise_count(x).sum())
    sure, tied = np.zeros_like(among), among.copy()
    have, left = 0, count(among)
    if left <= k:
        return tied, sure
    for s in reversed(score):
        ones = tied & s
        n = count(ones)
        if have + n > k:
            tied = ones
        elif have + n < k:
            sure, have, tied = sure | ones, have + n, tied & ~s
        else:
            return sure | ones, np.zeros_like(among)
    return sure, tied


def rows_of(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def search_block(ids: np.ndarray, low: np.ndarray, index: np.ndarray, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(id, score) of the block's k best rows for one query."""
    n, words = len(ids), index.shape[2]
    valid = np.packbits(np.arange(words * 64) < n, bitorder="little").view(np.uint64)
    own = np.flatnonzero(ids == query_id)
    among = valid.copy()
    for i in own:
        among[i // 64] &= ~np.uint64(1 << (int(i) % 64))
    score, extra = weighted_sum(index, query, valid)
    extra += int((query * low).sum())
    sure, tied = select_top(score, among, k)
    rows = rows_of(sure)
    at_edge = rows_of(tied)
    at_edge = at_edge[np.argsort(ids[at_edge], kind="stable")][: k - len(rows)]
    out = []
    for r in np.concatenate([rows, at_edge]).astype(np.int64):
        word, bit = int(r) // 64, np.uint64(int(r) % 64)
        out.append((int(ids[r]), sum(int(s[word] >> bit & np.uint64(1)) << j for j, s in enumerate(score)) + extra))
    return out


def build_index(df: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of quantised rows as a written table: dims, block, n, ids, low, bits, slices (packed words)."""
    spark = df.sparkSession
    ship(spark)
    total = df.count()
    n_blocks = max(1, -(-total // block_rows))

    def run(batches):
        import pyarrow as pa

        from limen.llm.topk import slices

        held: dict[int, list] = {}

        def flush(rows):
            values = np.array([r[1] for r in rows], np.int64).reshape(len(rows), -1)
            low, index, bits = slices(values)
            return values.shape[1], len(rows), np.array([r[0] for r in rows], np.int64).tobytes(), low.tobytes(), bits, index.tobytes()

        def give(rows):
            cols = list(zip(flush(rows)))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary()))], ["dims", "n", "ids", "low", "bits", "slices"])

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not v:
                    continue
                rows = held.setdefault(len(v), [])
                rows.append((i, v))
                if len(rows) == block_rows:
                    yield give(held.pop(len(v)))
        for rows in held.values():
            yield give(rows)

    dealt = df.repartition(n_blocks)
    return saved(dealt.mapInArrow(run, "dims int, n int, ids binary, low binary, bits int, slices binary"), "bsi")


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per query and rank: query_id, rank, vec_id, score."""
    spark = candidates.sparkSession
    index = build_index(quantised(candidates, id_col, vector_col), block_rows)
    asked = quantised(queries, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v"))
    # query groups: each query goes to one; a group is a row with its queries' ids and vectors
    n_groups = max(1, -(-asked.count() // GROUP_ROWS))
    grouped = (
        asked.withColumn("dims", F.size("v"))
        .where("dims > 0")
        .withColumn("g", F.pmod(F.xxhash64("id"), F.lit(n_groups)))
        .groupBy("dims", "g")
        .agg(F.collect_list(F.struct("id", "v")).alias("asked"))
    )
    pairs = index.join(grouped, "dims").repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1), "g", "dims", F.xxhash64("ids"))

    def run(batches):
        import pyarrow as pa

        from limen.llm.topk import search_block

        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i] for c in ("dims", "n", "ids", "low", "bits", "slices", "asked")}
                dims, n, bits = (row[c].as_py() for c in ("dims", "n", "bits"))
                ids = np.frombuffer(row["ids"].as_py(), np.int64)
                low = np.frombuffer(row["low"].as_py(), np.int64)
                index = np.frombuffer(row["slices"].as_py(), np.uint64).reshape(dims, bits, -(-n // 64))
                out = [(q["id"], *found) for q in row["asked"].as_py() for found in search_block(ids, low, index, q["id"], np.array(q["v"], np.int64), k)]
                cols = list(zip(*out)) if out else [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

    found = pairs.select("dims", "n", "ids", "low", "bits", "slices", "asked").mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
