"""Merkle manifest of a dataset: a root per group and over all, and every row's authentication path.

Leaves are digests of rows. A group's leaves, in order of their ids, are hashed together ``WIDTH`` at a time, level by
level, until one node stays, the subroot; the subroots, in order of the groups' names, likewise give the root.

Ranks come from a range partitioning, so no group meets in a task. Aligned blocks of ``WIDTH ** BLOCK_LEVELS`` leaves
are rows of a written table, whole subtrees each; the roots of blocks are the leaves of the next table, until each
group has one block. Paths then go down again: a block is joined with the path of its own root, which all its leaves
share, and is walked leaf by leaf. The walk is Merkle's scheduling: for each level one treehash stack advances by one
leaf a step and has the next run of siblings ready when the walk enters it, so beside the leaves of its block a walk
holds a number of nodes that grows with the logarithm of the leaves. Nothing goes through the driver.

Defined results: a field is ``-`` if null, else its UTF-8 byte count, ``:`` and its value; null ids and null groups
sort first; rows of one id by their leaves; equal rows are leaves each; the lone leaf of a group is its subroot, with
an empty path in the group; an empty table gives an empty result. Columns that are not named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved, ship

WIDTH = 8
BLOCK_LEVELS = 4
#: Rows of (partition, group) up to which they are broadcast; beyond, Spark joins by shuffle.
BROADCAST_ROWS = 100_000
#: Rows of an Arrow batch of paths, of some kilobytes each.
PATH_ROWS = 256

PATH = "path array<struct<before:string,after:string>>, subroot string, root string"


def framed(c: str | Column) -> Column:
    """A value such that no two lists of values are framed alike."""
    value = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(*fields: str | Column) -> Column:
    return F.sha2(F.concat(*[framed(f) for f in fields]), 256)


def folded(node: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, node, lambda acc, x: F.sha2(F.concat(x["before"], acc, x["after"]), 256))


def siblings_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["before"], x["after"])), ""), 256)


def joined(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def levels_of(n: int) -> int:
    """Levels above n leaves until one node stays."""
    h = 0
    while n > 1:
        n, h = -(-n // WIDTH), h + 1
    return h


class TreeHash:
    """Nodes of one level, from the leaves one by one; holds at most WIDTH - 1 nodes for each level below."""

    def __init__(self, leaves: list[str], level: int):
        self.leaves, self.at, self.open = leaves, 0, [[] for _ in range(level)]

    def step(self) -> str | None:
        """Take the next leaf, if any; the node that it completes, if any."""
        if self.at == len(self.leaves):
            return None
        node = self.leaves[self.at]
        self.at += 1
        for waiting in self.open:
            waiting.append(node)
            if len(waiting) < WIDTH and self.at < len(self.leaves):
                return None
            node = joined(waiting)
            waiting.clear()
        return node


def block_root(leaves: list[str], levels: int) -> str:
    stack, node = TreeHash(leaves, levels), None
    for _ in leaves:
        node = stack.step() or node
    return node


def walk(leaves: list[str], levels: int) -> Iterator[list[tuple[str, str]]]:
    """For each leaf in turn the siblings before and after its node, level by level."""
    stacks = [TreeHash(leaves, h) for h in range(levels)]
    spans = [WIDTH**h for h in range(levels + 1)]

    def run(h: int) -> list[str]:
        return [x for _ in range(spans[h + 1]) if (x := stacks[h].step())]

    now = [run(h) for h in range(levels)]  # the runs that hold the path's nodes, and those that come next
    ahead: list[list[str]] = [[] for _ in range(levels)]
    path: list[tuple[str, str]] = [("", "")] * levels
    for i in range(len(leaves)):
        for h in range(levels):
            if i % spans[h]:
                break
            if i and not i % spans[h + 1]:
                now[h], ahead[h] = ahead[h], []
            own = i // spans[h] % WIDTH
            path[h] = ("".join(now[h][:own]), "".join(now[h][own + 1 :]))
        yield list(path)
        for h in range(levels):
            if node := stacks[h].step():
                ahead[h].append(node)


def _ranked(leaves: DataFrame) -> DataFrame:
    """leaves (written) with rank and total in their group: g, id, leaf, forged."""
    spark = leaves.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("g"), F.col("id").asc_nulls_first(), F.col("leaf")]
    # the last key only parts equal rows, of which one task need not hold all
    dealt = leaves.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(n, *order, F.col("_salt")).sortWithinPartitions(*order).drop("_salt")
    placed = saved(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "merkle-order")
    runs = saved(placed.groupBy("_part", "g").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first")), "merkle-runs")
    group = Window.partitionBy("g")
    before = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = runs.select("_part", "g", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(group).alias("total"))
    if runs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    return placed.join(starts, ["_part", "g"]).select("g", (F.col("_place") + F.col("_shift")).alias("rank"), "total", "id", "leaf", "forged")


def _blocks(ranked: DataFrame, size: int) -> DataFrame:
    """One row per aligned block: g, block, total, items in order; at most ``size`` items."""
    each = F.sort_array(F.collect_list(F.struct("rank", "id", "leaf", "forged")))
    return saved(ranked.groupBy("g", F.expr(f"rank div {size}").alias("block")).agg(F.first("total").alias("total"), each.alias("items")), "merkle-blocks")


def _levels(total: int, size: int) -> int:
    return levels_of(total) if total <= size else levels_of(size)


def _roots(blocks: DataFrame, size: int) -> DataFrame:
    """The nodes of the next table: g, rank, total, id (null), leaf, forged (null)."""

    def run(batches):
        import pyarrow as pa

        from limen.llm.merkle import _levels, block_root

        for b in batches:
            totals, items = b.column(2).to_pylist(), b.column(3)
            nodes = [block_root(items[i].values.field("leaf").to_pylist(), _levels(t, size)) for i, t in enumerate(totals)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([-(-t // size) for t in totals], pa.int64()), pa.array(nodes)], ["g", "rank", "total", "leaf"])

    ids = blocks.schema["items"].dataType.elementType["id"].dataType.simpleString()
    found = blocks.mapInArrow(run, "g string, rank long, total long, leaf string")
    return saved(found.select("g", "rank", "total", F.lit(None).cast(ids).alias("id"), "leaf", F.lit(None).cast("string").alias("forged")), "merkle-roots")


def _walked(blocks: DataFrame, above: DataFrame, size: int) -> DataFrame:
    """g, rank, id, leaf, forged, path, subroot, root of each item; above: g, block, path, subroot, root of blocks."""

    def run(batches):
        import pyarrow as pa

        from limen.llm.merkle import PATH_ROWS, _levels, walk

        for b in batches:
            for i in range(b.num_rows):
                one = {c: b.column(c)[i] for c in ("g", "total", "items", "path", "subroot", "root")}
                items, shared = one["items"].values, one["path"].as_py()
                shared = ([x["before"] for x in shared], [x["after"] for x in shared])
                own, total = [one[c].as_py() for c in ("g", "subroot", "root")], one["total"].as_py()
                before, after, ends, done = [], [], [0], 0

                def give(n, before=before, after=after, ends=ends, items=items, own=own):
                    path = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], ["before", "after"]))
                    part = items.slice(n - len(ends) + 1, len(ends) - 1)
                    g, subroot, root = (pa.array([x] * len(part), pa.string()) for x in own)
                    return pa.RecordBatch.from_arrays([g, *(part.field(c) for c in ("rank", "id", "leaf", "forged")), path, subroot, root], ["g", "rank", "id", "leaf", "forged", "path", "subroot", "root"])

                for path in walk(items.field("leaf").to_pylist(), _levels(total, size)):
                    for x, y in path:
                        before.append(x)
                        after.append(y)
                    before += shared[0]
                    after += shared[1]
                    ends.append(len(before))
                    done += 1
                    if len(ends) > PATH_ROWS:
                        yield give(done)
                        before.clear(), after.clear(), ends.__setitem__(slice(None), [0])
                if len(ends) > 1:
                    yield give(done)

    kind = blocks.schema["items"].dataType.elementType["id"].dataType.simpleString()
    met = blocks.join(above, ["g", "block"]).select("g", "total", "items", "path", "subroot", "root")
    return met.mapInArrow(run, f"g string, rank long, id {kind}, leaf string, forged string, {PATH}")


def _tree(ranked: DataFrame, size: int) -> tuple[list[DataFrame], DataFrame]:
    """(tables of blocks from the leaves upward, the groups' subroots as g, leaf)."""
    tables = []
    while True:
        tables.append(_blocks(ranked, size))
        ranked = _roots(tables[-1], size)
        if not ranked.where("total > 1").limit(1).count():
            return tables, ranked.select("g", "leaf")


def _down(tables: list[DataFrame], above: DataFrame, size: int) -> DataFrame:
    """The leaves with their paths; above: g, path, subroot, root of each group's top node."""
    above = above.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(tables[1:]):
        met = _walked(blocks, above, size)
        above = saved(met.select("g", F.col("rank").alias("block"), "path", "subroot", "root"), "merkle-upper")
    return _walked(tables[0], above, size)


def manifest(df: DataFrame, fields: list[str], id_col: str = "doc_id", group_col: str = "lang", forged: Column | None = None, levels: int = BLOCK_LEVELS) -> DataFrame:
    """Per row: id, leaf, forged, subroot, root, path (from the leaf up: siblings before and after the node).

    forged: a column over df that is another leaf to be tried against a row's path, or null."""
    spark = df.sparkSession
    ship(spark)
    size = WIDTH**levels
    name = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))  # null first, then by bytes
    alternative = forged if forged is not None else F.lit(None).cast("string")
    leaves = saved(df.select(name.alias("g"), F.col(id_col).alias("id"), leaf(*fields).alias("leaf"), alternative.alias("forged")), "merkle-leaves")
    tables, subroots = _tree(_ranked(leaves), size)
    # the tree over the groups: one group, whose leaves are subroots in order of names
    tops = saved(subroots.select(F.lit("").alias("g"), F.col("g").alias("id"), "leaf", F.lit(None).cast("string").alias("forged")), "merkle-subroots")
    top_tables, root = _tree(_ranked(tops), size)
    start = root.select("g", F.expr("cast(array() as array<struct<before:string,after:string>>)").alias("path"), F.lit("").alias("subroot"), F.col("leaf").alias("root"))
    groups = _down(top_tables, start, size).select(F.col("id").alias("g"), "path", F.col("leaf").alias("subroot"), "root")
    return _down(tables, saved(groups, "merkle-groups"), size).select(F.col("id").alias(id_col), "leaf", "forged", "subroot", "root", "path")


def verified_manifest(df: DataFrame, fields: list[str], tampered: Column | None = None, id_col: str = "doc_id", group_col: str = "lang", levels: int = BLOCK_LEVELS) -> DataFrame:
    """The manifest with the digest of each path, the root that the path gives for the forged leaf (else the leaf),
    and whether it is the root."""
    paths = manifest(df, fields, id_col, group_col, tampered, levels)
    again = paths.withColumn("folded_root", folded(F.coalesce("forged", "leaf"), F.col("path")))
    return again.select(id_col, "leaf", "subroot", "root", siblings_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def lowered_text_leaf(fields: list[str], id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The leaf of a row whose text had its A-Z lower-cased; null but where 3 divides the crc32 of the id."""
    small = F.translate(F.col(text_col).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 0
    return F.when(chosen, leaf(*[small if f == text_col else f for f in fields]))
