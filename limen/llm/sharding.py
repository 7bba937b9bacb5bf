"""K-d tree partitioning of documents into shards of nearly equal bytes (law ``bytes``).

The points are groups of equal texts; their coordinates are measures of the text alone (size, lines, words,
characters beyond ASCII, digits), so copies share a point even where their source or language differ. A node of
the tree that is to become several shards is split along its widest dimension, relative to the whole range, at the
weighted median that divides its bytes as its shards are divided, until each leaf is one shard.

The medians of a level are found for all its nodes together by distributed histograms: each pass counts the bytes
of every node in at most ``BINS`` bins of the interval that holds the median, first by the coordinate, then by the
text's digest, then by doc_id, until the bins are single values. The driver sees shards times BINS sums at most,
however large the input. A cut by doc_id divides a group of equal texts; it is made only where the group is larger
than ``slack`` of a shard, since a hot group would else make the sizes unequal.

Defined results: a null text has no bytes and size 8, its checksum is that of the empty text; null ids come first
within their shard; equal rows take neighbouring slots; shards may stay empty with fewer rows than shards; an
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import range_ranked, saved, text_or_empty

BINS = 2048
DIMS = ["d0", "d1", "d2", "d3", "d4"]
#: Part of a shard's bytes up to which a group of equal texts is kept whole at a cut.
SLACK = 0.002


def points(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Metadata rows: id, size, text_crc32, digest of the text and the coordinates."""
    t = text_or_empty("t")
    letters = F.char_length(t)
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).select(
        "id",
        (F.octet_length(t) + F.lit(8)).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(t), 1).alias("digest"),
        F.coalesce(F.col("id").try_cast("long"), F.when(F.col("id").isNull(), F.lit(-1)).otherwise(F.shiftrightunsigned(F.xxhash64("id"), 1))).alias("place"),
        F.octet_length(t).cast("long").alias("d0"),
        (letters - F.char_length(F.replace(t, F.lit("\n"), F.lit("")))).cast("long").alias("d1"),
        (letters - F.char_length(F.replace(t, F.lit(" "), F.lit("")))).cast("long").alias("d2"),
        (F.octet_length(t) - letters).cast("long").alias("d3"),
        F.regexp_count(t, F.lit("[0-9]")).cast("long").alias("d4"),
    )


@dataclass
class Node:
    """Shards first to first + n - 1, and the search for the cut between them.

    The rows are ordered by (dim, digest, place). ``pinned`` has the values of the leading columns at the cut, ``low``
    and ``high`` bound the next column's; ``below`` are the bytes before these, ``held`` those within."""

    first: int
    n: int
    columns: list[str] = field(default_factory=list)
    pinned: list[int] = field(default_factory=list)
    low: int = 0
    high: int = 0
    below: int = 0
    held: int = 0
    target: float = 0.0

    @property
    def wide(self) -> int:
        return (self.high - self.low) // BINS + 1


def _with(rows: DataFrame, nodes: list[Node]) -> DataFrame:
    """rows with what the search knows of their node: a table of at most as many rows as shards."""
    pin = lambda n, i: n.pinned[i] if len(n.pinned) > i else None
    known = [(n.first, n.n // 2, DIMS.index(n.columns[0]), len(n.pinned), pin(n, 0), pin(n, 1), pin(n, 2), n.low, n.high, n.wide, n.below + n.held - n.target <= n.target - n.below) for n in nodes]
    schema = "node int, half int, dim int, depth int, p0 long, p1 long, p2 long, low long, high long, wide long, at_cut boolean"
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(known, schema)), "node", "left").withColumn("d", F.expr(f"element_at(array({', '.join(DIMS)}), coalesce(dim, 0) + 1)"))


def _values(rows: DataFrame, nodes: list[Node]) -> DataFrame:
    """(node, size, v, low, high, wide): the next column's value of each row that agrees with what is pinned."""
    v = F.expr("CASE WHEN depth = 0 THEN d WHEN depth = 1 AND d = p0 THEN digest WHEN depth = 2 AND d = p0 AND digest = p1 THEN place END")
    return _with(rows, nodes).select("node", "size", v.alias("v"), "low", "high", "wide").where("v IS NOT NULL")


def _bounds(rows: DataFrame, nodes: list[Node]) -> None:
    """Set each node's interval to the range of its next column."""
    found = {r["node"]: r for r in _values(rows, nodes).groupBy("node").agg(F.min("v").alias("low"), F.max("v").alias("high")).collect()}
    for n in nodes:
        n.low, n.high = found[n.first]["low"], found[n.first]["high"]


def _narrow(rows: DataFrame, nodes: list[Node]) -> None:
    """One pass: the bin that holds a node's cut becomes its interval."""
    sums = _values(rows, nodes).where("v BETWEEN low AND high").withColumn("bin", F.expr("(v - low) div wide"))
    found: dict[int, list] = {}
    for r in sums.groupBy("node", "bin").agg(F.sum("size").alias("bytes"), F.min("v").alias("low"), F.max("v").alias("high")).collect():
        found.setdefault(r["node"], []).append(r)
    for n in nodes:
        ordered = sorted(found[n.first], key=lambda r: r["bin"])
        for r in ordered:
            if n.below + r["bytes"] >= n.target or r is ordered[-1]:
                n.low, n.high, n.held = r["low"], r["high"], r["bytes"]
                break
            n.below += r["bytes"]


def divided(rows: DataFrame, nodes: list[Node]) -> DataFrame:
    """rows with the node that each belongs to below the cuts. Rows at a cut go to the side that leaves the bytes
    nearer to what they should be."""
    below = F.expr("CASE WHEN d <> p0 THEN d < p0 WHEN p1 IS NULL THEN at_cut WHEN digest <> p1 THEN digest < p1 WHEN p2 IS NULL THEN at_cut WHEN place <> p2 THEN place < p2 ELSE at_cut END")
    return _with(rows, nodes).select(*[c for c in rows.columns if c != "node"], F.when(F.col("half").isNull() | below, F.col("node")).otherwise(F.col("node") + F.col("half")).cast("int").alias("node"))


def find_cuts(rows: DataFrame, nodes: list[Node], spread: dict[str, int], shard_bytes: float) -> list[Node]:
    """The nodes of one level that have rows, each with its cut."""
    aggs = [f(c).alias(f"{k}_{c}") for c in DIMS for k, f in (("low", F.min), ("high", F.max))]
    found = {r["node"]: r for r in rows.groupBy("node").agg(F.sum("size").alias("bytes"), *aggs).collect()}
    nodes = [n for n in nodes if n.first in found]
    for n in nodes:
        r = found[n.first]
        dim = max(DIMS, key=lambda d: ((r[f"high_{d}"] - r[f"low_{d}"]) / max(1, spread[d]), -DIMS.index(d)))
        n.columns = [dim, "digest", "place"]
        n.target = r["bytes"] * (n.n // 2) / n.n
    live = nodes
    for depth in range(3):
        if not live:
            break
        _bounds(rows, live)
        first = True
        while todo := [n for n in live if first or n.low < n.high]:
            _narrow(rows, todo)
            first = False
        for n in live:
            n.pinned.append(n.low)
        # equal coordinates, then equal texts, stay together while that leaves the shards nearly equal
        live = [n for n in live if n.held > (SLACK * shard_bytes if depth else 0)]
    return nodes


def sharded(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, size, text_crc32, law, shard, slot, grown_shard."""
    meta = saved(points(df, id_col, text_col), "points")
    whole = meta.agg(F.sum("size").alias("bytes"), *[(F.max(d) - F.min(d)).alias(d) for d in DIMS]).first()
    rows = meta.withColumn("node", F.lit(0))
    level = [Node(0, shards)]
    while whole["bytes"] and (level := [n for n in level if n.n > 1]):
        cut = find_cuts(rows, level, whole.asDict(), whole["bytes"] / shards)
        rows = saved(divided(rows, cut), "level")
        level = [child for n in cut for child in (Node(n.first, n.n // 2), Node(n.first + n.n // 2, n.n - n.n // 2))]
    placed = rows.select("id", "size", "text_crc32", F.col("node").alias("shard"))
    ranked = range_ranked(placed, ["shard"], ["id"], "slot", "shards")
    return ranked.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
