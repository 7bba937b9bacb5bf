"""Documents linked by the Jaccard similarity of their word n-grams, by a token-group matrix.

Nodes are distinct sets of shingles (copies are one node). A node's tokens in the matrix are ``bands_for(percent)``
hashes, each of three minima of its shingles under hash functions of their own; two nodes at the limit of 0.75 share
none of the 50 with a chance of 1.3e-12, at 0.8 of 3e-16: far rarer, pair by pair, than the links that any larger corpus
holds, and what they share grows with similarity, not with a common line or passage. So each node has the same number
of rows (token, node), whatever its length, and no list of frequent tokens is needed.

1. Partition: each node votes for the leader that its tokens name most (a token names its node of highest score, the
   sum of what its tokens have in common with others), is compared with that one alone, and joins it if they link. A
   few rounds, over the tokens whose nodes still lie in several groups; links stay linear in the nodes.
2. Matrix: nodes whose tokens still name nodes of other components go into groups of similar ones (those that a node of
   high score gathers by its tokens, and by those of the gathered, linked or not), cut into parts of some ``GROUP`` nodes, with a row for each token that
   members hold. A node asks the parts that share a token with it and hold a node of a larger component. A part stores
   the union of its members' shingles, and which members have each; a node's overlap with the union bounds what it can
   share with any member, and the part stays closed to a node whose bound is below what a link needs.
3. Parts that qualify are opened: a node's shingles that are in the union are counted for each member, which decides.
   Nodes come to a part as a stream, those of a part that very many ask in several tasks.

Every pair of nodes that share a token is so in one component, excluded by a bound, or compared. Components come from
contracting the links.

Shingles are 64-bit hashes of their words and nodes 64-bit hashes of their sets; two different ones are taken as
equal with a chance of 2**-64 a pair.

Defined results: a null or empty text, or one without words, has no shingles and is its own component (its own
id); with fewer words than n the whole sequence is the one shingle; equal rows are linked unless they are empty; a
null id gets the smallest id of its component, null if there is none; an empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_caches, release, remove, saved, ship, work_dir

#: Link: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Minima in a token, and how likely a pair at the limit may share no token.
MINIMA, MISS = 3, 1.5e-12
GROUP = 1024
#: Nodes that ask one task for one part, about; cells (shingle, member) of a block of a part.
ASKS, CELLS = 2048, 1 << 22
LEADER_ROUNDS = 3
#: Tokens that a node and its leader share for a comparison in the partition; pairs below are left to the matrix.
LEAST_VOTES = 5
KEPT_WORDS = 150_000
FILTER_BITS = 1 << 24

_hashes: dict[bytes, int] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, n: int = 5) -> np.ndarray:
    """The sorted set of hashed n-word shingles of a UTF-8 text, A-Z in lower case."""
    import xxhash

    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    known = own_caches("jaccard", _hashes)
    if len(known) > KEPT_WORDS:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    short = len(words) < n
    with np.errstate(over="ignore"):
        m = len(h) if short else n
        s = np.full(len(h) - m + 1, m, np.uint64)
        for j in range(m):
            s = s * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - m + 1 + j]
    return np.unique(_mixed(s))


def node_of(tokens: np.ndarray) -> int | None:
    import xxhash

    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63) if len(tokens) else None


def least_shared(n, percent: int = PERCENT):
    """Shingles that a set of n must share with another to link."""
    return (percent * n + 99) // 100


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if percent * max(len(a), len(b)) > 100 * min(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def bands_for(percent: int) -> int:
    """Tokens of a node: as many as leave a pair at the limit without a common one with a chance of MISS."""
    return max(1, math.ceil(math.log(MISS) / math.log1p(-((min(percent, 99) / 100) ** MINIMA))))


def bands(tokens: np.ndarray, many: int) -> np.ndarray:
    """The matrix tokens of a set: ``many`` hashes of MINIMA minima each, over the upper halves of the shingles."""
    by = (_mixed(np.arange(1, many * MINIMA + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    halves = (tokens >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(by), np.iinfo(np.uint32).max, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(halves), 1024):
            np.minimum(low, np.multiply.outer(by, halves[at : at + 1024]).min(axis=1), out=low)
        out = np.arange(many, dtype=np.uint64)
        for part in low.reshape(many, MINIMA).T:
            out = _mixed(out + part)
    return out.view(np.int64)


def _sets(docs: DataFrame, n: int, many: int) -> DataFrame:
    """(id, n, node, bands): a row per document; bands is null for sets so small that only equal ones link."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        from limen.llm.jaccard import bands, node_of, shingles

        for b in batches:
            sizes, nodes, tokens = [], [], []
            for t in b.column(1):
                s = shingles(t.as_py(), n)
                sizes.append(len(s)), nodes.append(node_of(s))
                tokens.append(bands(s, many) if len(s) > 2 else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))], ["id", "n", "node", "bands"])

    return docs.mapInArrow(run, f"id {id_type}, n long, node long, bands array<bigint>")


def _passing(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose key is one of wanted's, with few others: a filter of fixed size, on every machine, keeps most
    rows out of the shuffle of a join that follows."""
    at = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    bits = wanted.select(at.alias("at")).groupBy(F.expr("bitmap_bucket_number(at)").alias("bucket"))
    bits = saved(bits.agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("bits")), "bits")
    marked = rows.withColumn("_at", at).join(F.broadcast(bits), F.expr("bitmap_bucket_number(_at) = bucket"))
    byte = F.conv(F.hex(F.expr("substring(bits, cast(bitmap_bit_position(_at) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return marked.where(F.floor(byte / F.pow(F.lit(2), F.expr("bitmap_bit_position(_at) % 8"))) % 2 == 1).select(*rows.columns)


def _node_sets(rows: DataFrame, reps: DataFrame, n: int) -> DataFrame:
    """(node, tokens) of the nodes in reps (node, id), each from one document that has it."""

    def run(batches):
        import pyarrow as pa

        from limen.llm.jaccard import node_of, shingles

        for b in batches:
            sets = {node_of(s): s for s in (shingles(t.as_py(), n) for t in b.column(0)) if len(s)}
            yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.int64()), pa.array([s.tobytes() for s in sets.values()], pa.binary())], ["node", "tokens"])

    # an inner join: Spark would take a semi join below the filter, and shuffle all texts
    passing, ids = _passing(rows, "id", reps), reps.select("id").distinct()
    texts = passing.join(ids, passing["id"].eqNullSafe(ids["id"]))
    # an id may repeat with several texts: only sets that are wanted stay, each once
    return texts.select("text").mapInArrow(run, "node long, tokens binary").join(reps.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs that link."""

    def run(batches):
        import pyarrow as pa

        from limen.llm.jaccard import linked

        for c in batches:
            found = [linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in zip(c.column(2), c.column(3))]
            yield pa.RecordBatch.from_arrays(c.columns[:2], ["a", "b"]).filter(pa.array(found, pa.bool_()))

    left = _passing(sets, "node", pairs.select(F.col("a").alias("node"))).select(F.col("node").alias("a"), F.col("tokens").alias("x"))
    right = _passing(sets, "node", pairs.select(F.col("b").alias("node"))).select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of the nodes that have links (a, b): comp is one node of the component.

    Each round every node points to the least of itself and its neighbours and the links are contracted along
    that; node numbers are hashes, so a constant part of the nodes goes in each round whatever the shape."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = saved(both.where("a <> b").distinct(), "edges")
    label = edges.select(F.col("a").alias("node"), F.col("a").alias("comp")).distinct()
    label = saved(label, "label")
    while not edges.isEmpty():
        to = saved(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("p")), "to")
        label = saved(label.join(to, label["comp"] == to["a"], "left").select("node", F.coalesce("p", "comp").alias("comp")), "label")
        step = edges.join(to.withColumnRenamed("p", "pa"), "a").select("pa", "b")
        step = step.join(to.select(F.col("a").alias("b"), F.col("p").alias("pb")), "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
        edges = saved(step.where("a <> b").distinct(), "edges")
    return label


def _shared(sets: DataFrame) -> DataFrame:
    """(token, node, score) of the tokens that several nodes have. Tokens are aggregated and written before rows are
    joined to them, which splits skewed ones; a node's score is what its tokens' holders add up to."""
    rows = sets.where("bands IS NOT NULL").select("node", F.explode("bands").alias("token"))
    tokens = saved(rows.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("token"), "tokens")
    release(sets.sparkSession)
    some = saved(rows.join(tokens, "token").select("token", "node").distinct(), "some")
    release(sets.sparkSession)
    held = saved(some.groupBy("token").agg(F.count(F.lit(1)).alias("c")), "held")
    score = saved(some.join(held, "token").groupBy("node").agg(F.sum("c").alias("score")), "score")
    return saved(some.join(score, "node"), "shared")


def _with_comp(rows: DataFrame, comp: DataFrame) -> DataFrame:
    return rows.drop("comp").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _unsettled(rows: DataFrame) -> DataFrame:
    """Rows of tokens whose nodes lie in several components."""
    rows = saved(rows, "with-comp")
    open_tokens = saved(rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token"), "open")
    return saved(rows.join(open_tokens, "token"), "left")


def _leader_pairs(left: DataFrame, tried: DataFrame | None) -> DataFrame:
    """(a, b): for each node b of left the leader a, of another component, that most of its tokens name."""
    chiefs = saved(left.groupBy("token").agg(F.max(F.struct("score", "node", "comp")).alias("chief")), "chiefs")
    named = left.join(chiefs, "token").where("comp <> chief.comp").select(F.col("chief.node").alias("a"), F.col("node").alias("b"), F.col("chief.score").alias("of"))
    votes = named.groupBy("a", "b").agg(F.count(F.lit(1)).alias("v"), F.max("of").alias("of")).where(F.col("v") >= LEAST_VOTES)
    if tried is not None:
        votes = votes.join(tried, ["a", "b"], "left_anti")
    return saved(votes.groupBy("b").agg(F.max(F.struct("v", "of", "a")).alias("best")).select("best.a", "b"), "pairs")


class Part:
    """Members of a part of a group: the union of their shingles, in blocks of some CELLS cells, and who has which."""

    def __init__(self, members: list[tuple[int, int, np.ndarray]]):
        self.blocks, own, size = [], [], 0
        for node, comp, tokens in [*members, (None, None, None)]:
            if own and (node is None or (size + len(tokens)) * (len(own) + 1) > CELLS):
                sizes = np.array([len(t) for *_, t in own])
                union, place = np.unique(np.concatenate([t for *_, t in own]), return_inverse=True)
                has = np.zeros((len(union), len(own)), bool)
                has[place, np.repeat(np.arange(len(own)), sizes)] = True
                self.blocks.append((*np.array([k[:2] for k in own]).T, sizes, union, has))
                own, size = [], 0
            if node is not None:
                own.append((node, comp, tokens))
                size += len(tokens)

    def links(self, comp: int, tokens: np.ndarray, percent: int) -> list[int]:
        """The members of other components that link to a set."""
        out: list[int] = []
        for nodes, comps, sizes, union, has in self.blocks:
            at = np.minimum(np.searchsorted(union, tokens), len(union) - 1)
            at = at[union[at] == tokens]
            if len(at) >= least_shared(len(tokens), percent):  # else closed
                both = has[at].sum(axis=0)
                out += nodes[(100 * both >= percent * (len(tokens) + sizes - both)) & (comps != comp)].tolist()
        return out


def _matrix_links(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): nodes and the members that they link to of the parts that they open."""

    def run(batches):
        import pyarrow as pa

        from limen.llm.jaccard import Part

        key, members, part = None, [], None
        for batch in batches:
            a, b = [], []
            for *at, asks, node, comp, tokens in zip(*(batch.column(i).to_pylist() for i in range(6)), batch.column(6)):
                tokens = np.frombuffer(tokens.as_py(), np.uint64)
                if at != key:
                    key, members, part = at, [], None
                if not asks:
                    members.append((node, comp, tokens))
                    continue
                part = part or Part(members)
                found = part.links(comp, tokens, percent)
                a += [node] * len(found)
                b += found
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    nodes = saved(left.select("comp", "node").distinct(), "open-nodes")
    sizes = saved(nodes.groupBy("comp").agg(F.count(F.lit(1)).alias("size")), "sizes")
    # similar nodes: those that one of high score gathers, by its tokens and by those of the gathered
    held, own = left.select("token", "node"), left.select("token", "node", F.struct("score", "node").alias("top"))
    for _ in range(2):
        tops = saved(own.groupBy("token").agg(F.max("top").alias("top")), "tops")
        best = saved(held.join(tops, "token").groupBy("node").agg(F.max("top").alias("top")), "best")
        own = held.join(best, "node")
    lead = best.select("node", F.col("top.node").alias("lead"))
    gathered = saved(lead.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("parts")), "gathered")
    placed = lead.join(gathered, "lead").select("node", "lead", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"))
    placed = saved(placed.join(nodes, "node").join(sizes, "comp"), "placed")
    parted = saved(left.select("token", "node").join(placed, "node"), "parted")
    rank = F.struct("size", "comp")
    matrix = saved(parted.groupBy("token", "lead", "part").agg(F.max(rank).alias("top")), "matrix")
    met = parted.select("token", "node", rank.alias("rank")).join(matrix, "token").where("rank < top")
    asked = saved(met.select("node", "lead", "part").distinct(), "asked")
    tasks = saved(asked.groupBy("lead", "part").agg(F.ceil(F.count(F.lit(1)) / ASKS).cast("int").alias("tasks")), "tasks")
    members = placed.select("lead", "part", "node").join(tasks, ["lead", "part"])
    members = members.select("lead", "part", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), F.lit(0).alias("asks"), "node")
    asking = asked.join(tasks, ["lead", "part"]).select("lead", "part", F.pmod(F.xxhash64("node"), "tasks").cast("int").alias("task"), F.lit(1).alias("asks"), "node")
    roles = saved(members.unionByName(asking), "roles")
    rows = roles.join(_passing(sets, "node", roles).join(nodes, "node"), "node").select("lead", "part", "task", "asks", "node", "comp", "tokens")
    return rows.repartition("lead", "part", "task").sortWithinPartitions("lead", "part", "task", "asks").mapInArrow(run, "a long, b long")


def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = PERCENT) -> DataFrame:
    """Per row: id_col, n_shingles, component_id."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))

    path = work_dir(spark, "sets")
    first = saved(_sets(rows, n, bands_for(percent)), "sets", path)
    shared = _shared(first)
    whole = saved(first.select("id", "n", "node"), "whole")
    remove(spark, path)
    nodes = saved(whole.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("rep")), "nodes")
    reps = saved(nodes.join(shared.select("node").distinct(), "node", "left_semi").select("node", F.col("rep").alias("id")), "reps")
    sets = saved(_node_sets(rows, reps, n), "node-sets")
    release(spark)

    comp, links, tried, left = None, None, None, shared.withColumn("comp", F.col("node"))
    for _ in range(LEADER_ROUNDS):
        pairs = _leader_pairs(left, tried)
        found = saved(_compared(pairs, sets, percent), "found")
        release(spark)
        if found.isEmpty():
            break
        links = found if links is None else links.unionByName(found)
        tried = pairs if tried is None else tried.unionByName(pairs)
        comp = components(links)
        left = _unsettled(_with_comp(shared, comp))
    found = saved(_matrix_links(left, sets, percent), "found")
    release(spark)
    if not found.isEmpty():
        links = found if links is None else links.unionByName(found)
        comp = components(links)

    named = nodes.withColumn("comp", F.col("node")) if comp is None else _with_comp(nodes, comp)
    named = saved(named, "named")
    least = saved(named.groupBy("comp").agg(F.min("rep").alias("component_id")), "least")
    of = saved(named.join(least, "comp").select("node", "component_id"), "of")
    found = whole.where("node IS NOT NULL").join(of, "node").select("id", "n", "component_id")
    alone = whole.where("node IS NULL").select("id", "n", F.col("id").alias("component_id"))
    return found.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that have the smallest id of their component, all columns. Ids are taken as unique: rows
    that repeat an id go if one of them does."""
    found = similar_sets(docs, id_col, text_col, n, percent)
    own = F.col(id_col).eqNullSafe(F.col("component_id"))
    gone = found.where(~own).select(F.col(id_col)).distinct().select(F.struct(F.col(id_col).alias("id")).alias("key"))
    # compared as structs: no name of docs can clash, and null ids compare as well
    return docs.join(gone, F.struct(docs[id_col].alias("id")) == gone["key"], "left_anti")
