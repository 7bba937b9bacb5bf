"""The manifest against trees built whole, with blocks small enough for several tables of them."""

import hashlib
import random
import zlib

import pytest

pytest.importorskip("limen.llm")

from limen.llm import merkle  # noqa: E402
from limen.llm.queries import MANIFEST_FIELDS  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, path string, root string, g string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def framed(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def siblings(levels, i):
    for nodes in levels[:-1]:
        first = i // 8 * 8
        yield "".join(nodes[first:i]), "".join(nodes[i + 1 : first + 8])
        i //= 8


def whole(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    leaf = lambda r, t: sha("".join(map(framed, (r[0], r[3], r[2], r[4], t))))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
    trees = {g: tree([leaf(r, r[1]) for r in groups[g]]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for at, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            path = [*siblings(trees[g], i), *siblings(top, at)]
            node = leaf(r, r[1])
            if r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                node = leaf(r, r[1].translate(low))
            for a, b in path:
                node = sha(a + node + b)
            out.append((r[0], leaf(r, r[1]), trees[g][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), node, node == top[-1][0]))
    return sorted(map(str, out))


def check(spark, rows, levels):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3) if rows else spark.createDataFrame([], SCHEMA)
    out = merkle.verified_manifest(df, MANIFEST_FIELDS, merkle.lowered_text_leaf(MANIFEST_FIELDS), levels=levels)
    got = sorted(str((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified)) for r in out.collect())
    assert got == whole(rows)


def documents(n, langs, seed=0):
    rng = random.Random(seed)
    return [(i, rng.choice(["", None, "Some TEXT é", "low", "X" * rng.randint(1, 300)]), rng.choice(langs), rng.choice(["a", None, "7:x"]), rng.choice([None, i]), "p", "r", "g") for i in range(n)]


@pytest.mark.parametrize("n, langs", [(0, ["en"]), (1, [None]), (8, ["en"]), (9, ["en"]), (65, ["en"]), (700, ["en", "", None, "é", "z"])])
def test_equals_whole_trees(spark, n, langs):
    check(spark, documents(n, langs), 1)


def test_blocks_of_two_levels_and_many_groups(spark):
    check(spark, documents(900, [f"l{i}" for i in range(20)] + ["big"] * 20, 4), 2)


def test_null_repeated_and_equal_rows(spark):
    rows = documents(30, ["en", None], 5)
    check(spark, [*rows, *rows, *[(None, *r[1:]) for r in rows[:9]], *[rows[3]] * 200], 1)


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 200, 512])
def test_walk_holds_few_nodes(n):
    leaves = [sha(str(i)) for i in range(n)]
    levels = tree(leaves)
    assert merkle.levels_of(n) == len(levels) - 1
    assert merkle.block_root(leaves, len(levels) - 1) == levels[-1][0]
    for i, path in enumerate(merkle.walk(leaves, len(levels) - 1)):
        assert path == list(siblings(levels, i))


def test_stack_is_logarithmic():
    stack, most = merkle.TreeHash([sha(str(i)) for i in range(4096)], 4), 0
    for _ in range(4096):
        stack.step()
        most = max(most, sum(map(len, stack.open)))
    assert most <= 4 * 7


def test_tampering_is_seen_and_long_text(spark):
    check(spark, [(i, "Long " * 400_000 if i == 3 else "A", "en", None, None, "p", "r", "g") for i in range(12)], 4)
