"""Pairs of genes and peaks counted inside tiles: against all pairs, one by one."""

import hashlib
import os
import subprocess
import sys
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from limen.functions.hashing import Crossed, Joined
from limen.operators import pairs as P
from limen.plans import added, catalogue as K, models, rest

W, NEAR = 50, 6


def bits(key):
    return int(hashlib.md5(key.encode()).hexdigest()[:8], 16)


@pytest.fixture
def tables(spark):
    rng = np.random.default_rng(3)
    genes = [("a" * int(rng.integers(1, 70)) + str(k), c, int(t), None if k % 9 == 0 else k % 4) for k, (c, t) in enumerate(zip(rng.choice(list("xy"), 60), rng.integers(0, 400, 60)))]
    peaks = [(int(i), c, int(t), k % 3) for k, (i, c, t) in enumerate(zip(rng.integers(0, 10**6, 300), rng.choice(list("xyz"), 300), rng.integers(-50, 450, 300)))]
    peaks += [(7, "x", t, 1) for t in (100, 100, 130)] + [(None, "y", 90, 0), (5, None, 1, 1), (6, "x", None, 1)]
    return genes, peaks, spark.createDataFrame(genes, "gene string, chrom string, tss long, g long"), spark.createDataFrame(peaks, "peak long, chrom string, mid long, p int")


def met(genes, peaks):
    for gene, c, tss, g in genes:
        for peak, c2, mid, p in peaks:
            if c == c2 and mid is not None and tss - W <= mid < tss + W:
                yield gene, c, g, "" if peak is None else peak, p, mid - tss


def test_hash_numbers():
    for heads, tails in (([b"ab|", b"xy|"], [b"12345", b"99999"]), ([b"h" * 55], [b""]), ([b"h" * 50], [b"123456"])):
        i, j = np.indices((len(heads), len(tails))).reshape(2, -1)
        assert Joined(heads, tails).numbers(i, j).tolist() == [bits((heads[a] + tails[b]).decode()) for a, b in zip(i, j)]


def test_hash_numbers_of_blocks():
    """Words and steps that one side decides, words that both share, and keys longer than a block."""
    for head, tail in ((3, 3), (4, 5), (13, 7), (0, 4), (14, 0), (50, 5), (50, 6)):
        heads, tails = [bytes([97 + k]) * head for k in range(3)], [bytes([48 + k]) * tail for k in range(5)]
        got = Crossed(heads, tails).numbers(1, 3, 1, 5, np.empty((6, 64), np.uint32))
        assert got.tolist() == [[bits((h + t).decode()) for t in tails[1:]] for h in heads[1:]]


def test_last_line_of_room_is_free():
    """Whoever takes the numbers may use it for their remainders."""
    for head, tail in ((3, 3), (0, 4), (13, 7), (40, 6)):
        room = np.empty((6, 64), np.uint32)
        got = Crossed([b"a" * head, b"b" * head], [bytes([48 + k]) * tail for k in range(5)]).numbers(0, 2, 1, 5, room)
        assert np.shares_memory(got, room) and not np.shares_memory(got, room[5])


@pytest.mark.parametrize("rows, wide", [(1, 1), (1, 64), (3, 64), (5, 13), (7, 129)])
def test_between(rows, wide):
    rng = np.random.default_rng(wide)
    hit = rng.random((rows, wide)) < 0.4
    ends = np.sort(rng.integers(0, wide + 1, (rows, 6)), axis=1)
    ends[:, 0], ends[:, -1] = 0, wide
    assert P._between(hit, ends).tolist() == [[int(h[a:b].sum()) for a, b in zip(e, e[1:])] for h, e in zip(hit, ends)]


def test_marks_are_counted_in_bits():
    """Before: a running sum of four bytes for each pair and limit."""
    hit = np.ones((8, 1 << 13), bool)
    ends = np.tile(np.array([0, 100, 1 << 13]), (8, 1))
    P._between(hit, ends)
    tracemalloc.start()
    try:
        assert P._between(hit, ends).sum() == hit.size
        assert tracemalloc.get_traced_memory()[1] < hit.size
    finally:
        tracemalloc.stop()


def test_counts_in_small_blocks(tables, monkeypatch):
    monkeypatch.setattr(P, "ROOM", 40)
    test_counts(tables, monkeypatch, (P.GENES, P.PEAKS))


@pytest.mark.parametrize("query", [added.line_slope_seeds, added.link_summary_flags, models.odds_ratio_binomial, rest.jackknife_summary])
def test_pairs_are_met_once(spark, query):
    """What asks for the counts several times reads them from a table (before: each time met all pairs anew)."""
    plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") < 2


@pytest.mark.parametrize("sizes", [(P.GENES, P.PEAKS), (7, 11)])
def test_counts(tables, monkeypatch, sizes):
    genes, peaks, g, p = tables
    monkeypatch.setattr(P, "CHUNK", 100)
    tiles = P._tiles
    monkeypatch.setattr(P, "_tiles", lambda a, b, w, most=None: tiles(a, b, w, sizes))
    marks = [("", 40, 15), ("null|3|", 18, 18)]
    want, n = Counter(), Counter()
    for gene, c, gc, peak, pc, d in met(genes, peaks):
        key = c, gc, pc, 0 if abs(d) < NEAR else 1 if abs(d) < 20 else 2
        n[key] += 1
        for k, (pre, close, far) in enumerate(marks):
            want[key, k] += bits(f"{pre}{gene}|{peak}") % 100 < (close if abs(d) < NEAR else far)
    rows = P.pair_counts(g, p, W, [0, NEAR, 20], marks, NEAR).groupBy("chrom", "g", "p", "d").agg(F.sum("n").alias("n"), *[F.sum(F.col("marked")[k]).alias(f"m{k}") for k in range(2)]).collect()
    assert {tuple(r)[:4]: r.n for r in rows} == dict(n)
    assert all(r[f"m{k}"] == want[tuple(r)[:4], k] for r in rows for k in range(2))
    found = P.near_counts(g, p, W, [(-W, True, W, False), (-NEAR, False, NEAR, True)], "gene").groupBy("gene").agg(*[F.sum(F.col("near")[k]) for k in range(2)]).collect()
    all_, few = Counter(), Counter()
    for gene, _, _, _, _, d in met(genes, peaks):
        all_[gene] += 1
        few[gene] += -NEAR < d <= NEAR
    assert {r[0]: (r[1], r[2]) for r in found if r[1]} == {k: (v, few[k]) for k, v in all_.items()}


def test_linked(tables):
    genes, peaks, g, p = tables
    want = Counter()
    for gene, _, _, peak, _, d in met(genes, peaks):
        h = bits(f"{gene}|{peak}") % 100
        if h < 40:
            want[gene, peak if peak != "" else None, abs(d) < NEAR, h < (40 if abs(d) < NEAR else 15)] += 1
    assert Counter(tuple(r) for r in P.linked_pairs(g, p, W, ("", 40, 15), NEAR).collect()) == want


def test_ids_that_stand_twice(spark, tmp_path):
    """A pair that is a link in one of its rows is kept in all of them."""
    e = spark.range(400).select((F.col("id") % 40).alias("event_id"), F.timestamp_seconds(1700000000 + F.col("id") * 53).alias("ts"), (F.col("id") % 6 * 2).alias("user_id"), F.lit("view").alias("event_type"))
    e.write.parquet(str(tmp_path / "events.parquet"))
    first, rows = {}, e.selectExpr("event_id", "unix_seconds(ts) s", "user_id").collect()
    for r in rows:
        first[r.user_id] = min(first.get(r.user_id, r.s), r.s)
    all_ = [(f"view-{u}", r.event_id, abs(r.s - t) < K.NEAR) for u, t in first.items() for r in rows if -K.WINDOW <= r.s - t < K.WINDOW]
    links = {(g, p) for g, p, near in all_ if bits(f"{g}|{p}") % 100 < (40 if near else 15)}
    got = Counter(tuple(r) for r in added.restrict_to_tested(spark, str(tmp_path)).collect())
    assert got == Counter(x for x in all_ if x[:2] in links) and len(links) < len(got)


@pytest.mark.parametrize("query", [K.mh_pooled_or, K.distance_bands, K.window_cv, added.null_stability_summary, added._ladder, added.restrict_to_tested, rest.band_genes_tested])
def test_pairs_stay_in_tiles(spark, query):
    """Pairs are met by arrays in a tile (before: a join with a row for each)."""
    plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "mid" not in "".join(x for x in plan.splitlines() if "Join" in x)


def test_executors_need_no_copy():
    """What tasks are given names no module of this package."""
    from pyspark import cloudpickle

    from limen.functions import hashing

    for f in (P._met, hashing.Joined):
        code = "import pickle, sys; pickle.loads(sys.stdin.buffer.read())"
        subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(f), cwd="/", env={"PATH": os.environ["PATH"]}, check=True)


def test_links_are_not_shuffled(spark):
    """Pairs are joined with no table of ids (before: all of them were shuffled where the ids were too many to broadcast)."""
    plan = added.restrict_to_tested(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    first, *others = plan.split("FlatMapCoGroupsInArrow")
    assert len(others) == 3 and "Join" not in first and plan.count("LeftSemi") == 1
