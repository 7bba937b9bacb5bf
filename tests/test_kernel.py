"""The JVM's counts of marked pairs: against hashlib, against the arrays that serve without a JVM, and asked once."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from limen.functions import kernel
from limen.operators import pairs as P
from limen.plans import added, catalogue as K, more, rest
from test_pairs import NEAR, W, tables  # noqa: F401

BAND, CLOSE = [1, 0, 0, 1], [False, True, True, False]


@pytest.mark.parametrize("own, other", [(3, 3), (4, 5), (13, 7), (14, 1), (1, 4), (50, 5), (50, 6), (70, 4)])
def test_marked(spark, own, other):
    """Steps that one side decides, words that both share, several chunks, and keys longer than a block."""
    assert kernel.registered(spark)
    rng = np.random.default_rng(own)
    rows, cols, marks = 5, 1100, [("", 40, 15), ("null|3|", 18, 18), ("ab", 100, 0)]
    heads, tails = (["".join(map(chr, rng.integers(97, 123, n))).encode() for _ in range(k)] for n, k in ((own, rows), (other, cols)))
    ends, codes = np.sort(rng.integers(0, cols + 1, (rows, 5)), 1).astype("<i4"), rng.integers(0, 3, rows).astype("<i4")
    ends[0] = ends[0, 0]
    given = [b"".join(heads), b"".join(tails), ends.tobytes(), codes.tobytes(), kernel.shape(rows, cols, own, other, 3, 2, BAND, CLOSE, marks), b"".join(p.encode() for p, *_ in marks)]
    want = {}
    for i in range(rows):
        for k in range(4):
            for j in range(ends[i, k], ends[i, k + 1]):
                w = want.setdefault((int(codes[i]), BAND[k]), [0] * 4)
                w[0] += 1
                for m, (p, close, far) in enumerate(marks):
                    w[1 + m] += int(hashlib.md5(p.encode() + heads[i] + tails[j]).hexdigest()[:8], 16) % 100 < (close if CLOSE[k] else far)
    got = spark.range(1).select(F.call_function(kernel.NAME, *[F.lit(bytearray(x)) for x in given]).alias("x")).first().x
    assert {(r[0], r[1]): list(r[2:]) for r in got} == want


def test_arrays_without_a_jvm(tables, monkeypatch):  # noqa: F811
    _, _, g, p = tables
    counts = lambda: sorted(map(repr, P.pair_counts(g, p, W, [0, NEAR, 20], [("", 40, 15), ("null|3|", 18, 18)], NEAR).groupBy("chrom", "g", "p", "d").agg(F.sum("n"), *[F.sum(F.col("marked")[k]) for k in range(2)]).collect()))
    fast = counts()
    monkeypatch.setattr(kernel, "registered", lambda spark: False)
    assert counts() == fast


@pytest.mark.parametrize("query", [K.distance_bands, K.g_statistic, K.odds_two_backgrounds, K.jackknife_chrom, more.positional_or_vs_null, added.null_stability_summary, added.ladder_weighted_fit, rest.ladder_rising_fit, rest.link_summary_depth])
def test_pairs_are_hashed_once_in_the_jvm(spark, query):
    """Before: arrays of a Python worker, at ten times the time a pair."""
    plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(f"{kernel.NAME}(") == 1
