"""Sums over drawn donors, made in blocks and shares: against every draw, one by one."""

import hashlib
from collections import defaultdict

import pytest

from limen.operators import composition as C


def drawn(stats, n_boot, prefix):
    rows = [stats[d] for d in sorted(stats)]
    for rep in range(n_boot):
        at = [int(hashlib.md5(f"{prefix}{rep}|{i}".encode()).hexdigest()[:8], 16) % len(rows) for i in range(len(rows))]
        yield rep, [sum(rows[k][c] for k in at) for c in range(2)]


@pytest.mark.parametrize("block, draws, chunk", [(1 << 18, 10**7, 1 << 14), (7, 60, 16)])
def test_sums_of_draws(spark, monkeypatch, block, draws, chunk):
    for name, value in (("BLOCK", block), ("DRAWS", draws), ("CHUNK", chunk)):
        monkeypatch.setattr(C, name, value)
    rows = [(k % 2, 1000 - 3 * k, k * 0.5, k) for k in range(60)] + [(None, 5, 2.0, 1), (None, 6, 1.0, 3)]
    per = spark.createDataFrame(rows, "cohort int, donor long, ss double, m long")
    by = defaultdict(dict)
    for c, d, ss, m in rows:
        by[c][d] = (ss, m)
    found = C.resampled_sums(per, 12, 4, "cohort")
    got = {(r.cohort, r.rep): [r.ss, r.m] for r in found.collect()}
    want = {(c, rep): s for c, stats in by.items() for rep, s in drawn(stats, 12, "4|" if c is None else f"4|{c}|")}
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    one = per.where("cohort = 1").drop("cohort")
    assert {r.rep: [r.ss, r.m] for r in C.resampled_sums(one, 9, 0).collect()} == {k: pytest.approx(v) for k, v in drawn(by[1], 9, "0|")}


def test_a_draw_is_no_row(spark):
    """Before, all draws were rows that one task made and joined."""
    pairs = spark.createDataFrame([(k, "a", 0.5, 10.0, 0.1) for k in range(30)], "donor long, celltype string, p double, n_eff double, z double")
    plan = C.kappa_bootstrap(pairs, 50)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "Window [row_number" not in plan and "Range (" not in plan
