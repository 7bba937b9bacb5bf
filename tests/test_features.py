"""Features by type against a dense, sequential computation."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from limen.operators.features import features_by_type

WINDOW, NEAR, FDR, COLLINEAR, SHARE = 100, 20, 0.2, 0.5, 0.10


def r_of(x, y):
    x, y = x - x.mean(), y - y.mean()
    d = math.sqrt((x @ x) * (y @ y))
    return float(x @ y) / d if d > 1e-9 else 0.0


def dense(rna, atac, genes, peaks, chosen):
    n = rna.shape[1]
    shown = [g for g in range(len(genes)) if (rna[g] > 0).sum() >= SHARE * n]
    tests = []
    for g in shown:
        hits = [k for k, (c, m) in enumerate(peaks) if c == genes[g][0] and genes[g][1] - WINDOW <= m < genes[g][1] + WINDOW]
        if len(hits) >= 2:
            tests += [(g, k, r_of(np.log1p(rna[g]), np.log1p(atac[k]))) for k in hits]
    p = [math.erfc(abs(c) * math.sqrt((n - 2) / (1 - c * c)) / math.sqrt(2)) for _, _, r in tests for c in [max(-0.999999, min(0.999999, r))]]
    cut = max([x for i, x in enumerate(sorted(p), 1) if x <= FDR * i / len(p)], default=-1)
    linked = [(g, k, r) for (g, k, r), x in zip(tests, p) if x <= cut]
    red = {}
    for g in {t[0] for t in tests}:
        kept = []
        for _, k, _ in sorted((t for t in linked if t[0] == g), key=lambda t: (-abs(t[2]), f"p{t[1]:03d}")):
            if all(abs(r_of(np.log1p(atac[k]), np.log1p(atac[o]))) <= COLLINEAR for o in kept):
                kept.append(k)
        red[g] = len(kept)
    acc = atac.sum(axis=1).astype(float)
    acc = acc[acc > 0] / acc.sum()
    sub = [v for g, v in red.items() if g in chosen]
    far = [abs(peaks[k][1] - genes[g][1]) > NEAR for g, k, _ in linked]
    return dict(redundancy=np.median(list(red.values())), redundancy_mean=np.mean(list(red.values())), n_genes_tested=len(red), n_links=len(linked), distal_frac=np.mean(far) if far else None,
                entropy=-(acc * np.log(acc)).sum(), n_expressed=len(shown), redundancy_subset=np.median(sub) if sub else None, n_subset_genes=len(sub))


def test_features(spark):
    rng = np.random.default_rng(1)
    genes = [("ab"[g % 2], random.Random(g).randint(0, 900)) for g in range(30)]
    peaks = [("ab"[k % 2], random.Random(100 + k).randint(0, 900)) for k in range(90)]
    expected, rna_rows, atac_rows, sizes = {}, [], [], []
    for t, n in (("x", 40), ("y", 60), ("z", 25)):
        drive = rng.poisson(1.0, (30, n))
        rna = drive * (rng.random((30, n)) < 0.8)
        rna[:3] = 0
        atac = np.stack([(drive[k % 30] if t != "z" else rng.poisson(1.0, n)) * (rng.random(n) < 0.7) + (rng.random(n) < 0.1) for k in range(90)])
        atac[5] = 1
        expected[t] = dense(rna, atac, genes, peaks, {4, 6, 8, 10})
        sizes.append((t, n))
        rna_rows += [(t, c, f"g{g:02d}", int(rna[g, c])) for g in range(30) for c in range(n) if rna[g, c] or c == 0]
        atac_rows += [(t, c, f"p{k:03d}", int(atac[k, c])) for k in range(90) for c in range(n) if atac[k, c]]
    assert expected["x"]["n_links"] > 10
    df = spark.createDataFrame
    out = features_by_type(
        df(rna_rows, "celltype string, cell long, gene string, value long").repartition(4), df(atac_rows, "celltype string, cell long, peak string, value long").repartition(4),
        df([(f"g{g:02d}", c, t) for g, (c, t) in enumerate(genes)], "gene string, chrom string, tss long"), df([(f"p{k:03d}", c, m) for k, (c, m) in enumerate(peaks)], "peak string, chrom string, mid long"),
        df(sizes, "celltype string, n long"), WINDOW, NEAR, FDR, COLLINEAR, SHARE, F.col("gene").isin("g04", "g06", "g08", "g10"),
    )
    got = {r.celltype: r.asDict() for r in out.collect()}
    assert set(got) == set(expected)
    for t, e in expected.items():
        for k, v in e.items():
            assert got[t][k] == (pytest.approx(v) if v is not None else None), (t, k)
