"""Logistic regression over all rows by iterated weighted least squares, and what it is used for.

Every fit's normal equations are sums over its rows. One step is one aggregate for all fits at once: rows meet the
weights of the fits that they train (a broadcast table of as many rows as fits, or fits squared where groups are left
out), and the sums of products, a few hundred numbers a fit, are solved on the driver. No row is sampled or left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limen.sources.scratch import written

#: Rows of the broadcast table of weights at most: a fit for each of 1,000 groups that leaves one of them out.
MOST_PLANS = 1_000_000


@dataclass
class Fit:
    """Weights (intercept first) for features less means, over deviations; None where one class only trains."""

    group: str | None
    weights: np.ndarray | None
    means: np.ndarray
    deviations: np.ndarray
    rows: int
    steps: int = 0


def _key(group: str | None) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")) if group else F.lit("")


def _moments(rows: DataFrame, d: int) -> dict[str, tuple]:
    """{key: (n, n of label 1, means, sums of squares about them)}."""
    each = [F.avg(f"x{i}") for i in range(d)] + [F.var_pop(f"x{i}") for i in range(d)]
    found = rows.groupBy("key").agg(F.count(F.lit(1)), F.sum("y"), *each).collect()
    return {r[0]: (r[1], r[2], np.array(r[3 : 3 + d], float), r[1] * np.array(r[3 + d :], float)) for r in found}


def _joined(parts: list[tuple], d: int) -> tuple:
    n, ones, mean, about = 0, 0.0, np.zeros(d), np.zeros(d)
    for k, one, m, a in parts:
        apart = m - mean
        about = about + a + apart**2 * n * k / (n + k)
        mean, n, ones = mean + apart * k / (n + k), n + k, ones + one
    return n, ones, mean, about


def fit_logistic(df: DataFrame, features: list[str], label: str, group: str | None = None, leave_out: bool = False, ridge: float = 1.0, per_row: bool = False, ddof: int = 1, steps: int = 60, tolerance: float = 1e-10) -> list[Fit]:
    """One fit for each group (none: one), on its rows or, with leave_out, on those of all others.

    Features are standardised by the rows that train (a constant one by 1). The optimum is that of the summed log
    loss and ridge / 2 times the squared weights but the intercept's; per_row: ridge for each row. Rows with a null
    feature or label train nothing."""
    d = len(features)
    x = [F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]
    rows = written(df.select(_key(group).alias("key"), F.col(label).cast("double").alias("y"), *x).dropna(), "logistic")
    moments = _moments(rows, d)
    keys = sorted(r[0] for r in df.select(_key(group).alias("key")).distinct().collect()) if group else [""]
    trains = {k: [j for j in moments if (j != k) == leave_out] for k in keys}
    fits: dict[str, Fit] = {}
    for k in keys:
        n, ones, mean, about = _joined([moments[j] for j in trains[k]], d)
        spread = np.sqrt(about / max(n - ddof, 1))
        spread[spread == 0] = 1.0
        fits[k] = Fit(k[1:] if k else None, np.zeros(d + 1) if 0 < ones < n else None, mean, spread, n)
    if sum(len(t) for t in trains.values()) > MOST_PLANS:
        raise ValueError(f"{len(keys)} groups are too many to fit at once")
    open_fits = {k for k in keys if fits[k].weights is not None}
    loss_before = {k: np.inf for k in keys}
    held = {k: f.weights for k, f in fits.items()}
    for _ in range(steps):
        if not open_fits:
            break
        sums = _normal_equations(rows, {k: fits[k] for k in open_fits}, trains, d)
        for k in list(open_fits):
            f, (loss, slope, curve) = fits[k], sums[k]
            f.steps += 1
            penalty = np.diag([0.0] + [ridge * (f.rows if per_row else 1)] * d)
            loss = loss + f.weights @ penalty @ f.weights / 2
            if loss > loss_before[k] + 1e-9 * abs(loss_before[k]):  # too far: half the way
                f.weights = (f.weights + held[k]) / 2
                continue
            move = np.linalg.solve(curve + penalty + 1e-12 * np.eye(d + 1), slope - penalty @ f.weights)
            loss_before[k], held[k] = loss, f.weights
            f.weights = f.weights + move
            if np.abs(move).max() < tolerance:
                open_fits.discard(k)
    return [fits[k] for k in keys]


def _table(rows: DataFrame, fits: dict[str, Fit], trains: dict[str, list[str]]) -> DataFrame:
    listed = [(j, k, *(list(map(float, a)) for a in (f.weights, f.means, f.deviations))) for k, f in fits.items() if f.weights is not None for j in trains[k]]
    return rows.sparkSession.createDataFrame(listed, "key string, fit string, w array<double>, m array<double>, s array<double>")


def _chance(z: list[Column]) -> Column:
    eta = F.col("w")[0]
    for i, c in enumerate(z):
        eta = eta + F.col("w")[i + 1] * c
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), eta))))


def _normal_equations(rows: DataFrame, fits: dict[str, Fit], trains: dict[str, list[str]], d: int) -> dict[str, tuple]:
    """{fit: (loss, slope, curvature)} at the present weights: one aggregate."""
    met = rows.join(F.broadcast(_table(rows, fits, trains)), "key")
    z = [((F.col(f"x{i}") - F.col("m")[i]) / F.col("s")[i]) for i in range(d)]
    met = met.select("fit", "y", "w", *[c.alias(f"z{i + 1}") for i, c in enumerate(z)])
    met = met.withColumn("p", _chance([F.col(f"z{i + 1}") for i in range(d)])).withColumn("z0", F.lit(1.0)).withColumn("v", F.col("p") * (1 - F.col("p")))
    pairs = [(a, b) for a in range(d + 1) for b in range(a, d + 1)]
    loss = F.sum(-F.when(F.col("y") > 0.5, F.ln("p")).otherwise(F.ln(1 - F.col("p"))))
    slope = [F.sum((F.col("y") - F.col("p")) * F.col(f"z{a}")) for a in range(d + 1)]
    curve = [F.sum(F.col("v") * F.col(f"z{a}") * F.col(f"z{b}")) for a, b in pairs]
    out = {}
    for r in met.groupBy("fit").agg(loss, *slope, *curve).collect():
        h = np.zeros((d + 1, d + 1))
        for (a, b), x in zip(pairs, r[3 + d :]):
            h[a, b] = h[b, a] = x
        out[r[0]] = (r[1], np.array(r[2 : 3 + d]), h)
    return out


def score_logistic(df: DataFrame, fits: list[Fit], features: list[str], group: str | None = None, name: str = "p") -> DataFrame:
    """df with the chance of label 1 by its group's fit; null where the fit has none or a feature is null."""
    by = {("" if f.group is None else f"={f.group}"): f for f in fits}
    table = _table(df, by, {k: [k] for k in by}).withColumnsRenamed({"key": "_key", "fit": "_fit"})
    packed = table.select("_key", F.struct("w", "m", "s").alias("_w"))
    z = [(F.col(f).cast("double") - F.col("_w.m")[i]) / F.col("_w.s")[i] for i, f in enumerate(features)]
    eta = F.col("_w.w")[0]
    for i, c in enumerate(z):
        eta = eta + F.col("_w.w")[i + 1] * c
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), eta))))
    met = df.withColumn("_key", _key(group)).join(F.broadcast(packed), "_key", "left")
    return met.withColumn(name, F.when(eta.isNotNull(), p)).drop("_key", "_w")


def domain_ratio(source: DataFrame, target: DataFrame, features: list[str], l2: float = 1e-2, low: float = 0.05, high: float = 20.0) -> DataFrame:
    """source with d (the chance of the target domain by a discriminator fitted on all rows of both) and weight, the
    ratio of densities that it implies, between low and high."""
    both = source.select(*features, F.lit(0).alias("_domain")).unionByName(target.select(*features, F.lit(1).alias("_domain")))
    [fit] = fit_logistic(both, features, "_domain", ridge=l2, per_row=True, ddof=0)
    n = both.groupBy("_domain").count().collect()
    n = {r["_domain"]: r["count"] for r in n}
    odds = F.col("d") / F.greatest(1 - F.col("d"), F.lit(1e-6))
    ratio = odds * (n.get(0, 0) / max(n.get(1, 0), 1))
    return score_logistic(source, [fit], features, name="d").withColumn("weight", F.when(F.col("d").isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), ratio))))
