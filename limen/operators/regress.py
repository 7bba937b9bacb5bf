"""Least squares with several regressors from aggregated cross products, and bootstraps that reuse them.

All that a fit needs are the sums of products of its columns, a few dozen numbers; a bootstrap over donors weighs each
donor's sums, so its cost does not grow with the observations. Systems are solved on the driver, one for each replicate.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limen.functions.numeric import hash_number
from limen.operators.composition import indexed_donors, multiplicities
from limen.sources.scratch import written


def cross_products(df: DataFrame, y: Column, xs: list[Column], *by: str) -> DataFrame:
    """(by, s0, s1, ...): sums of products of (1, xs, y), the upper triangle row by row."""
    terms = [F.lit(1.0), *[x.cast("double") for x in xs], y.cast("double")]
    rows = df.select(*by, *[t.alias(f"_t{i}") for i, t in enumerate(terms)]).dropna()
    pairs = [(a, b) for a in range(len(terms)) for b in range(a, len(terms))]
    return rows.groupBy(*by).agg(*[F.sum(F.col(f"_t{a}") * F.col(f"_t{b}")).alias(f"s{i}") for i, (a, b) in enumerate(pairs)])


def coefficients(sums: np.ndarray) -> np.ndarray:
    """Intercept and slopes for each row of cross products; of least size where columns depend on each other."""
    sums = np.atleast_2d(sums)
    n = int((np.sqrt(8 * sums.shape[1] + 1) - 1) / 2)
    full = np.zeros((len(sums), n, n))
    a, b = np.triu_indices(n)
    full[:, a, b] = full[:, b, a] = sums
    inner, right = full[:, :-1, :-1], full[:, :-1, -1:]
    # columns of like size: what is nearly dependent is told from what is merely small
    size = np.sqrt(np.maximum(np.einsum("kii->ki", inner), 1e-300))
    scaled = inner / size[:, :, None] / size[:, None, :]
    return (np.linalg.pinv(scaled, rcond=1e-11, hermitian=True) @ (right / size[:, :, None]))[:, :, 0] / size


def least_squares(df: DataFrame, y: Column, xs: list[Column]) -> np.ndarray:
    """Intercept and slopes of y on xs; NaN without rows."""
    row = cross_products(df, y, xs).first()
    return coefficients(np.array(row, float))[0] if row[0] is not None else np.full(len(xs) + 1, np.nan)


def without(sums: np.ndarray, gone: int) -> np.ndarray:
    """Cross products without the last ``gone`` regressors."""
    sums = np.atleast_2d(sums)
    n = int((np.sqrt(8 * sums.shape[1] + 1) - 1) / 2)
    left = [i for i in range(n) if not n - 1 - gone <= i < n - 1]
    return sums[:, [k for k, (a, b) in enumerate(zip(*np.triu_indices(n))) if a in left and b in left]]


def donor_sums(df: DataFrame, y: Column, xs: list[Column], n_boot: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(cross products of all rows, n_boot rows of them from donors drawn with replacement)."""
    per = written(cross_products(df, y, xs, "donor"), "products")
    names = [c for c in per.columns if c != "donor"]
    drawn = multiplicities(indexed_donors(per), n_boot, seed).join(per, "donor")
    found = drawn.groupBy("rep").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in names]).orderBy("rep").select(*names).collect()
    whole = per.agg(*[F.sum(c) for c in names]).first()
    return np.array([x if x is not None else np.nan for x in whole], float), np.array([tuple(r) for r in found], float).reshape(len(found), len(names))


def dummies(column: str, df: DataFrame) -> list[Column]:
    """Columns for all values of column but the first; its values are few by design."""
    values = sorted(r[0] for r in df.select(column).distinct().collect() if r[0] is not None)
    return [F.when(F.col(column) == v, 1.0).otherwise(0.0) for v in values[1:]]


def abundance_scaling(pairs: DataFrame, cls: str, n_boot: int, seed: int = 0) -> dict:
    """pairs (donor, celltype, z, p, n_eff, and the class): the exponent of kappa in abundance, alone and beside
    dummies of the class, with intervals by donors; then, by type, the slope of ln(kappa^2 - 1) on ln(N p / (1 - p)),
    which is 1 if the relative error is constant, that error, and the spreads of kappa and of it."""
    d = written(pairs.where("p > 0 AND p < 1 AND z > 0 AND n_eff > 0").select("donor", "celltype", "z", "p", "n_eff", cls), "pairs")
    kappa2 = F.col("z") * F.col("z") / (2 / F.col("n_eff"))
    out: dict = {}
    classes = dummies(cls, d)
    whole, drawn = donor_sums(d, F.ln(kappa2) / 2, [F.ln("p"), *classes], n_boot, seed)
    for name, gone in (("gamma", len(classes)), ("gamma_adj_class", 0)):
        if np.isnan(whole).any():
            out |= {name: np.nan, f"{name}_lo": np.nan, f"{name}_hi": np.nan}
            continue
        b = coefficients(without(drawn, gone))[:, 1]
        b = b[np.isfinite(b)]
        lo, hi = np.percentile(b, [2.5, 97.5]) if len(b) >= 50 else (np.nan, np.nan)
        out |= {name: coefficients(without(whole, gone))[0, 1], f"{name}_lo": lo, f"{name}_hi": hi}
    per = d.groupBy("celltype").agg(F.avg(kappa2).alias("kap2"), F.avg("n_eff").alias("n"), F.avg("p").alias("p"))
    use = per.where("kap2 > 1.02").withColumns({"x": F.ln(F.col("n") * F.col("p") / (1 - F.col("p"))), "y": F.ln(F.col("kap2") - 1)})
    types = use.select("kap2", "x", "y").collect()  # a row a category
    n = d.agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("celltype").alias("types")).first()
    out |= {"n_pairs": n["pairs"], "n_celltypes": n["types"], "n_celltypes_used": len(types)}
    slope, inter = (lambda c: (c[1], c[0]))(least_squares(use, F.col("y"), [F.col("x")])) if len(types) >= 4 else (np.nan, np.nan)
    k, c = np.sqrt([r["kap2"] for r in types]), np.exp([(r["y"] - r["x"]) / 2 for r in types])
    spread = lambda v: v.max() / v.min() if len(v) else np.nan
    sd = lambda v: np.log(v).std(ddof=1) if len(v) > 1 else np.nan
    out |= {"model_slope": slope, "c_implied": np.exp(inter / 2), "c_median": np.median(c) if len(c) else np.nan}
    return out | {"kappa_spread": spread(k), "c_spread": spread(c), "sd_log_kappa": sd(k), "sd_log_c": sd(c)}


def calibration_curve(rows: DataFrame, n_boot: int, x: str = "n_eff", y: str = "floor", seed: int = 0, least_rows: int = 5, least_fits: int = 50) -> DataFrame:
    """For every number of donors from 1 to all: n_fits and the quantiles of coefficient and exponent of y = a x^b over
    n_boot draws of so many donors, and the half-width of the coefficient's interval over its value on all rows.

    A replicate draws one sequence of donors; its sums run along the sequence and so serve every number at once."""
    lx, ly = F.ln(x), F.ln(y)
    at = rows.agg(F.avg(lx).alias("m")).first()["m"] or 0.0  # logarithms about their mean: sums keep their digits
    off = lx - at
    per = rows.groupBy("donor").agg(F.count(F.lit(1)).alias("m"), F.sum(off).alias("sx"), F.sum(ly).alias("sy"), F.sum(off * off).alias("sxx"), F.sum(off * ly).alias("sxy"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    donors = indexed_donors(per)
    grid = donors.select("n", (F.col("i") + 1).alias("n_donors")).join(F.broadcast(rows.sparkSession.range(n_boot).withColumnRenamed("id", "rep")), F.lit(True))
    picks = grid.withColumn("i", hash_number(F.lit(seed), F.col("rep"), F.col("n_donors")) % F.col("n"))
    drawn = picks.join(F.broadcast(donors.select("i", "donor").join(per, "donor")), "i")  # a row a donor
    from pyspark.sql.window import Window

    w = Window.partitionBy("rep").orderBy("n_donors").rowsBetween(Window.unboundedPreceding, 0)
    run = drawn.select("rep", "n_donors", *[F.sum(c).over(w).alias(c) for c in ("m", "sx", "sy", "sxx", "sxy")], F.min("lo").over(w).alias("lo"), F.max("hi").over(w).alias("hi"))
    b = F.try_divide(F.expr("m * sxy - sx * sy"), F.expr("m * sxx - sx * sx"))
    fits = run.where((F.col("m") >= least_rows) & (F.col("lo") < F.col("hi"))).withColumn("b", b).withColumn("a", F.exp(F.expr("(sy - b * sx) / m") - F.col("b") * at))
    whole = rows.agg(F.regr_slope(ly, off).alias("b"), F.avg(ly).alias("y")).select(F.exp(F.col("y") - F.col("b") * at).alias("a")).first()["a"]
    q = lambda c, p: F.percentile(c, p)
    out = fits.groupBy("n_donors").agg(
        F.count("b").alias("n_fits"), q("a", 0.5).alias("coef_median"), q("a", 0.025).alias("coef_lo"), q("a", 0.975).alias("coef_hi"),
        q("b", 0.5).alias("exponent_median"), q("b", 0.025).alias("exponent_lo"), q("b", 0.975).alias("exponent_hi"),
    )
    return out.where(F.col("n_fits") >= least_fits).withColumn("coef_rel_halfwidth", F.expr("(coef_hi - coef_lo) / 2") / F.lit(whole))


def least_donors(curve: DataFrame, tolerances: tuple[float, ...] = (0.10, 0.20, 0.30)) -> DataFrame:
    """(tolerance, least_donors): the least number of donors whose half-width is within; null if none is."""
    each = curve.agg(*[F.min(F.when(F.col("coef_rel_halfwidth") <= t, F.col("n_donors"))).alias(f"t{i}") for i, t in enumerate(tolerances)])
    return each.select(F.explode(F.array(*[F.struct(F.lit(t).alias("tolerance"), F.col(f"t{i}").alias("least_donors")) for i, t in enumerate(tolerances)])).alias("r")).select("r.*")
