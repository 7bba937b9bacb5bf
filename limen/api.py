"""The packaged estimators: from input tables to floors, intervals and design tables.

Only sums per donor come to the driver (donors are the units of a study, a few dozen); the resampling runs on those,
with the generator of the seed, so that published intervals are reproduced to the digit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limen.config import Settings
from limen.operators import composition as C
from limen.operators import expression as X
from limen.validate import reject_rows, require_columns


@dataclass(frozen=True)
class CompositionResult:
    kappa: float
    lo: float
    hi: float
    n_pairs: int
    n_donors: int
    abundance_r: float | None
    by_type: DataFrame

    def summary(self) -> str:
        r = "" if self.abundance_r is None else f"; r with ln share {self.abundance_r:.2f}"
        return f"kappa {self.kappa:.3f} [{self.lo:.3f}, {self.hi:.3f}] over {self.n_pairs} pairs, {self.n_donors} donors{r}"


@dataclass(frozen=True)
class ExpressionResult:
    a: float
    b: float
    lo: float
    hi: float
    n_obs: int
    median_n_eff: float

    def threshold(self, n: float) -> float:
        return self.a * n**self.b

    def summary(self) -> str:
        return f"floor {self.a:.2f} * n^{self.b:.3f} [{self.lo:.3f}, {self.hi:.3f}] over {self.n_obs} observations"


def check_composition(df: DataFrame) -> DataFrame:
    require_columns(df, ["donor", "celltype"], "composition")
    if {"n1", "n2"} <= set(df.columns):
        return reject_rows(df, (F.col("n1") < 0) | (F.col("n2") < 0), "negative counts")
    require_columns(df, ["z", "n_eff"], "composition")
    return reject_rows(df, F.col("n_eff") <= 0, "n_eff must be positive")


def check_expression(df: DataFrame) -> DataFrame:
    require_columns(df, ["donor", "celltype", "n_eff", "floor"], "expression")
    return reject_rows(df, (F.col("n_eff") <= 0) | (F.col("floor") <= 0), "n_eff and floor must be positive")


def kept_pairs(df: DataFrame, least: int = 50) -> DataFrame:
    """Rows of donors whose two libraries are both large enough, where counts are there to tell."""
    if {"n1", "n2"} <= set(df.columns):
        return C.pair_criterion(df, least).where("included_in_fit").drop("included_in_fit")
    return df


def _draws(n: int, s: Settings) -> np.ndarray:
    """How often each of n donors is drawn in each replicate."""
    rng = np.random.default_rng(s.seed)
    return np.stack([np.bincount(rng.integers(0, n, n), minlength=n) for _ in range(s.n_boot)])


def _interval(x: np.ndarray) -> tuple[float, float]:
    x = x[np.isfinite(x)]
    return (float(np.percentile(x, 2.5)), float(np.percentile(x, 97.5))) if len(x) else (float("nan"), float("nan"))


def estimate_composition(df: DataFrame, s: Settings = Settings()) -> CompositionResult:
    placed = check_composition(df).withColumn("_at", F.monotonically_increasing_id())
    first = placed.groupBy("donor").agg(F.min("_at").alias("_at"))
    z = C.composition_input(kept_pairs(df, s.min_cells))
    per = z.groupBy("donor").agg(F.sum(C.ratio() * C.ratio()).alias("ss"), F.count(F.lit(1)).alias("m")).join(first, "donor").orderBy("_at").collect()
    if not per:
        raise ValueError("no usable pairs")
    ss, m = np.array([r["ss"] for r in per]), np.array([r["m"] for r in per], float)
    w = _draws(len(per), s)
    lo, hi = _interval(np.sqrt(w @ ss / (w @ m)))
    by_type = C.kappa_by(z, "celltype")
    one, r = C.kappa(z).first(), C.abundance_correlation(by_type).first()
    return CompositionResult(one["kappa"], lo, hi, one["n_pairs"], one["n_donors"], r["abundance_r"], by_type.orderBy(F.col("kappa").desc()))


def estimate_expression(df: DataFrame, s: Settings = Settings(), min_n_eff: float | None = None) -> ExpressionResult:
    rows = kept_pairs(check_expression(df), s.min_cells).where(F.col("n_eff") >= (s.min_n_eff if min_n_eff is None else min_n_eff))
    law = X.power_law(rows, "n_eff", "floor").first()
    if law is None or law["n_obs"] < 5:
        raise ValueError("fewer than five observations")
    per = X.slope_sums(rows).orderBy("donor").collect()
    v = {c: _draws(len(per), s) @ np.array([r[c] for r in per], float) for c in ("m", "sx", "sy", "sxx", "sxy")}
    with np.errstate(divide="ignore", invalid="ignore"):
        b = np.where(v["m"] >= 5, (v["m"] * v["sxy"] - v["sx"] * v["sy"]) / (v["m"] * v["sxx"] - v["sx"] ** 2), np.nan)
    lo, hi = _interval(b)
    return ExpressionResult(law["a"], law["b"], lo, hi, law["n_obs"], law["median_x"])
