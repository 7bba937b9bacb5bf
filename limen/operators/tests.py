"""Test statistics and calibration measures as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from limen.functions.numeric import student_two_sided
from limen.operators.ranges import weighted_cut


def welch(df: DataFrame, value: str, grp: str, a: str, b: str, *by: str) -> DataFrame:
    """t and Satterthwaite's degrees of freedom of two groups; p by the incomplete beta function."""
    of = lambda g: F.when(F.col(grp) == g, F.col(value))
    s = df.groupBy(*by).agg(*[f(of(g)).alias(f"{n}{i}") for i, g in ((1, a), (2, b)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    e1, e2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    s = s.where("n1 > 1 AND n2 > 1 AND v1 + v2 > 0")
    out = s.select(*by, "n1", "n2", ((F.col("m1") - F.col("m2")) / F.sqrt(e1 + e2)).alias("t"), ((e1 + e2) ** 2 / (e1**2 / (F.col("n1") - 1) + e2**2 / (F.col("n2") - 1))).alias("df"))
    return out.withColumn("p_value", student_two_sided("t", "df"))


def chi2_yates(tables: DataFrame) -> DataFrame:
    """Adds chi2 of 2 x 2 tables (a, b, c, d) with the continuity correction."""
    n = F.col("a") + F.col("b") + F.col("c") + F.col("d")
    off = F.greatest(F.lit(0.0), F.abs(F.col("a") * F.col("d") - F.col("b") * F.col("c")) - n / 2.0)
    rows = (F.col("a") + F.col("b")) * (F.col("c") + F.col("d")) * (F.col("a") + F.col("c")).cast("double") * (F.col("b") + F.col("d"))
    return tables.withColumn("chi2", F.when(rows > 0, n * off * off / rows))


#: Ranges that ranks are counted in.
RANGES = 256


def _below(df: DataFrame, value: str, first: Column, *by: str) -> DataFrame:
    """(by, value, _p, _q, _below) of each distinct value: its rows of the first group, its others, and the rows with
    smaller values. Places are counted within ranges and the totals of the ranges, RANGES a group, are added: no task
    sees all rows. Nulls come first and NaN last."""
    t = df.groupBy(*by, value).agg(F.count_if(first).alias("_p"), F.count_if(~first).alias("_q"))
    cuts = df.agg(F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], 10000)).first()[0] or []
    inside = F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c < F.col(value)) if cuts else F.array()
    t = t.withColumn("_k", F.size(inside))
    n = F.col("_p") + F.col("_q")
    earlier = lambda what, w: F.coalesce(F.sum(what).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = t.groupBy(*by, "_k").agg(F.sum(n).alias("_n"))
    starts = sizes.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_k").alias("_at"), earlier("_n", Window.partitionBy(*by).orderBy("_k")).alias("_start"))
    on = F.col("_k") == F.col("_at")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    t = t.withColumn("_inner", earlier(n, Window.partitionBy(*by, "_k").orderBy(value)))
    return t.join(starts, on).select(*by, value, "_p", "_q", (F.col("_inner") + F.col("_start")).alias("_below"))


def _rank_totals(df: DataFrame, value: str, first: Column, *by: str) -> DataFrame:
    """(by, rs, n1, n0, tie): sum of the first group's average ranks, both sizes, and what ties take off."""
    n = F.col("_p") + F.col("_q")
    s = _below(df, value, first, *by).groupBy(*by)
    return s.agg(F.sum(F.col("_p") * (F.col("_below") + (n + 1) / 2.0)).alias("rs"), F.sum("_p").alias("n1"), F.sum("_q").alias("n0"), F.sum(n * (n.cast("double") ** 2 - 1)).alias("tie"))


def rank_sum(df: DataFrame, value: str, grp: str, first: str, *by: str) -> DataFrame:
    """U of the first group, and z with corrections for ties and continuity; z is null where all values tie."""
    s = _rank_totals(df, value, F.col(grp).eqNullSafe(first), *by)
    n = F.col("n1") + F.col("n0")
    s = s.withColumn("u", F.col("rs") - F.col("n1") * (F.col("n1") + 1) / 2.0)
    off = F.col("u") - F.col("n1") * F.col("n0") / 2.0
    sd = F.sqrt(F.col("n1") * F.col("n0") / 12.0 * ((n + 1) - F.try_divide(F.col("tie"), n * (n - 1.0))))
    return s.select(*by, "n1", "n0", "u", F.try_divide(off - F.signum(off) * 0.5, sd).alias("z"))


def auroc(df: DataFrame, label: str, score: str, *by: str) -> DataFrame:
    """Area under the curve from average ranks; null for one class."""
    s = _rank_totals(df, score, F.col(label).eqNullSafe(1), *by)
    return s.select(*by, "n1", "n0", F.when((F.col("n1") > 0) & (F.col("n0") > 0), (F.col("rs") - F.col("n1") * (F.col("n1") + 1) / 2.0) / (F.col("n1") * F.col("n0"))).alias("auroc"))


def calibration_bins(df: DataFrame, label: str, score: str, bins: int = 10, least: int = 10) -> DataFrame:
    """(bin, n, mean_score, mean_label): equal bins, the last one closed, those with fewer rows than least go."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(label).alias("mean_label")).where(F.col("n") >= least)


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    return bins.agg((F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("mean_label"))) / F.sum("n")).alias("ece"))


def shifted_prior(calibration: DataFrame, target: DataFrame, label: str = "y", score: str = "s", cut: float = 0.5) -> DataFrame:
    """Prior of class 1 in the target from the joint confusion matrix of the calibration rows (2 x 2 solve); the
    calibration prior if the matrix is singular; clipped to 0 and 1."""
    hit = F.col(score) >= cut
    j = lambda y, h: F.avg(F.when((F.col(label) == y) & (hit if h else ~hit), 1.0).otherwise(0.0))
    c = calibration.agg(j(0, False).alias("c00"), j(1, False).alias("c01"), j(0, True).alias("c10"), j(1, True).alias("c11"))
    m = target.agg(F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("mu1"))
    det = F.col("c00") * F.col("c11") - F.col("c01") * F.col("c10")
    w1 = (F.col("c00") * F.col("mu1") - F.col("c10") * (1 - F.col("mu1"))) / F.nullif(det, F.lit(0.0))
    prior = F.col("c01") + F.col("c11")
    return c.crossJoin(m).select(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.abs(det) > 1e-9, w1 * prior).otherwise(prior))).alias("prior"), "mu1")


def conformal_thresholds(df: DataFrame, label: str, nonconformity: str, alpha: float, tie: str) -> DataFrame:
    """Per class the k-th smallest nonconformity, k = ceil((n + 1)(1 - alpha)), n at most."""
    w = Window.partitionBy(label)
    r = df.withColumns({"_k": F.row_number().over(w.orderBy(nonconformity, tie)), "_n": F.count(F.lit(1)).over(w)})
    k = F.least(F.ceil((F.col("_n") + 1) * (1 - alpha)), F.col("_n"))
    return r.where(F.col("_k") == k).select(label, F.col("_n").alias("n"), F.col(nonconformity).alias("threshold"))


def weighted_conformal_thresholds(df: DataFrame, label: str, nonconformity: str, weight: str, alpha: float, tie: str) -> DataFrame:
    """Per class the nonconformity at which the weights, in order, first reach 1 - alpha of their sum and one mean
    weight more (the point at infinity, for the row to be predicted); the largest one where they do not. A class
    without rows has no line: its threshold is 1 where sets are made."""
    return weighted_cut(df, label, nonconformity, tie, weight, 1 - alpha, F.avg(weight))


def em_prior(scores: DataFrame, source_prior: float, score: str = "s", tolerance: float = 1e-8, most: int = 1000) -> tuple[float, int]:
    """Class prior of the target by expectation-maximisation on posterior scores: a driver loop of one-row sums."""
    kept = scores.select(F.col(score).alias("s")).persist()
    q, steps = source_prior, 0
    try:
        while steps < most:
            up, down = F.lit(q / source_prior) * F.col("s"), F.lit((1 - q) / (1 - source_prior)) * (1 - F.col("s"))
            new = kept.agg(F.avg(up / (up + down))).first()[0]
            steps += 1
            if new is None or abs(new - q) < tolerance:
                q = q if new is None else new
                break
            q = new
    finally:
        kept.unpersist()
    return q, steps


def variance_explained(df: DataFrame, value: str, group: str) -> DataFrame:
    """Eta squared: variance between groups over total variance."""
    g = df.groupBy(group).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss"))
    t = g.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    mean = F.col("s") * F.col("s") / F.col("n")
    return t.select(((F.col("b") - mean) / (F.col("ss") - mean)).alias("eta_squared"))
