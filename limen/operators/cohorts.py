"""Cohorts and ladders: kappa by cohort, differences of exponents, abundance models, saturation, null stability,
weighted fits, power, conformal sets. Tables with a row a category, rung or donor are small by design."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from limen.functions.numeric import correlation, hash_number
from limen.operators import expression as X
from limen.operators import tests as T
from limen.operators.composition import ratio, resampled_sums, rms

#: Added to |z| before its logarithm: pairs without any difference stay.
TINY = 1e-12
_SUMS = ("sx", "sy", "sz", "sxx", "sxy", "sxz")


def kappa_of_cohorts(pairs: DataFrame, cohort: str) -> DataFrame:
    """Kappa and the exponent of |z| in n_eff of each cohort."""
    return pairs.groupBy(cohort).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("donor").alias("n_donors"), rms(ratio()).alias("kappa"), F.regr_slope(F.ln(F.abs("z") + TINY), F.ln("n_eff")).alias("exponent")
    )


def kappa_intervals(pairs: DataFrame, cohort: str, n_boot: int, seed: int = 0) -> DataFrame:
    """Kappa of each cohort with its interval by donors of the cohort, drawn with replacement."""
    per = pairs.groupBy(cohort, "donor").agg(F.sum(ratio() * ratio()).alias("ss"), F.count(F.lit(1)).alias("m"))
    k = resampled_sums(per, n_boot, seed, cohort).select(cohort, "rep", F.sqrt(F.col("ss") / F.col("m")).alias("k"))
    ci = k.groupBy(cohort).agg(F.percentile("k", 0.025).alias("lo"), F.percentile("k", 0.975).alias("hi"))
    seen = per.groupBy(cohort).agg(F.sqrt(F.sum("ss") / F.sum("m")).alias("kappa"), F.sum("m").alias("n_pairs"), F.count(F.lit(1)).alias("n_donors"))
    return seen.join(ci, cohort)


def type_rms_interval(by_type: DataFrame, n_boot: int, seed: int = 0) -> DataFrame:
    """by_type (celltype, kappa): the root mean square of the types' kappas and its interval by types drawn with
    replacement. Every type counts alike, however many pairs it has."""
    every = Window.partitionBy()  # a row a type
    placed = by_type.select((F.row_number().over(Window.orderBy("celltype")) - 1).alias("i"), F.count(F.lit(1)).over(every).alias("n"), (F.col("kappa") * F.col("kappa")).alias("k2"))
    drawn = placed.select("n", F.col("i").alias("_draw"), F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("rep"))
    drawn = drawn.withColumn("i", (hash_number(F.lit(seed), "rep", "_draw") % F.col("n")).cast("int"))
    k = drawn.join(F.broadcast(placed.select("i", "k2")), "i").groupBy("rep").agg(F.sqrt(F.avg("k2")).alias("k"))
    ci = k.agg(F.percentile("k", 0.025).alias("lo"), F.percentile("k", 0.975).alias("hi"))
    return placed.agg(F.sqrt(F.avg("k2")).alias("kappa_rms_of_types"), F.count(F.lit(1)).alias("n_types")).crossJoin(ci)  # one row each


def exponent_difference(one: DataFrame, other: DataFrame, n_boot: int, seeds: tuple[int, int] = (0, 1)) -> DataFrame:
    """Exponent of one cohort minus that of the other, its interval and two-sided p by donors drawn independently."""
    sized = [d.withColumn("size", F.abs("z") + TINY) for d in (one, other)]
    first, second = (X.slope_bootstrap(d, n_boot, s, y="size") for d, s in zip(sized, seeds))
    d = first.join(second.withColumnRenamed("b", "b2"), "rep").select((F.col("b") - F.col("b2")).alias("d"))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    drawn = d.agg(F.percentile("d", 0.025).alias("lo"), F.percentile("d", 0.975).alias("hi"), (2 * F.least(share(F.col("d") <= 0), share(F.col("d") >= 0))).alias("p_two_sided"))
    slope = lambda df, name: df.agg(F.regr_slope(F.ln("size"), F.ln("n_eff")).alias(name))
    seen = slope(sized[0], "b1").crossJoin(slope(sized[1], "b2")).select((F.col("b1") - F.col("b2")).alias("difference"))
    return seen.crossJoin(drawn)  # one row each


def paired_slopes(df: DataFrame, y: str, z: str, n_boot: int, x: str = "n_eff", seed: int = 0) -> DataFrame:
    """(rep, difference): slope of ln y minus slope of ln z, both on the same resample of donors."""
    a, b, c = F.ln(x), F.ln(y), F.ln(z)
    per = df.groupBy("donor").agg(F.count(F.lit(1)).alias("m"), *[F.sum(e).alias(k) for k, e in zip(_SUMS, (a, b, c, a * a, a * b, a * c))])
    s = {k: F.col(k) for k in ("m", *_SUMS)}
    below = F.nullif(s["m"] * s["sxx"] - s["sx"] * s["sx"], F.lit(0.0))
    slope = lambda side: (s["m"] * s["sx" + side] - s["sx"] * s["s" + side]) / below
    return resampled_sums(per, n_boot, seed).select("rep", (slope("y") - slope("z")).alias("difference"))


def abundance_model(types: DataFrame, cls: Column) -> DataFrame:
    """types (kappa, mean_fraction): slope of ln kappa on ln p, alone and within classes (what dummies for the classes
    leave), slope of ln(kappa^2 - 1) on the log odds of p, spread of ln kappa."""
    t = types.select(F.ln("kappa").alias("y"), F.ln("mean_fraction").alias("x"), cls.alias("cls"), F.when(F.col("kappa") > 1, F.ln(F.col("kappa") ** 2 - 1)).alias("over"), F.ln(F.col("mean_fraction") / (1 - F.col("mean_fraction"))).alias("odds"))
    w = Window.partitionBy("cls")
    t = t.withColumns({"cy": F.col("y") - F.avg("y").over(w), "cx": F.col("x") - F.avg("x").over(w)})
    within = F.try_divide(F.sum(F.col("cx") * F.col("cy")), F.sum(F.col("cx") * F.col("cx")))
    return t.agg(F.regr_slope("y", "x").alias("gamma"), within.alias("gamma_class"), F.regr_slope("over", "odds").alias("over_slope"), F.stddev_samp("y").alias("sd_ln_kappa"))


def saturation(libraries: DataFrame, n: str, links: str, depth: str, least: int = 8) -> DataFrame:
    """Slope of ln links on ln n over libraries, and the correlation that stays when depth is held fixed."""
    t = libraries.where((F.col(n) > 0) & (F.col(links) > 0) & (F.col(depth) > 0)).select(F.ln(n).alias("x"), F.ln(links).alias("y"), F.ln(depth).alias("z"))
    r = t.agg(F.count(F.lit(1)).alias("libraries"), F.regr_slope("y", "x").alias("b"), correlation("x", "y").alias("raw_r"), correlation("z", "y").alias("depth_r"))
    return r.crossJoin(X.partial_correlation(t, F.col("x"), F.col("y"), F.col("z"))).where(F.col("libraries") >= least)  # one row each


def umi_proxy(medians: DataFrame, least: int = 5) -> DataFrame:
    """medians (.., n1, n2, u1, u2): |log2| of two median depths. Not comparable with floors over genes."""
    u = [F.greatest(F.col(c), F.lit(1.0)) for c in ("u1", "u2")]
    return medians.where((F.col("n1") >= least) & (F.col("n2") >= least)).withColumn("proxy_floor", F.abs(F.log2(u[0] / u[1])))


def null_stability(repeats: DataFrame, by: str) -> DataFrame:
    """repeats (by, observed, null): odds ratios over repeated null pairings, and the observed one against them."""
    p = F.col("observed") / F.col("null")
    return repeats.groupBy(by).agg(
        F.first("observed").alias("observed_or"), F.median("null").alias("null_median"), F.min("null").alias("null_min"), F.max("null").alias("null_max"),
        (F.stddev_samp("null") / F.avg("null")).alias("null_cv"), F.median(p).alias("positional_median"), F.min(p).alias("positional_min"), F.max(p).alias("positional_max"), F.count(F.lit(1)).alias("n_reps"),
    )


def line_slope(strata: DataFrame, n_boot: int) -> DataFrame:
    """strata (n, seed, a, b, c, d) of the cells of a line: slope of the pooled ln odds ratio on ln n; its interval
    draws the seeds of each cell. A stratum with an empty cell gets a half in each."""
    h = F.when(F.least("a", "b", "c", "d") == 0, 0.5).otherwise(0.0)
    t = strata.select("n", "seed", *[(F.col(k) + h).alias(k) for k in "abcd"])
    total = F.col("a") + F.col("b") + F.col("c") + F.col("d")
    t = t.select("n", "seed", (F.col("a") * F.col("d") / total).alias("r"), (F.col("b") * F.col("c") / total).alias("s"))
    w = Window.partitionBy("n")
    t = t.withColumns({"i": F.row_number().over(w.orderBy("seed")) - 1, "k": F.count(F.lit(1)).over(w)})
    pooled, slope = F.ln(F.sum("r") / F.sum("s")).alias("l"), F.regr_slope("l", F.ln("n"))
    point = t.groupBy("n").agg(pooled).agg(slope.alias("slope"), F.count("l").alias("points"))
    reps = strata.sparkSession.range(n_boot).withColumnRenamed("id", "rep")
    picks = t.select("n", "i", "k").crossJoin(F.broadcast(reps)).select("n", "rep", (hash_number("rep", "n", "i") % F.col("k")).alias("i"))  # n_boot rows: a parameter
    drawn = picks.join(t, ["n", "i"]).groupBy("rep", "n").agg(pooled).groupBy("rep").agg(slope.alias("b"))
    return point.crossJoin(drawn.agg(F.percentile("b", 0.025).alias("lo"), F.percentile("b", 0.975).alias("hi")))  # one row each


def weighted_ladder(points: DataFrame, target: float, least_n: float = 0) -> DataFrame:
    """points (n, log_or, se): line of log_or on ln n with weights 1 / se^2, and ln n where it meets 1 and the target;
    least_n: where the rising arm begins, rungs below it are left out."""
    t = points.where(F.col("n") >= least_n).select(F.ln("n").alias("x"), F.col("log_or").alias("y"), (1 / (F.col("se") * F.col("se"))).alias("w"))
    s = t.agg(*[F.sum(e).alias(k) for k, e in (("w", F.col("w")), ("x", F.col("w") * F.col("x")), ("y", F.col("w") * F.col("y")), ("xx", F.col("w") * F.col("x") ** 2), ("xy", F.col("w") * F.col("x") * F.col("y")))], correlation("x", "y").alias("r"))
    s = s.withColumn("b", F.expr("(w * xy - x * y) / nullif(w * xx - x * x, 0)")).withColumn("a", F.expr("(y - b * x) / w"))
    return s.select("a", "b", "r", (-F.col("a") / F.col("b")).alias("ln_n_at_1"), ((math.log(target) - F.col("a")) / F.col("b")).alias("ln_n_at_target"))


def link_summary(found: DataFrame, by: str = "n") -> DataFrame:
    """found (n or another measure, odds_ratio, lo, hi): how many intervals exclude one, and how ln odds go with the
    logarithm of n, or of depth."""
    fine = (F.col(by) > 0) & (F.col("odds_ratio") > 0)
    x, y = F.when(fine, F.ln(by)), F.when(fine, F.ln("odds_ratio"))
    t = found.select("lo", "hi", x.alias("x"), y.alias("y"))
    return t.agg(F.count(F.lit(1)).alias("configs"), F.count_if(F.col("lo") > 1).alias("enriched"), F.count_if(F.col("hi") < 1).alias("depleted"), F.regr_slope("y", "x").alias("slope"), correlation("x", "y").alias("r"))


def power_curve(spark, odds: list[float], p0: float, background: float, points: int = 120) -> DataFrame:
    """z of an assumed odds ratio for 100 to 100,000 links on a logarithmic grid."""
    grid = spark.range(points).select(F.pow(F.lit(10.0), 2 + 3 * F.col("id") / (points - 1.0)).alias("n_link"))
    t = grid.withColumn("odds_ratio", F.explode(F.array(*[F.lit(float(o)) for o in odds])))
    t = t.withColumn("p1", F.col("odds_ratio") * p0 / (1 - p0 + F.col("odds_ratio") * p0))
    return t.withColumn("z", (F.col("p1") - p0) / F.sqrt(F.col("p1") * (1 - F.col("p1")) / F.col("n_link") + p0 * (1 - p0) / background))


def conformal_coverage(df: DataFrame, label: str, score: str, alpha: float, tie: str) -> DataFrame:
    """Sets from thresholds by class: share of rows whose set holds their label, by class too, and of sets of one."""
    misfit = F.when(F.col(label) == 1, 1 - F.col(score)).otherwise(F.col(score))
    q = T.conformal_thresholds(df.withColumn("_a", misfit), label, "_a", alpha, tie)
    of = lambda k: F.coalesce(F.max(F.when(F.col(label) == k, F.col("threshold"))), F.lit(1.0))  # noqa: E731  1 for a class without rows
    q = q.agg(of(0).alias("q0"), of(1).alias("q1"))
    t = df.crossJoin(F.broadcast(q)).withColumns({"in0": F.col(score) <= F.col("q0"), "in1": 1 - F.col(score) <= F.col("q1")})  # one row
    hit = F.when(F.col(label) == 1, F.col("in1")).otherwise(F.col("in0")).cast("double")
    by = lambda k: F.avg(F.when(F.col(label) == k, hit))
    return t.agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("coverage"), by(0).alias("coverage_0"), by(1).alias("coverage_1"), F.avg((F.col("in0") != F.col("in1")).cast("double")).alias("singleton_share"))


def domain_weights(df: DataFrame, domain: str, score: str, low: float = 0.05, high: float = 20.0) -> DataFrame:
    """Source rows (domain 0) with the ratio of densities that a discriminator's score implies, between low and high."""
    n = df.agg(F.count_if(F.col(domain) == 0).alias("_s"), F.count_if(F.col(domain) == 1).alias("_t"))
    odds = F.col(score) / F.greatest(1 - F.col(score), F.lit(1e-6))
    w = F.least(F.lit(high), F.greatest(F.lit(low), odds * F.col("_s") / F.greatest(F.col("_t"), F.lit(1))))
    return df.where(F.col(domain) == 0).crossJoin(F.broadcast(n)).withColumn("weight", w).drop("_s", "_t")  # one row
