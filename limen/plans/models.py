"""Queries of models and exact distributions: full replicate numbers, every number of donors, every group."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from limen.functions.numeric import rounded
from limen.operators import composition as C
from limen.operators import exact as E
from limen.operators import regress as R
from limen.operators import tests as T
from limen.plans import catalogue as K
from limen.plans.catalogue import query, shown
from limen.plans.domain import COUNTS, GENES, read
from limen.sources.scratch import written

N_BOOT = 2000


# --- calibration by donors ---------------------------------------------------------------------------------------

_CURVE = f"""WITH {COUNTS}, obs AS (SELECT donor, n_eff, ln(n_eff) - avg(ln(n_eff)) OVER () AS x, ln(floor) AS y, avg(ln(n_eff)) OVER () AS centre FROM fl),
per AS (SELECT donor, count(*) AS m, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, min(n_eff) AS lo, max(n_eff) AS hi, any_value(centre) AS centre FROM obs GROUP BY 1),
dn AS (SELECT donor, row_number() OVER (ORDER BY donor) - 1 AS i, count(*) OVER () AS n FROM per),
dr AS (SELECT rep, dn.i + 1 AS k, cast(('0x' || substr(md5(concat('0|', rep, '|', dn.i + 1)), 1, 8)) AS BIGINT) % n AS i FROM dn, range({N_BOOT}) t(rep)),
ru AS (SELECT rep, k, sum(m) OVER w AS m, sum(sx) OVER w AS sx, sum(sy) OVER w AS sy, sum(sxx) OVER w AS sxx, sum(sxy) OVER w AS sxy, min(lo) OVER w AS lo, max(hi) OVER w AS hi, centre
 FROM dr JOIN dn USING (i) JOIN per USING (donor) WINDOW w AS (PARTITION BY rep ORDER BY k ROWS UNBOUNDED PRECEDING)),
ft AS (SELECT k, b, exp((sy - b * sx) / m - b * centre) AS a FROM (SELECT *, (m * sxy - sx * sy) / (m * sxx - sx * sx) AS b FROM ru WHERE m >= 5 AND lo < hi)),
wh AS (SELECT exp(avg(y) - regr_slope(y, x) * any_value(centre)) AS a FROM obs),
cv AS (SELECT k AS n_donors, count(b) AS n_fits, median(a) AS coef_median, quantile_cont(a, 0.025) AS coef_lo, quantile_cont(a, 0.975) AS coef_hi,
 median(b) AS exponent_median, quantile_cont(b, 0.025) AS exponent_lo, quantile_cont(b, 0.975) AS exponent_hi FROM ft GROUP BY k HAVING count(b) >= 50),
cc AS (SELECT *, (coef_hi - coef_lo) / 2 / wh.a AS coef_rel_halfwidth FROM cv, wh)"""
#: Coefficients of few donors range over many powers of ten: their logarithms are shown.
_LOGS = ["coef_median", "coef_lo", "coef_hi", "coef_rel_halfwidth"]
_PLAIN = ["exponent_median", "exponent_lo", "exponent_hi"]
_SHOWN = ", ".join([f"round(ln({c}), 5) AS ln_{c}" for c in _LOGS] + [f"round({c}, 5) AS {c}" for c in _PLAIN])


def _curve(spark, sf):
    return R.calibration_curve(K._floors(spark, sf), N_BOOT)


@query(f"{_CURVE} SELECT cast(n_donors AS BIGINT) AS n_donors, n_fits, {_SHOWN} FROM cc")
def calibration_requirement(spark, sf):
    """Every number of donors, 2,000 replicates."""
    return _curve(spark, sf).select(F.col("n_donors").cast("long").alias("n_donors"), "n_fits", *[rounded(F.ln(c), 5).alias(f"ln_{c}") for c in _LOGS], *[rounded(c, 5).alias(c) for c in _PLAIN])


@query(f"{_CURVE} SELECT tolerance, cast(min(n_donors) FILTER (coef_rel_halfwidth <= tolerance) AS BIGINT) AS least_donors FROM cc, (VALUES (0.1::DOUBLE), (0.2), (0.3)) t(tolerance) GROUP BY 1")
def calibration_least_donors(spark, sf):
    t = R.least_donors(_curve(spark, sf))
    return t.select("tolerance", F.col("least_donors").cast("long").alias("least_donors"))


# --- abundance ---------------------------------------------------------------------------------------------------

_TYPES = f"""pr AS (SELECT l_suppkey % 40 AS donor, concat(l_returnflag, '-', l_linenumber) AS celltype, count(*) FILTER (l_orderkey % 2 = 0) AS n1, count(*) FILTER (l_orderkey % 2 = 1) AS n2 FROM lineitem GROUP BY 1, 2),
pt AS (SELECT *, sum(n1) OVER (PARTITION BY donor) AS t1, sum(n2) OVER (PARTITION BY donor) AS t2 FROM pr),
d AS (SELECT donor, left(celltype, 1) AS cls, celltype, p, 2.0 / (1.0 / t1 + 1.0 / t2) AS n_eff, abs(n1 / t1 - n2 / t2) / sqrt(p * (1 - p)) AS z
 FROM (SELECT *, (n1 + n2) / (t1 + t2) AS p FROM pt WHERE t1 >= 50 AND t2 >= 50) WHERE p > 0 AND p < 1 AND n1 / t1 <> n2 / t2),
o AS (SELECT donor, cls, ln(p) AS x, ln(z * z / (2 / n_eff)) / 2 AS y FROM d),
per AS (SELECT donor, cls, count(*) AS m, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM o GROUP BY 1, 2), {K._MULT.format(per="per", b=N_BOOT)},
ww AS (SELECT rep, donor, cast(w AS DOUBLE) AS w FROM mu UNION ALL SELECT -1, donor, 1.0 FROM (SELECT DISTINCT donor FROM per)),
cw AS (SELECT rep, cls, sum(w * m) AS m, sum(w * sx) AS sx, sum(w * sy) AS sy, sum(w * sxx) AS sxx, sum(w * sxy) AS sxy FROM ww JOIN per USING (donor) GROUP BY 1, 2),
g AS (SELECT rep, (sum(m) * sum(sxy) - sum(sx) * sum(sy)) / (sum(m) * sum(sxx) - sum(sx) * sum(sx)) AS g0, sum(sxy - sx * sy / m) / sum(sxx - sx * sx / m) AS g1 FROM cw GROUP BY 1),
ty AS (SELECT celltype, avg(z * z / (2 / n_eff)) AS k2, avg(n_eff) AS n, avg(p) AS p FROM d GROUP BY 1),
us AS (SELECT *, ln(n * p / (1 - p)) AS x, ln(k2 - 1) AS y, sqrt(k2) AS k, sqrt((k2 - 1) * (1 - p) / (n * p)) AS c FROM ty WHERE k2 > 1.02)"""


@query(f"""WITH {_TYPES} SELECT round(any_value(g0) FILTER (rep = -1), 5) AS gamma, round(quantile_cont(g0, 0.025) FILTER (rep >= 0), 5) AS gamma_lo, round(quantile_cont(g0, 0.975) FILTER (rep >= 0), 5) AS gamma_hi,
round(any_value(g1) FILTER (rep = -1), 5) AS gamma_adj_class, round(quantile_cont(g1, 0.025) FILTER (rep >= 0), 5) AS gamma_adj_class_lo, round(quantile_cont(g1, 0.975) FILTER (rep >= 0), 5) AS gamma_adj_class_hi,
(SELECT count(*) FROM d) AS n_pairs, (SELECT count(*) FROM ty) AS n_celltypes, u.* FROM g, (SELECT count(*) AS n_celltypes_used, CASE WHEN count(*) >= 4 THEN round(regr_slope(y, x), 5) END AS model_slope, CASE WHEN count(*) >= 4 THEN round(regr_intercept(y, x) / 2, 5) END AS ln_c_implied,
round(median(c), 5) AS c_median, round(max(k) / min(k), 5) AS kappa_spread, round(max(c) / min(c), 5) AS c_spread, round(stddev_samp(ln(k)), 5) AS sd_log_kappa, round(stddev_samp(ln(c)), 5) AS sd_log_c FROM us) u GROUP BY ALL""")
def abundance_scaling(spark, sf):
    """Exponents of kappa in abundance, alone and beside class dummies, with donor intervals of 2,000 replicates."""
    li = read(spark, sf, "lineitem")
    p = C.weighted_pairs(C.replicate_counts(li, F.col("l_suppkey") % 40, F.concat_ws("-", "l_returnflag", "l_linenumber"), F.col("l_orderkey") % 2))
    found = R.abundance_scaling(p.withColumn("cls", F.substring("celltype", 1, 1)), "cls", N_BOOT)
    found["ln_c_implied"] = np.log(found.pop("c_implied"))
    counted = {c: int(v) for c, v in found.items() if c.startswith("n_")}
    measured = {c: None if v != v else round(float(v), 5) + 0.0 for c, v in found.items() if c not in counted}
    schema = ", ".join([f"{c} long" for c in counted] + [f"{c} double" for c in measured])
    return spark.createDataFrame([(*counted.values(), *measured.values())], schema)


# --- exact distributions -----------------------------------------------------------------------------------------

_BINOM = f"""WITH {GENES}, {K._LINK}, tb AS (SELECT chrom, {K._ABCD} FROM lk GROUP BY 1),
t AS (SELECT *, cast(a + b AS BIGINT) AS n, (a + 0.5) / (a + b + 1.0) AS p FROM tb),
q AS (SELECT *, cast(greatest(0, floor(n * p - 10 * sqrt(n * p * (1 - p)) - 1)) AS BIGINT) AS low, least(n, cast(ceil(n * p + 10 * sqrt(n * p * (1 - p)) + 1) AS BIGINT)) AS high FROM t WHERE n > 0),
pt AS (SELECT chrom, k, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(p) + (n - k) * ln(1 - p))) OVER (PARTITION BY chrom ORDER BY k) AS u FROM (SELECT *, unnest(generate_series(low, high)) AS k FROM q)),
dr AS (SELECT chrom, n, c, d, low, high, (cast(('0x' || substr(md5(concat('0|', chrom, '|', rep)), 1, 8)) AS BIGINT) + 0.5) / 4294967296.0 AS u FROM q, range({N_BOOT}) r(rep)),
mk AS (SELECT *, sum(step) OVER (PARTITION BY chrom ORDER BY u, step ROWS UNBOUNDED PRECEDING) AS passed FROM (SELECT chrom, u, 1 AS step, NULL AS n, NULL AS c, NULL AS d, NULL AS low, NULL AS high FROM pt UNION ALL SELECT chrom, u, 0, n, c, d, low, high FROM dr)),
o AS (SELECT chrom, (k + 0.5) * (d + 0.5) / ((n - k + 0.5) * (c + 0.5)) AS r FROM (SELECT *, least(low + passed, high) AS k FROM mk WHERE step = 0))
SELECT tb.chrom, round((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5)), 6) AS odds_ratio, round(lo, 6) AS lo, round(hi, 6) AS hi FROM tb LEFT JOIN (SELECT chrom, quantile_cont(r, 0.025) AS lo, quantile_cont(r, 0.975) AS hi FROM o GROUP BY 1) i ON tb.chrom = i.chrom"""


@query(_BINOM)
def odds_ratio_binomial(spark, sf):
    """Odds ratios with intervals of 2,000 binomial draws."""
    t = written(K._links(spark, sf).groupBy("chrom").agg(*K._table()), "odds")  # asked several times, pairs are met once
    return shown(E.odds_ratio_intervals(t, "chrom", N_BOOT).select("chrom", "odds_ratio", "lo", "hi"))


@query()
def wilcoxon_p(spark, sf):
    """Two segments' balances in each nation: by counting where both are small and nothing ties."""
    c = read(spark, sf, "customer").where("c_mktsegment IN ('BUILDING', 'MACHINERY')").select(F.col("c_nationkey").alias("nation"), "c_mktsegment", "c_acctbal")
    tied = c.groupBy("nation", "c_acctbal").count().groupBy("nation").agg(F.max(F.col("count") > 1).alias("tied"))
    s = T.rank_sum(c, "c_acctbal", "c_mktsegment", "BUILDING", "nation").join(tied, "nation")
    return E.rank_sum_p(s, F.col("tied")).select("nation", "n1", "n0", "u", rounded("p_value").alias("p_value"), "exact")


@query("""WITH t AS (SELECT o_orderpriority AS celltype, cast(o_totalprice AS DOUBLE) AS a, cast(o_orderkey % 997 AS DOUBLE) AS r FROM orders),
k AS (SELECT *, count(*) OVER (PARTITION BY celltype) AS n, count(*) OVER (PARTITION BY celltype ORDER BY a) AS ua, count(*) OVER (PARTITION BY celltype ORDER BY r) AS ur FROM t),
g AS (SELECT celltype, n, least(ua, ur) AS low, row_number() OVER (PARTITION BY celltype ORDER BY least(ua, ur) DESC) AS j FROM k), p AS (SELECT celltype, low AS place FROM g WHERE j = least(200, n))
SELECT celltype, min(a) FILTER (ua >= place) AS depth_a, min(r) FILTER (ur >= place) AS depth_r, count(*) FILTER (ua >= place AND ur >= place) AS eligible FROM k JOIN p USING (celltype) GROUP BY 1""")
def joint_quantile_depths(spark, sf):
    """Thresholds at a common quantile of two depths that 200 rows of every type clear."""
    o = read(spark, sf, "orders").select(F.col("o_orderpriority").alias("celltype"), F.col("o_totalprice").alias("depth_a"), (F.col("o_orderkey") % 997).alias("depth_r"))
    return E.joint_quantile_depths(o, 200)
