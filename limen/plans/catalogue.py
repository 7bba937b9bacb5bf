"""The catalogue: each query as a composition of operators, with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from limen.config import Settings
from limen.functions.numeric import average_rank, rounded
from limen.operators import composition as C
from limen.operators import design as D
from limen.operators import expression as X
from limen.operators import links as L
from limen.operators import pairs as P
from limen.operators import sampling as S
from limen.operators import tests as T
from limen.plans.domain import CELLS, COUNTS, GENES, NEAR, PAIRS, SCORES, WINDOW, cells, counts, genes, pairs, peaks, read, scores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def shown(df: DataFrame, *exact: str, **kinds: int) -> DataFrame:
    """df with doubles rounded to six digits."""
    return df.select(*[rounded(c).alias(c) if t in ("double", "float") and c not in exact else F.col(c) for c, t in df.dtypes])


# --- composition -------------------------------------------------------------------------------------------------


@query(f"WITH {PAIRS} SELECT round(kappa, 6) AS kappa, n_pairs, n_donors FROM kp")
def kappa_pooled(spark, sf):
    return shown(C.kappa(C.packaged_pairs(pairs(spark, sf))))


@query(f"WITH {PAIRS} SELECT celltype, round(kappa, 6) AS kappa, round(mean_fraction, 6) AS mean_fraction, n_pairs FROM kt")
def kappa_by_category(spark, sf):
    return shown(C.kappa_by(C.packaged_pairs(pairs(spark, sf)), "celltype"))


@query(f"WITH {PAIRS} SELECT CASE WHEN count(*) > 2 AND min(mean_fraction) > 0 THEN round(corr(ln(mean_fraction), kappa), 6) END AS abundance_r, count(*) AS n_types FROM kt")
def kappa_abundance_corr(spark, sf):
    return shown(C.abundance_correlation(C.kappa_by(C.packaged_pairs(pairs(spark, sf)), "celltype")))


@query(f"WITH {PAIRS} SELECT round(sqrt(avg(kappa * kappa)), 6) AS kappa_rms_of_types, round(max(kappa) / min(kappa), 6) AS spread, round(power(max(kappa) / min(kappa), 2), 6) AS cost_spread FROM kt")
def kappa_spread(spark, sf):
    k = C.kappa_by(C.packaged_pairs(pairs(spark, sf)), "celltype")
    s = F.max("kappa") / F.min("kappa")
    return shown(k.agg(C.rms(F.col("kappa")).alias("kappa_rms_of_types"), s.alias("spread"), (s * s).alias("cost_spread")))


@query(f"WITH {PAIRS} SELECT donor, celltype, round(p, 6) AS p, round(n_eff, 6) AS n_eff, round(z, 6) AS z FROM wz")
def composition_pairs_weighted(spark, sf):
    return shown(C.weighted_pairs(pairs(spark, sf)))


@query(f"WITH {PAIRS} SELECT donor, celltype, round(p, 6) AS p, round(n_eff, 6) AS n_eff, round(z, 6) AS z FROM pz")
def composition_pairs_packaged(spark, sf):
    return shown(C.packaged_pairs(pairs(spark, sf)))


@query(f"WITH {PAIRS} SELECT donor, celltype, round(f1, 6) AS f1, round(f2, 6) AS f2 FROM shr WHERE t1 >= 50 AND t2 >= 50")
def library_shares(spark, sf):
    return shown(C.library_shares(pairs(spark, sf), 50).select("donor", "celltype", "f1", "f2"))


@query(f"""WITH {PAIRS} SELECT celltype, count(*) AS n, round(median(abs(f1 - f2)), 6) AS median_absdiff, round(quantile_cont(abs(f1 - f2), 0.9), 6) AS p90_absdiff,
round(median(log2((f1 + 1e-3) / (f2 + 1e-3))), 6) AS median_log2 FROM shr WHERE t1 >= 50 AND t2 >= 50 GROUP BY 1""")
def composition_summary_p90(spark, sf):
    d = C.descriptive_pairs(pairs(spark, sf))
    return shown(d.groupBy("celltype").agg(F.count(F.lit(1)).alias("n"), F.median("absdiff").alias("median_absdiff"), F.percentile("absdiff", 0.9).alias("p90_absdiff"), F.median("log2_ratio").alias("median_log2")))


@query(f"WITH {PAIRS} SELECT donor, celltype, n1, n2, least(t1, t2) >= 300 AS included_in_fit FROM tot")
def pair_criterion_flag(spark, sf):
    return C.pair_criterion(pairs(spark, sf), 300)


@query(f"WITH {PAIRS} SELECT donor, celltype, n1, n2 FROM tot WHERE least(t1, t2) >= 300")
def pair_criterion_filter(spark, sf):
    return C.pair_criterion(pairs(spark, sf), 300).where("included_in_fit").drop("included_in_fit")


@query("""WITH n AS (SELECT DISTINCT l_suppkey AS donor, l_linenumber AS lib FROM lineitem)
SELECT a.donor, a.lib AS lib1, b.lib AS lib2 FROM n a JOIN n b ON a.donor = b.donor AND a.lib < b.lib""")
def library_pairs_selfjoin(spark, sf):
    n = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("donor"), F.col("l_linenumber").alias("lib")).distinct()
    return n.withColumnRenamed("lib", "lib1").join(n.withColumnRenamed("lib", "lib2"), "donor").where("lib1 < lib2")


@query("""SELECT donor, lib, n FROM (SELECT l_suppkey AS donor, l_linenumber AS lib, count(*) AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_linenumber) AS k
FROM lineitem GROUP BY 1, 2) WHERE k <= 2""")
def top2_libraries(spark, sf):
    n = read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("donor"), F.col("l_linenumber").alias("lib")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("k", F.row_number().over(Window.partitionBy("donor").orderBy(F.col("n").desc(), "lib"))).where("k <= 2").drop("k")


_MULT = """dn AS (SELECT donor, row_number() OVER (ORDER BY donor) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT donor FROM {per})),
dr AS (SELECT rep, cast(('0x' || substr(md5(concat('0|', rep, '|', i)), 1, 8)) AS BIGINT) % n AS j FROM dn, range({b}) t(rep)),
mu AS (SELECT rep, donor, count(*) AS w FROM dr JOIN dn ON dn.i = j GROUP BY 1, 2)"""


@query(f"""WITH {PAIRS}, per AS (SELECT donor, sum(z * z / (2 / n_eff)) AS ss, count(*) AS m FROM pz GROUP BY 1), {_MULT.format(per="per", b=200)}
SELECT rep, round(sqrt(sum(w * ss) / sum(w * m)), 6) AS kappa FROM mu JOIN per USING (donor) GROUP BY rep""")
def kappa_bootstrap_hash(spark, sf):
    return shown(C.kappa_bootstrap(C.packaged_pairs(pairs(spark, sf)), 200))


@query(f"""WITH {PAIRS}, per AS (SELECT donor, sum(z * z / (2 / n_eff)) AS ss, count(*) AS m FROM pz GROUP BY 1), {_MULT.format(per="per", b=200)},
k AS (SELECT rep, sqrt(sum(w * ss) / sum(w * m)) AS kappa FROM mu JOIN per USING (donor) GROUP BY rep)
SELECT round(quantile_cont(kappa, 0.025), 6) AS lo, round(quantile_cont(kappa, 0.975), 6) AS hi FROM k""")
def kappa_interval_hash(spark, sf):
    return shown(C.kappa_bootstrap(C.packaged_pairs(pairs(spark, sf)), 200).agg(F.percentile("kappa", 0.025).alias("lo"), F.percentile("kappa", 0.975).alias("hi")))


_SHARES = """sh AS (SELECT CASE WHEN o_custkey % 2 = 0 THEN 'A' ELSE 'B' END AS grp, o_custkey % 40 AS donor, o_orderpriority AS celltype, count(*) AS n FROM orders GROUP BY 1, 2, 3),
st AS (SELECT *, sum(n) OVER (PARTITION BY donor) AS total FROM sh)"""


def _shares(spark, sf):
    o = read(spark, sf, "orders")
    n = o.groupBy(F.when(F.col("o_custkey") % 2 == 0, "A").otherwise("B").alias("grp"), (F.col("o_custkey") % 40).alias("donor"), F.col("o_orderpriority").alias("celltype")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("total", F.sum("n").over(Window.partitionBy("donor")))


@query(f"""WITH {_SHARES}, a AS (SELECT celltype, avg(n / total) FILTER (grp = 'A') AS ma, avg(n / total) FILTER (grp = 'B') AS mb, avg(n / total) AS p,
sum(1 / total) FILTER (grp = 'A') AS ia, sum(1 / total) FILTER (grp = 'B') AS ib, count(*) FILTER (grp = 'A') AS na, count(*) FILTER (grp = 'B') AS nb FROM st GROUP BY 1),
f AS (SELECT *, ma - mb AS delta, 1.96 * sqrt(4.0 * p * (1 - p) * (ia / (na * na) + ib / (nb * nb))) AS fl FROM a)
SELECT celltype, na AS n_donor_a, nb AS n_donor_b, round(delta, 6) AS delta, round(fl, 6) AS floor_share, round(abs(delta) / fl, 6) AS ratio, abs(delta) > fl AS above FROM f""")
def contrast_vs_floor(spark, sf):
    return shown(C.contrast_vs_floor(_shares(spark, sf), 2.0))


@query(f"""WITH {_SHARES}, g AS (SELECT celltype, avg(n / total) FILTER (grp = 'A') AS m1, avg(n / total) FILTER (grp = 'B') AS m2, var_samp(n / total) FILTER (grp = 'A') AS v1, var_samp(n / total) FILTER (grp = 'B') AS v2,
count(*) FILTER (grp = 'A') AS n1, count(*) FILTER (grp = 'B') AS n2 FROM st GROUP BY 1)
SELECT celltype, n1, n2, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t, round(power(v1 / n1 + v2 / n2, 2) / (power(v1 / n1, 2) / (n1 - 1) + power(v2 / n2, 2) / (n2 - 1)), 6) AS df FROM g""")
def welch_stat(spark, sf):
    return shown(T.welch(_shares(spark, sf).withColumn("f", F.col("n") / F.col("total")), "f", "grp", "A", "B", "celltype").drop("p_value"))


@query()
def welch_p_values(spark, sf):
    return shown(L.bh_q(T.welch(_shares(spark, sf).withColumn("f", F.col("n") / F.col("total")), "f", "grp", "A", "B", "celltype").withColumns({"p": F.col("p_value"), "fam": F.lit(1)}), "fam", tie="celltype").drop("p", "fam"))


_TAB = """tb AS (SELECT celltype, sum(n) FILTER (grp = 'A') AS a, sum(n) FILTER (grp = 'B') AS b FROM st GROUP BY 1),
tc AS (SELECT celltype, a, sum(a) OVER () - a AS b, b AS c, sum(b) OVER () - b AS d FROM tb)"""


@query(f"""WITH {_SHARES}, {_TAB}, n AS (SELECT *, cast(a + b + c + d AS DOUBLE) AS n FROM tc)
SELECT celltype, cast(a AS BIGINT) AS a, cast(b AS BIGINT) AS b, cast(c AS BIGINT) AS c, cast(d AS BIGINT) AS d,
round(n * power(greatest(0, abs(cast(a AS DOUBLE) * d - cast(b AS DOUBLE) * c) - n / 2), 2) / (cast(a + b AS DOUBLE) * (c + d) * (a + c) * (b + d)), 6) AS chi2 FROM n""")
def chi2_yates_stat(spark, sf):
    t = _shares(spark, sf).groupBy("celltype").agg(F.sum(F.when(F.col("grp") == "A", F.col("n"))).alias("a"), F.sum(F.when(F.col("grp") == "B", F.col("n"))).alias("c"))
    w = Window.partitionBy()  # a row for each category
    t = t.select("celltype", "a", (F.sum("a").over(w) - F.col("a")).alias("b"), "c", (F.sum("c").over(w) - F.col("c")).alias("d"))
    return shown(T.chi2_yates(t))


@query("""WITH r AS (SELECT c_mktsegment = 'BUILDING' AS f, rank() OVER (ORDER BY round(c_acctbal)) + (count(*) OVER (PARTITION BY round(c_acctbal)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY round(c_acctbal)) AS t, count(*) OVER () AS n FROM customer),
s AS (SELECT sum(r) FILTER (f) AS rs, count(*) FILTER (f) AS n1, count(*) FILTER (NOT f) AS n0, sum(cast(t AS DOUBLE) * t - 1) AS tie, any_value(n) AS n FROM r), u AS (SELECT *, rs - n1 * (n1 + 1) / 2.0 AS u FROM s)
SELECT n1, n0, round(u, 6) AS u, round((u - n1 * n0 / 2.0 - sign(u - n1 * n0 / 2.0) * 0.5) / sqrt(n1 * n0 / 12.0 * (n + 1 - tie / (n * (n - 1.0)))), 6) AS z FROM u""")
def wilcoxon_u(spark, sf):
    c = read(spark, sf, "customer").select(F.round("c_acctbal").alias("v"), "c_mktsegment", F.lit(1).alias("all"))
    return shown(T.rank_sum(c, "v", "c_mktsegment", "BUILDING", "all").drop("all"))


@query("""WITH g AS (SELECT c_mktsegment, count(*) AS n, sum(c_acctbal) AS s, sum(c_acctbal * c_acctbal) AS ss FROM customer GROUP BY 1), t AS (SELECT sum(n) AS n, sum(s) AS s, sum(ss) AS ss, sum(s * s / n) AS b FROM g)
SELECT round((b - s * s / n) / (ss - s * s / n), 6) AS eta_squared FROM t""")
def eta_squared(spark, sf):
    return shown(T.variance_explained(read(spark, sf, "customer"), "c_acctbal", "c_mktsegment"))


@query("""WITH x AS (SELECT l_extendedprice AS a, l_tax AS b, l_quantity AS c FROM lineitem), r AS (SELECT corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc FROM x)
SELECT round((ab - ac * bc) / sqrt((1 - ac * ac) * (1 - bc * bc)), 6) AS partial_r FROM r""")
def partial_corr(spark, sf):
    return shown(X.partial_correlation(read(spark, sf, "lineitem"), F.col("l_extendedprice"), F.col("l_tax"), F.col("l_quantity")))


# --- expression --------------------------------------------------------------------------------------------------

G = ["donor", "celltype", "lib"]


def _bulk(spark, sf):
    return X.pseudobulk(counts(spark, sf), G)


def _floors(spark, sf):
    return X.floors(X.side_by_side(_bulk(spark, sf), ["donor", "celltype"]), ["donor", "celltype"], 50)


@query(f'WITH {COUNTS} SELECT donor, celltype, lib, feature, "count" FROM bulk')
def pseudobulk_sum(spark, sf):
    return _bulk(spark, sf)


@query(f"WITH {COUNTS} SELECT count(*) FILTER (value = 0) AS zeros, count(*) AS entries FROM cnt")
def pseudobulk_zeros(spark, sf):
    return X.zero_count(counts(spark, sf))


@query("SELECT s_nationkey AS donor, l_returnflag AS celltype, count(DISTINCT l_orderkey) AS n_cells FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2")
def pseudobulk_groupinfo(spark, sf):
    li, s = read(spark, sf, "lineitem"), read(spark, sf, "supplier")
    rows = li.join(s, li["l_suppkey"] == s["s_suppkey"]).select(F.col("s_nationkey").alias("donor"), F.col("l_returnflag").alias("celltype"), F.col("l_orderkey").alias("cell"))
    return X.group_info(rows, ["donor", "celltype"])


@query(f'WITH {COUNTS} SELECT donor, celltype, lib, feature, "count", round("count" * 1e6 / sum("count") OVER (PARTITION BY donor, celltype, lib), 6) AS cpm FROM bulk')
def cpm_long(spark, sf):
    return shown(X.cpm(_bulk(spark, sf), G))


@query(f"WITH {COUNTS} SELECT donor, celltype, round(floor, 6) AS floor, n_genes, round(n_eff, 6) AS n_eff FROM fl")
def expression_floor_pairs(spark, sf):
    return shown(_floors(spark, sf).drop("r"))


@query(f"WITH {COUNTS} SELECT donor, celltype, round(r, 6) AS r, n_genes FROM fl")
def expression_pair_corr(spark, sf):
    return shown(_floors(spark, sf).select("donor", "celltype", "r", "n_genes"))


@query(f"WITH {COUNTS} SELECT celltype, count(*) AS n_pairs, round(median(floor), 6) AS median_floor, round(quantile_cont(floor, 0.9), 6) AS p90_floor, round(median(n_eff), 6) AS median_n_eff FROM fl GROUP BY 1")
def floor_summary(spark, sf):
    return shown(_floors(spark, sf).groupBy("celltype").agg(F.count(F.lit(1)).alias("n_pairs"), F.median("floor").alias("median_floor"), F.percentile("floor", 0.9).alias("p90_floor"), F.median("n_eff").alias("median_n_eff")))


_FIT = "count(*) AS n_obs, round(regr_slope(ln(floor), ln(n_eff)), 6) AS b, round(exp(regr_intercept(ln(floor), ln(n_eff))), 6) AS a, round(median(n_eff), 6) AS median_x"


@query(f"WITH {COUNTS} SELECT {_FIT} FROM fl WHERE floor > 0 AND n_eff > 0")
def powerlaw_fit(spark, sf):
    return shown(X.power_law(_floors(spark, sf), "n_eff", "floor"))


@query(f"WITH {COUNTS} SELECT celltype, {_FIT} FROM fl WHERE floor > 0 AND n_eff > 0 GROUP BY 1 HAVING count(*) >= 5")
def powerlaw_by_category(spark, sf):
    return shown(X.power_law(_floors(spark, sf), "n_eff", "floor", "celltype", least=5))


@query(f"WITH {COUNTS} SELECT cast(threshold AS DOUBLE) AS threshold, {_FIT} FROM fl, (VALUES (0), (500), (1000), (2500)) t(threshold) WHERE n_eff >= threshold AND floor > 0 GROUP BY 1 HAVING count(*) >= 5")
def support_sensitivity(spark, sf):
    return shown(X.support_sensitivity(_floors(spark, sf), [0, 500, 1000, 2500]))


@query(f"""WITH {COUNTS}, l AS (SELECT regr_slope(ln(floor), ln(n_eff)) AS b, regr_intercept(ln(floor), ln(n_eff)) AS la FROM fl WHERE floor > 0)
SELECT CASE WHEN abs((ln(1.0) - la) / b) < 20 THEN round(exp((ln(1.0) - la) / b), 3) END AS needed FROM l""")
def inverse_prediction(spark, sf):
    law = X.inverse_prediction(X.power_law(_floors(spark, sf), "n_eff", "floor"), 1.0)
    return law.select(F.when(F.abs(F.ln("needed")) < 20, F.round("needed", 3)).alias("needed"))


@query(f"WITH {COUNTS} SELECT celltype, count(*) AS n_obs, round(max(n_eff) / min(n_eff), 6) AS span, round(regr_slope(ln(floor), ln(n_eff)), 6) AS b FROM fl GROUP BY 1 HAVING count(*) >= 8 AND max(n_eff) / min(n_eff) >= 1.5")
def stratified_slopes(spark, sf):
    return shown(X.stratified_slopes(_floors(spark, sf), "celltype", span=1.5))


@query(f"WITH {COUNTS} SELECT round(exp(median(ln(floor) + 0.5 * ln(n_eff))), 6) AS a_fixed FROM fl")
def median_intercept(spark, sf):
    return shown(X.median_intercept(_floors(spark, sf), -0.5))


_SUMS = "per AS (SELECT donor, count(*) AS m, sum(ln(n_eff)) AS sx, sum(ln(floor)) AS sy, sum(ln(n_eff) * ln(n_eff)) AS sxx, sum(ln(n_eff) * ln(floor)) AS sxy FROM fl GROUP BY 1)"


@query(f"""WITH {COUNTS}, {_SUMS}, {_MULT.format(per="per", b=100)}
SELECT rep, round((sum(w * m) * sum(w * sxy) - sum(w * sx) * sum(w * sy)) / (sum(w * m) * sum(w * sxx) - sum(w * sx) * sum(w * sx)), 5) AS b FROM mu JOIN per USING (donor) GROUP BY rep""")
def slope_bootstrap_hash(spark, sf):
    return X.slope_bootstrap(_floors(spark, sf), 100).select("rep", rounded("b", 5).alias("b"))


@query(f"""WITH {PAIRS}, {COUNTS.replace('cnt', 'cnt0')}, {_SUMS}, {_MULT.format(per="per", b=100)},
s AS (SELECT rep, (sum(w * m) * sum(w * sxy) - sum(w * sx) * sum(w * sy)) / (sum(w * m) * sum(w * sxx) - sum(w * sx) * sum(w * sx)) AS b FROM mu JOIN per USING (donor) GROUP BY rep)
SELECT round(avg(CASE WHEN b <= -0.5 THEN 1.0 ELSE 0.0 END), 6) AS below_half, round(avg(CASE WHEN b >= 0 THEN 1.0 ELSE 0.0 END), 6) AS not_negative FROM s""")
def slope_tails_hash(spark, sf):
    b = X.slope_bootstrap(_floors(spark, sf), 100)
    return shown(b.agg(F.avg(F.when(F.col("b") <= -0.5, 1.0).otherwise(0.0)).alias("below_half"), F.avg(F.when(F.col("b") >= 0, 1.0).otherwise(0.0)).alias("not_negative")))


# --- design ------------------------------------------------------------------------------------------------------

_KS = "ks AS (SELECT 'multinomial' AS source, 1.0::DOUBLE AS kappa UNION ALL SELECT 'pooled', kappa FROM kp UNION ALL SELECT 'median', median(kappa) FROM kt UNION ALL SELECT 'worst', max(kappa) FROM kt)"


def _kappas(spark, sf):
    z = C.packaged_pairs(pairs(spark, sf))
    return D.named_kappas(C.kappa(z), C.kappa_by(z, "celltype"))


@query(f"""WITH {PAIRS}, {_KS}, g AS (SELECT d AS donors, n AS nuclei, source, round_even(100 * 1.96 * kappa * sqrt(0.1 * 0.9) * sqrt(2.0 / (d * n)), 3) AS pp FROM ks, (VALUES (10, 2000), (20, 5000), (50, 10000), (200, 20000)) t(d, n))
SELECT cast(donors AS BIGINT) AS donors, cast(nuclei AS BIGINT) AS nuclei, max(pp) FILTER (source = 'multinomial') AS multinomial, max(pp) FILTER (source = 'pooled') AS pooled, max(pp) FILTER (source = 'median') AS median, max(pp) FILTER (source = 'worst') AS worst FROM g GROUP BY 1, 2""")
def design_grid(spark, sf):
    return D.composition_design(_kappas(spark, sf), Settings())


@query(f"WITH {PAIRS}, {_KS} SELECT source, cast(round_even(2 * power(1.96 * kappa * sqrt(0.1 * 0.9) * 100, 2), 0) AS BIGINT) AS nuclei FROM ks")
def design_requirement(spark, sf):
    return D.composition_requirement(_kappas(spark, sf), Settings())


@query(f"""WITH {COUNTS}, l AS (SELECT regr_slope(ln(floor), ln(n_eff)) AS b, exp(regr_intercept(ln(floor), ln(n_eff))) AS a, median(n_eff) AS m FROM fl)
SELECT cast(n AS BIGINT) AS nuclei, round(a * power(n, b), 5) AS threshold, n > 10 * m AS extrapolated FROM l, (VALUES (25), (50), (100), (200), (500), (1000)) t(n)""")
def expression_thresholds(spark, sf):
    t = D.expression_design(X.power_law(_floors(spark, sf), "n_eff", "floor"))
    return t.withColumn("threshold", rounded("threshold", 5))


# --- positions ---------------------------------------------------------------------------------------------------


def _band(spark, sf):
    return L.band_join(genes(spark, sf), peaks(spark, sf).drop("user_id"), WINDOW)


@query(f"WITH {GENES} SELECT gene, chrom, tss, peak, mid FROM bd")
def band_join_halfopen(spark, sf):
    return _band(spark, sf).select("gene", "chrom", "tss", "peak", "mid")


@query(f"""WITH {GENES} SELECT gene, gn.chrom, count(*) AS n_tot, count(*) FILTER (abs(mid - tss) <= {NEAR}) AS n_prox FROM gn JOIN pk ON gn.chrom = pk.chrom AND mid BETWEEN tss - {WINDOW} AND tss + {WINDOW} GROUP BY 1, 2""")
def band_join_closed_count(spark, sf):
    return L.band_counts(genes(spark, sf), peaks(spark, sf), WINDOW, NEAR, closed=True, keep_zero=False)


@query(f"""WITH {GENES} SELECT gene, gn.chrom, count(peak) AS n_tot, count(peak) FILTER (mid >= tss - {NEAR} AND mid < tss + {NEAR}) AS n_prox FROM gn LEFT JOIN pk ON gn.chrom = pk.chrom AND pk.user_id <> gn.user_id AND mid >= tss - {WINDOW // 12} AND mid < tss + {WINDOW // 12} GROUP BY 1, 2""")
def window_counts_zero_kept(spark, sf):
    g = genes(spark, sf)
    # all near peaks less the user's own, which meet one gene each
    w, p = WINDOW // 12, peaks(spark, sf).where("user_id IS NOT NULL")
    spans = [(-w, True, w, False), (-NEAR, True, NEAR, False)]
    n = P.near_counts(g.where("user_id IS NOT NULL"), p, w, spans, "gene").select("gene", *[F.col("near")[i].alias(c) for i, c in enumerate(("t", "q"))])
    d = F.col("mid") - F.col("tss")
    inside = lambda k: F.when((d >= -k) & (d < k), -1).otherwise(0).cast("long")
    own = p.join(g, ["chrom", "user_id"]).where((d >= -w) & (d < w)).select("gene", inside(w).alias("t"), inside(NEAR).alias("q"))
    n = n.unionByName(own).groupBy("gene").agg(F.sum("t").alias("n_tot"), F.sum("q").alias("n_prox"))
    return g.join(n, "gene", "left").select("gene", "chrom", F.coalesce("n_tot", F.lit(0)).alias("n_tot"), F.coalesce("n_prox", F.lit(0)).alias("n_prox"))


@query(f"""WITH {GENES}, n AS (SELECT gene, chrom, count(*) AS n, count(*) FILTER (mid >= tss - {NEAR} AND mid < tss + {NEAR}) AS p FROM bd GROUP BY 1, 2)
SELECT chrom, round(median(n), 6) AS median_n, round(quantile_cont(n, 0.25), 6) AS q1, round(quantile_cont(n, 0.75), 6) AS q3, round(stddev_samp(n) / avg(n), 6) AS cv, round(sum(p) / sum(n), 6) AS promoter_share FROM n GROUP BY 1""")
def window_cv(spark, sf):
    n = L.band_counts(genes(spark, sf), peaks(spark, sf), WINDOW, NEAR)
    return shown(n.groupBy("chrom").agg(F.median("n_tot").alias("median_n"), F.percentile("n_tot", 0.25).alias("q1"), F.percentile("n_tot", 0.75).alias("q3"), (F.stddev_samp("n_tot") / F.avg("n_tot")).alias("cv"), (F.sum("n_prox") / F.sum("n_tot")).alias("promoter_share")))


# a link: gene and peak ids whose hash is low, more often near the gene
_LINK = f"lk AS (SELECT *, abs(mid - tss) < {NEAR} AS prox, cast(('0x' || substr(md5(concat(gene, '|', peak)), 1, 8)) AS BIGINT) % 100 < CASE WHEN abs(mid - tss) < {NEAR} THEN 40 ELSE 15 END AS link FROM bd)"


LINK = ("", 40, 15)


def _links(spark, sf, g=None, p=None, edges=(0, NEAR), marks=(LINK,)):
    """Pairs counted by class of gene, of peak and of distance; n_marked: links among them."""
    none = F.lit(0)
    ours = genes(spark, sf).withColumn("g", none if g is None else g)
    theirs = peaks(spark, sf).withColumn("p", none if p is None else p)
    return P.pair_counts(ours, theirs, WINDOW, list(edges), list(marks), NEAR)


def _table(mark=0):
    """a, b: links near and far; c, d: pairs that are no links, near and far."""
    hit, near = F.col("marked")[mark], F.col("d") == 0
    of = lambda n, at: F.coalesce(F.sum(F.when(at, n)), F.lit(0))
    return [of(hit, near).alias("a"), of(hit, ~near).alias("b"), of(F.col("n") - hit, near).alias("c"), of(F.col("n") - hit, ~near).alias("d")]


_ABCD = "count(*) FILTER (link AND prox) AS a, count(*) FILTER (link AND NOT prox) AS b, count(*) FILTER (NOT link AND prox) AS c, count(*) FILTER (NOT link AND NOT prox) AS d"
_HA = "(a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5))"


@query(f"WITH {GENES}, {_LINK}, t AS (SELECT chrom, {_ABCD} FROM lk GROUP BY 1) SELECT chrom, a, b, c, d, round({_HA}, 6) AS odds_ratio FROM t")
def promoter_odds_ratio(spark, sf):
    t = _links(spark, sf).groupBy("chrom").agg(*_table())
    return shown(t.withColumn("odds_ratio", L.haldane(*[F.col(x) for x in "abcd"])))


@query(f"""WITH {GENES}, {_LINK}, v AS (SELECT *, peak % 3 <> 0 AS varies FROM lk), t AS (SELECT {_ABCD}, count(*) FILTER (NOT link AND prox AND varies) AS c2, count(*) FILTER (NOT link AND NOT prox AND varies) AS d2 FROM v)
SELECT round({_HA}, 6) AS or_all, round((a + 0.5) * (d2 + 0.5) / ((b + 0.5) * (c2 + 0.5)), 6) AS or_varying FROM t""")
def odds_two_backgrounds(spark, sf):
    k = _links(spark, sf, p=F.col("peak") % 3 != 0)
    v = F.when(F.col("p"), F.col("n") - F.col("marked")[0])
    of = lambda at: F.coalesce(F.sum(F.when(at, v)), F.lit(0))
    t = k.agg(*_table(), of(F.col("d") == 0).alias("c2"), of(F.col("d") != 0).alias("d2"))
    a, b, c, d, c2, d2 = (F.col(x) for x in ("a", "b", "c", "d", "c2", "d2"))
    return shown(t.select(L.haldane(a, b, c, d).alias("or_all"), L.haldane(a, b, c2, d2).alias("or_varying")))


_MH = """SELECT {k}, count(*) AS strata, sum(a * d / n) AS R, sum(b * c / n) AS S, sum((a + d) / n * a * d / n) AS PR, sum((a + d) / n * b * c / n + (b + c) / n * a * d / n) AS M, sum((b + c) / n * b * c / n) AS QS
FROM (SELECT *, cast(a + b + c + d AS DOUBLE) AS n FROM t) GROUP BY {k}"""
_MHE = "strata, round(R / S, 6) AS odds_ratio, round(exp(ln(R / S) - 1.96 * se), 6) AS lo, round(exp(ln(R / S) + 1.96 * se), 6) AS hi, round(ln(R / S), 6) AS log_or, round(se, 6) AS se"
_SE = "sqrt(PR / (2 * R * R) + M / (2 * R * S) + QS / (2 * S * S)) AS se"


def _strata(spark, sf):
    return _links(spark, sf, F.col("user_id") % 3).groupBy(F.col("g").alias("seed"), "chrom").agg(*_table())


_STR = f"t AS (SELECT user_id % 3 AS seed, chrom, {_ABCD} FROM lk GROUP BY 1, 2)"


@query(f"WITH {GENES}, {_LINK}, {_STR}, m AS ({_MH.format(k='seed')}), e AS (SELECT *, {_SE} FROM m WHERE R > 0 AND S > 0) SELECT seed, {_MHE} FROM e")
def mh_pooled_or(spark, sf):
    return shown(L.mantel_haenszel(_strata(spark, sf), "seed"))


@query(f"""WITH {GENES}, {_LINK}, {_STR}, m AS ({_MH.format(k='seed')}), e AS (SELECT ln(R / S) AS l, {_SE} FROM m WHERE R > 0 AND S > 0), v AS (SELECT count(*) AS repeats, avg(l) AS l, avg(se * se) + coalesce(var_samp(l), 0) AS v FROM e)
SELECT repeats, round(exp(l), 6) AS odds_ratio, round(exp(l - 1.96 * sqrt(v)), 6) AS lo, round(exp(l + 1.96 * sqrt(v)), 6) AS hi FROM v WHERE repeats > 0""")
def mh_repeats(spark, sf):
    return shown(L.over_repeats(L.mantel_haenszel(_strata(spark, sf), "seed").withColumn("all", F.lit(1)), "all").drop("all"))


@query(f"WITH {GENES}, {_LINK}, t AS (SELECT chrom, {_ABCD} FROM lk GROUP BY 1), r AS (SELECT chrom, sum(a) OVER () - a AS a, sum(b) OVER () - b AS b, sum(c) OVER () - c AS c, sum(d) OVER () - d AS d FROM t) SELECT chrom, round(ln({_HA}), 6) AS log_or_without FROM r")
def jackknife_chrom(spark, sf):
    return shown(L.leave_one_out(_links(spark, sf).groupBy("chrom").agg(*_table()), "chrom"))


EDGES = [0, 600, 3600, 7200, 14400, 21600]
_BAND = "bn AS (SELECT CASE WHEN d = 21600 THEN 4 WHEN d < 600 THEN 0 WHEN d < 3600 THEN 1 WHEN d < 7200 THEN 2 WHEN d < 14400 THEN 3 WHEN d < 21600 THEN 4 END AS band, link FROM (SELECT abs(mid - tss) AS d, link FROM lk)), bc AS (SELECT band, count(*) FILTER (link) AS observed, count(*) AS reference FROM bn GROUP BY 1)"


def _bands(spark, sf):
    return _links(spark, sf, edges=EDGES[:-1]).groupBy(F.col("d").alias("band")).agg(F.sum(F.col("marked")[0]).alias("observed"), F.sum("n").alias("reference"))


@query(f"WITH {GENES}, {_LINK}, {_BAND} SELECT band, observed, reference FROM bc")
def distance_bands(spark, sf):
    return _bands(spark, sf)


@query(f"WITH {GENES}, {_LINK}, {_BAND}, e AS (SELECT observed AS o, reference * sum(observed) OVER () / sum(reference) OVER () AS e FROM bc) SELECT round(2 * sum(CASE WHEN o > 0 THEN o * ln(o / e) ELSE 0 END), 6) AS g, count(*) - 1 AS df FROM e WHERE e > 0")
def g_statistic(spark, sf):
    return shown(L.g_statistic(_bands(spark, sf)))


@query(f"""WITH {GENES}, {_LINK}, {_BAND}, c AS (SELECT band, reference AS n, sum(reference) OVER (ORDER BY band) AS cum, sum(reference) OVER () / 2.0 AS half FROM bc), e AS (SELECT *, [0, 600, 3600, 7200, 14400, 21600] AS ed FROM c WHERE cum >= half ORDER BY band LIMIT 1)
SELECT round(ed[band + 1] + (ed[band + 2] - ed[band + 1]) * (half - (cum - n)) / n, 6) AS median_distance FROM e""")
def band_median(spark, sf):
    return shown(L.band_median(_bands(spark, sf).select("band", F.col("reference").alias("n")), EDGES))


_HN = "cast(('0x' || substr(md5({0}), 1, 8)) AS BIGINT)"


@query(f"""WITH {GENES}, r AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY {_HN.format("concat('0|', gene)")}, gene) - 1 AS pos FROM gn), z AS (SELECT chrom, count(*) AS size FROM gn GROUP BY 1),
o AS (SELECT g.gene, g.chrom, z.chrom AS c2, z.size, row_number() OVER (PARTITION BY g.gene ORDER BY z.chrom) - 1 AS i, count(*) OVER (PARTITION BY g.gene) AS k FROM gn g JOIN z ON z.chrom <> g.chrom),
p AS (SELECT gene, chrom, c2, {_HN.format("concat('0|p|', gene)")} % size AS pos FROM o WHERE i = {_HN.format("concat('0|c|', gene)")} % k)
SELECT p.gene, p.chrom, r.gene AS partner, p.c2 AS to_chrom, r.tss AS partner_tss FROM p JOIN r ON r.chrom = p.c2 AND r.pos = p.pos""")
def trans_repair_hash(spark, sf):
    return L.repaired_elsewhere(genes(spark, sf)).select("gene", "chrom", "partner", "to_chrom", "partner_tss")


# --- correlation, false discovery --------------------------------------------------------------------------------


def _corr_pairs(spark, sf):
    f = cells(spark, sf).select("feature").distinct()
    day = F.split("feature", "-")
    x = f.select(F.col("feature").alias("x"), day[0].alias("tx"), day[1].alias("day"))
    y = f.select(F.col("feature").alias("y"), day[0].alias("ty"), day[1].alias("day"))
    return x.join(y, "day").where("tx < ty").select("x", "y")


_R = f"""{CELLS}, n AS (SELECT count(DISTINCT user_id) AS n FROM events), m AS (SELECT feature, sum(value) / any_value(n) AS mean, sqrt(greatest(sum(value * value) / any_value(n) - power(sum(value) / any_value(n), 2), 0)) AS sd FROM ob, n GROUP BY 1),
f AS (SELECT DISTINCT feature, split_part(feature, '-', 1) AS t, split_part(feature, '-', 2) AS d FROM ob), pr AS (SELECT a.feature AS x, b.feature AS y FROM f a JOIN f b ON a.d = b.d AND a.t < b.t),
xy AS (SELECT x, y, sum(a.value * b.value) AS s FROM pr JOIN ob a ON a.feature = x JOIN ob b ON b.feature = y AND a.obs = b.obs GROUP BY 1, 2),
rr AS (SELECT pr.x, pr.y, CASE WHEN mx.sd > 0 AND my.sd > 0 THEN (coalesce(s, 0) / n - mx.mean * my.mean) / (mx.sd * my.sd) * n / (n - 1.0) ELSE 0 END AS r FROM pr LEFT JOIN xy ON xy.x = pr.x AND xy.y = pr.y JOIN m mx ON mx.feature = pr.x JOIN m my ON my.feature = pr.y, n)"""


def _r(spark, sf):
    n = read(spark, sf, "events").agg(F.countDistinct("user_id")).first()[0]
    return L.pair_correlation(cells(spark, sf), _corr_pairs(spark, sf), n)


@query(f"WITH {_R} SELECT x, y, round(r, 6) AS r FROM rr")
def pair_moment_corr(spark, sf):
    return shown(_r(spark, sf))


# a monotone stand-in for p that any engine computes alike
_P = "ps AS (SELECT concat(x, '|', y) AS test, split_part(x, '-', 1) AS fam, exp(-20 * round(abs(r), 6)) AS p FROM rr)"


def _p(spark, sf):
    r = _r(spark, sf)
    return r.select(F.concat_ws("|", "x", "y").alias("test"), F.split("x", "-")[0].alias("fam"), F.exp(-20 * F.round(F.abs("r"), 6)).alias("p"))


@query(f"WITH {_R}, {_P}, k AS (SELECT fam, p, row_number() OVER (PARTITION BY fam ORDER BY p, test) AS k, count(*) OVER (PARTITION BY fam) AS m FROM ps) SELECT fam, round(coalesce(max(p) FILTER (p <= 0.2 * k / m), -1), 6) AS threshold, count(*) AS m FROM k GROUP BY 1")
def bh_threshold(spark, sf):
    return shown(L.bh_threshold(_p(spark, sf), 0.2, "fam"))


@query(f"""WITH {_R}, {_P}, k AS (SELECT *, p * count(*) OVER (PARTITION BY fam) / row_number() OVER (PARTITION BY fam ORDER BY p, test) AS raw FROM ps)
SELECT test, fam, round(p, 6) AS p, round(least(1.0, min(raw) OVER (PARTITION BY fam ORDER BY p DESC, test DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM k""")
def bh_qvalues(spark, sf):
    return shown(L.bh_q(_p(spark, sf), "fam"))


@query(f"WITH {CELLS}, v AS (SELECT feature, split_part(feature, '-', 1) AS fam, sum(value * value) AS v FROM ob GROUP BY 1, 2) SELECT feature, round((rank() OVER (PARTITION BY fam ORDER BY v) + (count(*) OVER (PARTITION BY fam, v) - 1) / 2.0) / count(*) OVER (PARTITION BY fam), 6) AS quantile FROM v")
def variance_quantile_rank(spark, sf):
    v = cells(spark, sf).groupBy("feature", F.split("feature", "-")[0].alias("fam")).agg(F.sum(F.col("value") * F.col("value")).alias("v"))
    return shown(v.select("feature", L.quantile_rank("v", "fam").alias("quantile")))


@query(f"WITH {CELLS} SELECT split_part(feature, '-', 1) AS grp, round(-sum(p * ln(p)), 6) AS entropy FROM (SELECT feature, s / sum(s) OVER (PARTITION BY split_part(feature, '-', 1)) AS p FROM (SELECT feature, sum(value) AS s FROM ob GROUP BY 1)) GROUP BY 1")
def entropy_by_group(spark, sf):
    s = cells(spark, sf).groupBy("feature").agg(F.sum("value").alias("s")).withColumn("grp", F.split("feature", "-")[0])
    p = s.withColumn("p", F.col("s") / F.sum("s").over(Window.partitionBy("grp"))).where("p > 0")
    return shown(p.groupBy("grp").agg((-F.sum(F.col("p") * F.ln("p"))).alias("entropy")))


@query("SELECT l_returnflag AS grp, round(sqrt(avg(l_discount * l_discount)), 6) AS rms FROM lineitem GROUP BY 1")
def rms_by_group(spark, sf):
    return shown(read(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("grp")).agg(C.rms(F.col("l_discount")).alias("rms")))


# --- labels and scores -------------------------------------------------------------------------------------------


@query(f"WITH {SCORES}, r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM sc), g AS (SELECT sum(r) FILTER (y = 1) AS rs, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y <> 1) AS n0 FROM r) SELECT n1, n0, round((rs - n1 * (n1 + 1) / 2.0) / (n1 * n0), 6) AS auroc FROM g")
def auroc(spark, sf):
    return shown(T.auroc(scores(spark, sf).withColumn("all", F.lit(1)), "y", "s", "all").drop("all"))


_BINS = "cb AS (SELECT cast(least(floor(s * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(s) AS mean_score, avg(y) AS mean_label FROM sc GROUP BY 1 HAVING count(*) >= 10)"


@query(f"WITH {SCORES}, {_BINS} SELECT bin, n, round(mean_score, 6) AS mean_score, round(mean_label, 6) AS mean_label FROM cb")
def calibration_bins(spark, sf):
    return shown(T.calibration_bins(scores(spark, sf), "y", "s"))


@query(f"WITH {SCORES}, {_BINS} SELECT round(sum(n * abs(mean_score - mean_label)) / sum(n), 6) AS ece FROM cb")
def ece(spark, sf):
    return shown(T.expected_calibration_error(T.calibration_bins(scores(spark, sf), "y", "s")))


@query(f"""WITH {SCORES}, c AS (SELECT avg((y = 0 AND s < 0.5)::INT) AS c00, avg((y = 1 AND s < 0.5)::INT) AS c01, avg((y = 0 AND s >= 0.5)::INT) AS c10, avg((y = 1 AND s >= 0.5)::INT) AS c11 FROM sc WHERE doc_id % 2 = 0), m AS (SELECT avg((s >= 0.5)::INT) AS mu1 FROM sc WHERE doc_id % 2 = 1)
SELECT round(greatest(0, least(1, CASE WHEN abs(c00 * c11 - c01 * c10) > 1e-9 THEN (c00 * mu1 - c10 * (1 - mu1)) / (c00 * c11 - c01 * c10) * (c01 + c11) ELSE c01 + c11 END)), 6) AS prior, round(mu1, 6) AS mu1 FROM c, m""")
def bbse_prior(spark, sf):
    s = scores(spark, sf)
    return shown(T.shifted_prior(s.where("doc_id % 2 = 0"), s.where("doc_id % 2 = 1")))


@query(f"WITH {SCORES}, k AS (SELECT y, 1 - s AS a, row_number() OVER (PARTITION BY y ORDER BY 1 - s, doc_id) AS k, count(*) OVER (PARTITION BY y) AS n FROM sc) SELECT y, n, round(a, 6) AS threshold FROM k WHERE k = least(ceil((n + 1) * (1 - 0.1)), n)")
def conformal_threshold(spark, sf):
    return shown(T.conformal_thresholds(scores(spark, sf).withColumn("a", 1 - F.col("s")), "y", "a", 0.1, "doc_id"))


@query()
def em_prior(spark, sf):
    q, steps = T.em_prior(scores(spark, sf), 0.5)
    return spark.createDataFrame([(round(q, 6), steps)], "prior double, steps int")


# --- relational --------------------------------------------------------------------------------------------------


@query("SELECT o_orderpriority AS r, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1")
def crosstab_pivot(spark, sf):
    return read(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("r")).pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)


@query("""SELECT l_orderkey, l_linenumber, kind, value FROM (SELECT l_orderkey, l_linenumber, l_quantity AS quantity, l_discount AS discount, l_tax AS tax FROM lineitem) UNPIVOT (value FOR kind IN (quantity, discount, tax))""")
def unpivot_long(spark, sf):
    li = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return li.unpivot(["l_orderkey", "l_linenumber"], ["quantity", "discount", "tax"], "kind", "value")


@query("WITH d AS (SELECT DISTINCT c_nationkey FROM customer), m AS (SELECT DISTINCT c_mktsegment FROM customer), n AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) SELECT d.c_nationkey, m.c_mktsegment, coalesce(n.n, 0) AS n FROM d CROSS JOIN m LEFT JOIN n USING (c_nationkey, c_mktsegment)")
def grid_completion(spark, sf):
    c = read(spark, sf, "customer")
    grid = c.select("c_nationkey").distinct().crossJoin(F.broadcast(c.select("c_mktsegment").distinct()))  # two small dictionaries
    n = c.groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(n, ["c_nationkey", "c_mktsegment"], "left").na.fill(0, ["n"])


@query("""WITH a AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer), b AS (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier)
SELECT c_custkey, c_nationkey, coalesce(cast(s_suppkey AS VARCHAR), 'UNKNOWN') AS partner FROM a LEFT JOIN b ON c_nationkey = s_nationkey AND a.k = b.k""")
def positional_strata_join(spark, sf):
    a = read(spark, sf, "customer").withColumn("k", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")))
    b = read(spark, sf, "supplier").withColumn("k", F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")))
    j = a.join(b, (a["c_nationkey"] == b["s_nationkey"]) & (a["k"] == b["k"]), "left")
    return j.select("c_custkey", "c_nationkey", F.coalesce(F.col("s_suppkey").cast("string"), F.lit("UNKNOWN")).alias("partner"))


@query("""WITH m AS (SELECT p_type AS k, max(p_brand) AS v FROM part WHERE p_partkey % 5 = 0 GROUP BY 1) SELECT p_partkey, p_type, p_brand FROM part LEFT JOIN m ON p_type = k WHERE k IS NULL OR v = p_brand""")
def inconsistent_label_drop(spark, sf):
    p = read(spark, sf, "part")
    known = p.where("p_partkey % 5 = 0").groupBy(F.col("p_type").alias("k")).agg(F.max("p_brand").alias("v"))
    return p.join(known, p["p_type"] == known["k"], "left").where("k IS NULL OR v = p_brand").select("p_partkey", "p_type", "p_brand")


@query("""WITH a AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R'), u AS (SELECT l_partkey FROM a UNION SELECT l_partkey FROM b)
SELECT (SELECT count(*) FROM u) AS n_union, round(1 - (SELECT count(*) FROM u) / ((SELECT count(*) FROM a) + (SELECT count(*) FROM b)), 6) AS overlap""")
def set_overlap_rate(spark, sf):
    li = read(spark, sf, "lineitem").where("l_returnflag IN ('A', 'R')")
    per = li.groupBy("l_partkey").agg(F.countDistinct("l_returnflag").alias("sets"))
    return shown(per.agg(F.count(F.lit(1)).alias("n_union"), (1 - F.count(F.lit(1)) / F.sum("sets")).alias("overlap")))


@query("""WITH o AS (SELECT o_custkey AS k, o_orderkey AS version, o_totalprice AS v FROM orders WHERE o_orderkey % 2 = 0), n AS (SELECT o_custkey AS k, o_orderkey + 1000000000 AS version, o_totalprice AS v FROM orders WHERE o_orderkey % 2 = 1)
SELECT k, version, round(v, 6) AS v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY version DESC) AS r FROM (SELECT * FROM o UNION ALL SELECT * FROM n)) WHERE r = 1""")
def append_upsert(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("version"), F.col("o_totalprice").alias("v"))
    both = o.where("version % 2 = 0").unionByName(o.where("version % 2 = 1").withColumn("version", F.col("version") + 1000000000))
    return shown(both.groupBy("k").agg(F.max("version").alias("version"), F.max_by("v", "version").alias("v")))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join_gate(spark, sf):
    c, o = read(spark, sf, "customer"), read(spark, sf, "orders")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_join_filter(spark, sf):
    c, o = read(spark, sf, "customer").where("c_mktsegment = 'BUILDING'"), read(spark, sf, "orders")
    return o.join(c, o["o_custkey"] == c["c_custkey"], "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount >= 0.05 THEN 'high' WHEN l_discount > 0 THEN 'low' ELSE 'none' END AS level, greatest(1, least(10, l_quantity)) AS clipped FROM lineitem")
def conditional_clip(spark, sf):
    li = read(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.when(F.col("l_discount") >= 0.05, "high").when(F.col("l_discount") > 0, "low").otherwise("none").alias("level"), F.greatest(F.lit(1.0), F.least(F.lit(10.0), "l_quantity")).alias("clipped"))


@query("SELECT p_brand, count(*) AS n, count(*) FILTER (p_size >= 20) AS eligible, round(100.0 * (1 - count(*) FILTER (p_size >= 20) / count(*)), 6) AS pct_excluded, arg_max(p_partkey, cast(p_size AS BIGINT) * 100000000 + p_partkey) AS largest FROM part GROUP BY 1")
def exclusion_summary(spark, sf):
    return shown(read(spark, sf, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p_size") >= 20).alias("eligible"), (100.0 * (1 - F.count_if(F.col("p_size") >= 20) / F.count(F.lit(1)))).alias("pct_excluded"), F.max_by("p_partkey", F.col("p_size").cast("long") * 100000000 + F.col("p_partkey")).alias("largest")))


@query("SELECT event_id, cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def props_json(spark, sf):
    return read(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT page_id, nullif(regexp_extract(html, '<html lang=\"([^\"]+)\"', 1), '') AS lang, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title FROM pages")
def attr_parse(spark, sf):
    g = lambda p: F.nullif(F.regexp_extract("html", p, 1), F.lit(""))
    return read(spark, sf, "pages").select("page_id", g('<html lang="([^"]+)"').alias("lang"), g("<title>([^<]*)</title>").alias("title"))


@query("WITH n AS (SELECT p_partkey, concat('chr', p_size, ':', p_partkey * 10, '-', p_partkey * 10 + p_size) AS name FROM part) SELECT p_partkey, regexp_extract(name, '^(.+?)[:-](\\d+)-(\\d+)$', 1) AS chrom, (cast(regexp_extract(name, '^(.+?)[:-](\\d+)-(\\d+)$', 2) AS BIGINT) + cast(regexp_extract(name, '^(.+?)[:-](\\d+)-(\\d+)$', 3) AS BIGINT)) // 2 AS mid FROM n")
def regex_interval_parse(spark, sf):
    from limen.sources.genomic import interval_columns

    p = read(spark, sf, "part").select("p_partkey", F.concat(F.lit("chr"), "p_size", F.lit(":"), F.col("p_partkey") * 10, F.lit("-"), F.col("p_partkey") * 10 + F.col("p_size")).alias("name"))
    return p.select("p_partkey", *interval_columns("name"))


# --- sampling ----------------------------------------------------------------------------------------------------


@query(f"""WITH c AS (SELECT o_orderstatus AS celltype, o_custkey % 50 AS donor, o_orderkey AS cell, {_HN.format("concat('0|', o_orderkey)")} AS h FROM orders), t AS (SELECT *, row_number() OVER (PARTITION BY celltype, donor ORDER BY h, cell) - 1 AS turn FROM c),
p AS (SELECT *, row_number() OVER (PARTITION BY celltype ORDER BY turn, h, cell) AS pick FROM t) SELECT celltype, donor, cell, cast(turn AS INTEGER) AS turn, cast(pick AS INTEGER) AS pick FROM p WHERE pick <= 100""")
def balanced_sample_hash(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_orderstatus").alias("celltype"), (F.col("o_custkey") % 50).alias("donor"), F.col("o_orderkey").alias("cell"))
    return S.balanced_sample(o, 100)


@query("""WITH c AS (SELECT o_orderpriority AS celltype, o_orderkey AS cell, least(o_totalprice / 150000.0, (o_orderkey % 997) / 400.0) AS s FROM orders), k AS (SELECT celltype, s, row_number() OVER (PARTITION BY celltype ORDER BY s DESC, cell) AS k FROM c)
SELECT round(least(3.0, min(s)), 6) AS scale, count(*) AS types FROM k WHERE k = 50""")
def joint_depth_threshold(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_orderpriority").alias("celltype"), F.col("o_orderkey").alias("cell"), F.col("o_totalprice").alias("depth_a"), (F.col("o_orderkey") % 997).cast("double").alias("depth_r"))
    return shown(S.joint_depth_threshold(o, 50, 150000.0, 400.0))


@query()
def multinomial_downsample(spark, sf):
    c = counts(spark, sf).select(F.col("donor").cast("long").alias("cell"), "feature", "value").groupBy("cell", "feature").agg(F.sum("value").alias("value"))
    return S.multinomial_downsample(c, 500)


@query()
def caliper_match(spark, sf):
    c = read(spark, sf, "customer")
    of = lambda seg: c.where(F.col("c_mktsegment") == seg).select(F.col("c_nationkey").alias("stratum"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"))
    return S.caliper_match(of("BUILDING"), of("MACHINERY"), 500.0)


@query()
def greedy_decorrelate(spark, sf):
    r = _r(spark, sf).withColumn("gene", F.split("x", "-")[1])
    cand = r.select("gene", F.col("x").alias("peak"), "r").unionByName(r.select("gene", F.col("y").alias("peak"), "r")).groupBy("gene", "peak").agg(F.max(F.abs("r")).alias("strength"))
    return S.greedy_decorrelated(cand, r.select("gene", F.col("x").alias("p"), F.col("y").alias("q"), "r"), 0.1)


@query("SELECT label, pos - 1 AS dim, round(sum(v), 3) AS total, count(*) AS members FROM (SELECT label, unnest(cast(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2")
def aggregate_group_sums(spark, sf):
    e = read(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("dim", "v"))
    return e.groupBy("label", F.col("dim").cast("long").alias("dim")).agg(rounded(F.sum(F.col("v").cast("double")), 3).alias("total"), F.count(F.lit(1)).alias("members"))
