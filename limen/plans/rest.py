"""Queries of dictionaries, memberships, intervals of cohorts, jackknifes and features by type."""

from __future__ import annotations

from pyspark.sql import functions as F

from limen.functions.numeric import rounded
from limen.operators import cohorts as H
from limen.operators import composition as C
from limen.operators import expression as X
from limen.operators import features as Y
from limen.operators import links as L
from limen.operators import pairs as P
from limen.plans import added, more
from limen.plans import catalogue as K
from limen.plans.catalogue import query, shown
from limen.plans.domain import GENES, PAIRS, WINDOW, genes, pairs, peaks, read
from limen.sources.genomic import read_dictionary
from limen.sources.scratch import place, written

N_BOOT = 1000


def _hash(*parts: str) -> str:
    return f"cast(('0x' || substr(md5(concat({', '.join(parts)})), 1, 8)) AS BIGINT)"


@query('SELECT p_name AS name, p_brand AS kind, row_number() OVER (ORDER BY p_partkey) - 1 AS "index" FROM part')
def feature_dictionary(spark, sf):
    """Names written in order, read back with their places."""
    path = place(spark, "names")
    read(spark, sf, "part").orderBy("p_partkey").select("p_name", "p_brand").write.option("sep", "\t").option("quote", "\u0000").option("escape", "\u0000").csv(path)
    return read_dictionary(spark, path, "name string, kind string")


@query("""WITH m AS (SELECT o_orderkey AS cell, o_orderpriority AS aggregate FROM orders UNION ALL SELECT o_orderkey, concat('status-', o_orderstatus) FROM orders)
SELECT aggregate, l_partkey % 300 AS feature, cast(sum(cast(l_quantity AS BIGINT)) AS BIGINT) AS "count" FROM m JOIN lineitem ON cell = l_orderkey GROUP BY 1, 2""")
def aggregate_membership_sum(spark, sf):
    """Sums over aggregates that share cells."""
    o = read(spark, sf, "orders")
    members = o.select(F.col("o_orderpriority").alias("aggregate"), F.col("o_orderkey").alias("cell")).unionByName(o.select(F.concat(F.lit("status-"), "o_orderstatus").alias("aggregate"), F.col("o_orderkey").alias("cell")))
    c = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("cell"), (F.col("l_partkey") % 300).alias("feature"), F.col("l_quantity").cast("long").alias("value"))
    return X.aggregate_counts(c, members)


@query(f"WITH {GENES} SELECT gene, count(*) AS hits FROM bd GROUP BY 1 HAVING count(*) >= 2")
def band_genes_tested(spark, sf):
    """Genes with two peaks or more in their window."""
    hits = P.near_counts(genes(spark, sf), peaks(spark, sf), WINDOW, [(-WINDOW, True, WINDOW, False)], "gene")
    return hits.groupBy("gene").agg(F.sum(F.col("near")[0]).alias("hits")).where("hits >= 2")


@query(f"""WITH {PAIRS}, per AS (SELECT donor % 4 AS cohort, donor, sum(z * z / (2 / n_eff)) AS ss, count(*) AS m, row_number() OVER (PARTITION BY donor % 4 ORDER BY donor) - 1 AS i, count(*) OVER (PARTITION BY donor % 4) AS n FROM pz GROUP BY 1, 2),
dr AS (SELECT cohort, rep, {_hash("'0|'", "cohort", "'|'", "rep", "'|'", "i")} % n AS i FROM per, range({N_BOOT}) r(rep)),
k AS (SELECT cohort, rep, sqrt(sum(ss) / sum(m)) AS k FROM dr JOIN per USING (cohort, i) GROUP BY 1, 2)
SELECT cohort, n_pairs, n_donors, round(kappa, 6) AS kappa, round(lo, 6) AS lo, round(hi, 6) AS hi FROM (SELECT cohort, sqrt(sum(ss) / sum(m)) AS kappa, cast(sum(m) AS BIGINT) AS n_pairs, count(*) AS n_donors FROM per GROUP BY 1)
JOIN (SELECT cohort, quantile_cont(k, 0.025) AS lo, quantile_cont(k, 0.975) AS hi FROM k GROUP BY 1) USING (cohort)""")
def cohort_kappa_intervals(spark, sf):
    """Kappa by cohort with intervals of 1,000 replicates."""
    return shown(H.kappa_intervals(C.packaged_pairs(pairs(spark, sf)).withColumn("cohort", F.col("donor") % 4), "cohort", N_BOOT))


@query(f"""WITH {PAIRS}, t AS (SELECT row_number() OVER (ORDER BY celltype) - 1 AS i, count(*) OVER () AS n, kappa * kappa AS k2 FROM kt),
dr AS (SELECT rep, {_hash("'0|'", "rep", "'|'", "i")} % n AS i FROM t, range({N_BOOT}) r(rep)), k AS (SELECT rep, sqrt(avg(k2)) AS k FROM dr JOIN t USING (i) GROUP BY 1)
SELECT (SELECT round(sqrt(avg(k2)), 6) FROM t) AS kappa_rms_of_types, (SELECT count(*) FROM t) AS n_types, round(quantile_cont(k, 0.025), 6) AS lo, round(quantile_cont(k, 0.975), 6) AS hi FROM k""")
def type_rms_interval(spark, sf):
    """Root mean square of the types' kappas with an interval by types."""
    return shown(H.type_rms_interval(C.kappa_by(C.packaged_pairs(pairs(spark, sf)), "celltype"), N_BOOT))


@query(f"""WITH {GENES}, {K._LINK}, t AS (SELECT chrom, {K._ABCD} FROM lk GROUP BY 1), w AS (SELECT *, sum(a) OVER () AS ta, sum(b) OVER () AS tb, sum(c) OVER () AS tc, sum(d) OVER () AS td FROM t),
l AS (SELECT chrom, ln((ta + 0.5) * (td + 0.5) / ((tb + 0.5) * (tc + 0.5))) AS log_or, ln((ta - a + 0.5) * (td - d + 0.5) / ((tb - b + 0.5) * (tc - c + 0.5))) AS x FROM w),
r AS (SELECT *, row_number() OVER (ORDER BY round(abs(x - log_or), 9) DESC, chrom) AS k FROM l)
SELECT round(any_value(log_or), 6) AS log_or, round(min(x), 6) AS low, round(max(x), 6) AS high, string_agg(chrom, ',' ORDER BY k) FILTER (k <= 3) AS worst FROM r""")
def jackknife_summary(spark, sf):
    """Range of the log odds ratio when a chromosome is left out, and the three that move it most."""
    t = written(K._links(spark, sf).groupBy("chrom").agg(*K._table()), "odds")  # asked twice, pairs are met once
    return shown(L.leave_one_out_summary(t, "chrom"))


_RISING = K.ORACLES["ladder_weighted_fit"].replace("FROM m WHERE R > 0 AND S > 0", "FROM m WHERE R > 0 AND S > 0 AND rung >= 200")


@query(_RISING)
def ladder_rising_fit(spark, sf):
    """The ladder's line from the rung on where it rises."""
    t = H.weighted_ladder(L.mantel_haenszel(added._ladder(spark, sf), "n"), 2.45, 200)
    return t.select(*[rounded(c, 4).alias(c) for c in ("a", "b", "r")], *[rounded(c, 3).alias(c) for c in ("ln_n_at_1", "ln_n_at_target")])


@query(f"""WITH {GENES}, {K._LINK}, {K._STR}, m AS ({K._MH.format(k='chrom')}), e AS (SELECT chrom, ln(R / S) AS l, {K._SE} FROM m WHERE R > 0 AND S > 0),
f AS (SELECT l, l - 1.96 * se AS lo, l + 1.96 * se AS hi, ln(depth) AS x FROM e JOIN (SELECT event_type AS chrom, count(*) / count(DISTINCT user_id) AS depth FROM events GROUP BY 1) USING (chrom))
SELECT count(*) AS configs, count(*) FILTER (exp(lo) > 1) AS enriched, count(*) FILTER (exp(hi) < 1) AS depleted, round(regr_slope(l, x), 4) AS slope, round(corr(x, l), 4) AS r FROM f""")
def link_summary_depth(spark, sf):
    """How ln odds go with depth: events for each user."""
    depth = read(spark, sf, "events").groupBy(F.col("event_type").alias("chrom")).agg((F.count(F.lit(1)) / F.countDistinct("user_id")).alias("depth"))
    s = H.link_summary(L.mantel_haenszel(K._strata(spark, sf), "chrom").join(depth, "chrom"), "depth")
    return s.select("configs", "enriched", "depleted", rounded("slope", 4).alias("slope"), rounded("r", 4).alias("r"))


@query()
def paired_slope_null(spark, sf):
    """Slope of the observed floor in n_eff less that of its matched null, on the same donors, from four thresholds."""
    ratio = more.multinomial_null(spark, sf).join(K._floors(spark, sf).select("donor", "celltype", "n_eff"), ["donor", "celltype"]).where("observed > 0 AND expected > 0").persist()
    parts = []
    for least in (0, 10, 25, 50):
        d = H.paired_slopes(ratio.where(F.col("n_eff") >= least), "observed", "expected", N_BOOT)
        q = lambda p: rounded(F.percentile("difference", p), 4)
        parts.append(d.agg(F.count("difference").alias("reps"), q(0.025).alias("lo"), q(0.5).alias("mid"), q(0.975).alias("hi")).select(F.lit(least).alias("least_n_eff"), "*"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


DAY, WEEK = 86400, 7 * 86400


@query()
def features_by_type(spark, sf):
    """Redundancy, distal share, entropy and counts of three types of users: weeks are genes, days are peaks."""
    e = read(spark, sf, "events").select((F.col("user_id") % 3).cast("string").alias("celltype"), F.col("user_id").alias("cell"), F.col("event_type").alias("chrom"), F.expr("unix_seconds(cast(ts AS timestamp))").alias("s"))
    e = e.withColumns({"week": F.expr(f"s div {WEEK}"), "day": F.expr(f"s div {DAY}")})
    counted = lambda k, n: e.withColumn(n, F.concat_ws("-", "chrom", k)).groupBy("celltype", "cell", n).agg(F.count(F.lit(1)).alias("value"))
    places = lambda k, n, at, size: e.select(F.concat_ws("-", "chrom", k).alias(n), "chrom", (F.col(k) * size + size // 2).alias(at)).distinct()
    sizes = e.select("celltype", "cell").distinct().groupBy("celltype").agg(F.count(F.lit(1)).alias("n"))
    out = Y.features_by_type(counted("week", "gene"), counted("day", "peak"), places("week", "gene", "tss", WEEK), places("day", "peak", "mid", DAY), sizes, WEEK, 2 * DAY, subset=F.col("gene").startswith("c"))
    return shown(out)
