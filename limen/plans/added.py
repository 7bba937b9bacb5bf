"""Queries over cohorts, ladders and alignment."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from limen.functions.numeric import harmonic_n, rounded
from limen.operators import align as A
from limen.operators import cohorts as H
from limen.operators import composition as C
from limen.operators import links as L
from limen.operators import pairs as P
from limen.plans import catalogue as K
from limen.plans.catalogue import query, shown
from limen.plans.domain import CELLS, COUNTS, GENES, PAIRS, SCORES, WINDOW, cells, counts, genes, pairs, peaks, read, scores
from limen.sources.scratch import written

N_BOOT = 1000


def _hash(*parts: str) -> str:
    return f"cast(('0x' || substr(md5(concat({', '.join(parts)})), 1, 8)) AS BIGINT)"


# --- cohorts -----------------------------------------------------------------------------------------------------


@query(f"""WITH {PAIRS} SELECT donor % 4 AS cohort, count(*) AS n_pairs, count(DISTINCT donor) AS n_donors, round(sqrt(avg(power(z / sqrt(2 / n_eff), 2))), 6) AS kappa,
round(regr_slope(ln(abs(z) + 1e-12), ln(n_eff)), 4) AS exponent FROM pz GROUP BY 1""")
def cohort_kappa_table(spark, sf):
    t = H.kappa_of_cohorts(C.packaged_pairs(pairs(spark, sf)).withColumn("cohort", F.col("donor") % 4), "cohort")
    return shown(t.withColumn("exponent", rounded("exponent", 4)))


@query(f"""WITH {PAIRS}, o AS (SELECT donor % 2 AS cohort, donor, ln(n_eff) AS x, ln(abs(z) + 1e-12) AS y FROM pz),
per AS (SELECT cohort, donor, count(*) AS m, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, row_number() OVER (PARTITION BY cohort ORDER BY donor) - 1 AS i, count(*) OVER (PARTITION BY cohort) AS n FROM o GROUP BY 1, 2),
dr AS (SELECT cohort, rep, {_hash("cohort", "'|'", "rep", "'|'", "i")} % n AS i FROM per, range({N_BOOT}) r(rep)),
b AS (SELECT cohort, rep, (sum(m) * sum(sxy) - sum(sx) * sum(sy)) / nullif(sum(m) * sum(sxx) - sum(sx) * sum(sx), 0) AS b FROM dr JOIN per USING (cohort, i) GROUP BY 1, 2),
d AS (SELECT x.b - y.b AS d FROM b x JOIN b y USING (rep) WHERE x.cohort = 0 AND y.cohort = 1)
SELECT round((SELECT regr_slope(y, x) FROM o WHERE cohort = 0) - (SELECT regr_slope(y, x) FROM o WHERE cohort = 1), 4) AS difference, round(quantile_cont(d, 0.025), 4) AS lo, round(quantile_cont(d, 0.975), 4) AS hi,
round(2 * least(avg(CASE WHEN d <= 0 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN d >= 0 THEN 1.0 ELSE 0.0 END)), 6) AS p_two_sided FROM d""")
def exponent_diff_boot(spark, sf):
    p = C.packaged_pairs(pairs(spark, sf))
    d = H.exponent_difference(p.where(F.col("donor") % 2 == 0), p.where(F.col("donor") % 2 == 1), N_BOOT)
    return d.select(*[rounded(c, 4).alias(c) for c in ("difference", "lo", "hi")], rounded("p_two_sided").alias("p_two_sided"))


@query(f"""WITH {PAIRS}, t AS (SELECT ln(kappa) AS y, ln(mean_fraction) AS x, left(celltype, 1) AS cls, CASE WHEN kappa > 1 THEN ln(kappa * kappa - 1) END AS v, ln(mean_fraction / (1 - mean_fraction)) AS o FROM kt),
c AS (SELECT *, y - avg(y) OVER (PARTITION BY cls) AS cy, x - avg(x) OVER (PARTITION BY cls) AS cx FROM t)
SELECT round(regr_slope(y, x), 5) AS gamma, round(sum(cx * cy) / nullif(sum(cx * cx), 0), 5) AS gamma_class, round(regr_slope(v, o), 5) AS over_slope, round(stddev_samp(y), 5) AS sd_ln_kappa FROM c""")
def abundance_model_fit(spark, sf):
    t = H.abundance_model(C.kappa_by(C.packaged_pairs(pairs(spark, sf)), "celltype"), F.substring("celltype", 1, 1))
    return t.select(*[rounded(c, 5).alias(c) for c in t.columns])


_SLOPE = "(sum(w * m) * sum(w * sx{0}) - sum(w * sx) * sum(w * s{0})) / nullif(sum(w * m) * sum(w * sxx) - sum(w * sx) * sum(w * sx), 0)"


@query(f"""WITH {COUNTS}, o AS (SELECT donor, ln(n_eff) AS x, ln(floor) AS y, ln(1.000001 - r) AS z FROM fl),
per AS (SELECT donor, count(*) AS m, sum(x) AS sx, sum(y) AS sy, sum(z) AS sz, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(x * z) AS sxz FROM o GROUP BY 1), {K._MULT.format(per="per", b=N_BOOT)},
d AS (SELECT {_SLOPE.format("y")} - {_SLOPE.format("z")} AS d FROM mu JOIN per USING (donor) GROUP BY rep)
SELECT count(d) AS reps, round(quantile_cont(d, 0.025), 4) AS lo, round(median(d), 4) AS mid, round(quantile_cont(d, 0.975), 4) AS hi FROM d""")
def paired_slope_difference(spark, sf):
    d = H.paired_slopes(K._floors(spark, sf).withColumn("apart", 1.000001 - F.col("r")), "floor", "apart", N_BOOT)
    return d.agg(F.count("difference").alias("reps"), *[rounded(F.percentile("difference", q), 4).alias(c) for c, q in (("lo", 0.025), ("mid", 0.5), ("hi", 0.975))])


@query("""WITH l AS (SELECT l_suppkey, ln(count(*)) AS x, ln(count(DISTINCT l_partkey)) AS y, ln(avg(cast(l_quantity AS BIGINT))) AS z FROM lineitem GROUP BY 1),
r AS (SELECT count(*) AS libraries, regr_slope(y, x) AS b, corr(x, y) AS xy, corr(z, y) AS yz, corr(x, z) AS xz FROM l)
SELECT libraries, round(b, 5) AS b, round(xy, 5) AS raw_r, round(yz, 5) AS depth_r, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 5) AS partial_r FROM r WHERE libraries >= 8""")
def link_saturation(spark, sf):
    lib = read(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_partkey").alias("links"), F.avg(F.col("l_quantity").cast("long")).alias("depth"))
    t = H.saturation(lib, "n", "links", "depth")
    return t.select("libraries", *[rounded(c, 5).alias(c) for c in t.columns[1:]])


@query(f"""WITH {COUNTS}, u AS (SELECT donor, celltype, count(*) FILTER (lib = 0) AS n1, count(*) FILTER (lib = 1) AS n2, median(value) FILTER (lib = 0) AS u1, median(value) FILTER (lib = 1) AS u2 FROM cnt GROUP BY 1, 2)
SELECT donor, celltype, round(2.0 / (1.0 / n1 + 1.0 / n2), 6) AS n_eff, round(abs(log2(greatest(u1, 1) / greatest(u2, 1))), 6) AS proxy_floor FROM u WHERE n1 >= 5 AND n2 >= 5""")
def umi_proxy_floor(spark, sf):
    of = lambda k: F.when(F.col("lib") == k, F.col("value"))
    m = counts(spark, sf).groupBy("donor", "celltype").agg(F.count(of(0)).alias("n1"), F.count(of(1)).alias("n2"), F.median(of(0)).alias("u1"), F.median(of(1)).alias("u2"))
    return shown(H.umi_proxy(m).select("donor", "celltype", harmonic_n("n1", "n2").alias("n_eff"), "proxy_floor"))


# --- ladders -----------------------------------------------------------------------------------------------------

_TP = "count(*) FILTER (prox) AS tp, count(*) FILTER (NOT prox) AS tn"


@query(f"""WITH {GENES}, {K._LINK}, x AS (SELECT chrom, rep, prox, link, {_hash("'null|'", "rep", "'|'", "gene", "'|'", "peak")} % 100 < 18 AS nl FROM lk, range(10) r(rep)),
t AS (SELECT chrom, rep, {K._ABCD.split(", count(*) FILTER (NOT link AND prox)")[0]}, count(*) FILTER (nl AND prox) AS na, count(*) FILTER (nl AND NOT prox) AS nb, {_TP} FROM x GROUP BY 1, 2),
o AS (SELECT chrom, (a + 0.5) * (tn + 0.5) / ((b + 0.5) * (tp + 0.5)) AS o, (na + 0.5) * (tn + 0.5) / ((nb + 0.5) * (tp + 0.5)) AS n FROM t)
SELECT chrom, round(min(o), 5) AS observed_or, round(median(n), 5) AS null_median, round(min(n), 5) AS null_min, round(max(n), 5) AS null_max, round(stddev_samp(n) / avg(n), 5) AS null_cv,
round(median(o / n), 5) AS positional_median, round(min(o / n), 5) AS positional_min, round(max(o / n), 5) AS positional_max, count(*) AS n_reps FROM o GROUP BY 1""")
def null_stability_summary(spark, sf):
    reps = 10
    k = K._links(spark, sf, marks=[K.LINK, *[(f"null|{r}|", 18, 18) for r in range(reps)]])
    at = lambda n, near: F.sum(F.when((F.col("d") == 0) == near, n).otherwise(0))
    rep = F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep")
    k = k.select("chrom", "d", "n", F.col("marked")[0].alias("link"), "marked", rep).withColumn("null", F.col("marked")[F.col("rep")])
    t = k.groupBy("chrom", "rep").agg(*[at(F.col(c), near).alias(f"{k}{i}") for c, k in (("link", "l"), ("null", "n"), ("n", "t")) for i, near in enumerate((True, False))])
    t = t.withColumnsRenamed({"l0": "a", "l1": "b", "n0": "na", "n1": "nb", "t0": "tp", "t1": "tn"})
    a, b, na, nb, tp, tn = (F.col(c) for c in ("a", "b", "na", "nb", "tp", "tn"))
    s = H.null_stability(t.select("chrom", L.haldane(a, b, tp, tn).alias("observed"), L.haldane(na, nb, tp, tn).alias("null")), "chrom")
    return s.select("chrom", "n_reps", *[rounded(c, 5).alias(c) for c in s.columns if c not in ("chrom", "n_reps")])


_LADDER = f"t AS (SELECT 100 * (1 + user_id % 4) AS n, peak % 3 AS seed, {K._ABCD} FROM lk GROUP BY 1, 2)"


def _ladder(spark, sf):
    k = K._links(spark, sf, 100 * (1 + F.col("user_id") % 4), F.col("peak") % 3)
    hit = k.withColumnsRenamed({"g": "rung", "p": "seed"})
    return hit.groupBy("rung", "seed").agg(*K._table()).withColumnRenamed("rung", "n")


@query(f"""WITH {GENES}, {K._LINK}, {_LADDER}, h AS (SELECT n, seed, CASE WHEN least(a, b, c, d) = 0 THEN 0.5 ELSE 0 END AS h, a, b, c, d FROM t),
e AS (SELECT n, seed, (a + h) * (d + h) / cast(a + b + c + d + 4 * h AS DOUBLE) AS r, (b + h) * (c + h) / cast(a + b + c + d + 4 * h AS DOUBLE) AS s, row_number() OVER (PARTITION BY n ORDER BY seed) - 1 AS i, count(*) OVER (PARTITION BY n) AS k FROM h),
p AS (SELECT n, ln(sum(r) / sum(s)) AS l FROM e GROUP BY 1), pt AS (SELECT regr_slope(l, ln(n)) AS slope, count(l) AS points FROM p),
dr AS (SELECT n, rep, {_hash("rep", "'|'", "n", "'|'", "i")} % k AS i FROM e, range({N_BOOT}) t(rep)), q AS (SELECT rep, n, ln(sum(r) / sum(s)) AS l FROM dr JOIN e USING (n, i) GROUP BY 1, 2),
b AS (SELECT regr_slope(l, ln(n)) AS b FROM q GROUP BY rep) SELECT round(slope, 5) AS slope, points, round(lo, 5) AS lo, round(hi, 5) AS hi FROM pt, (SELECT quantile_cont(b, 0.025) AS lo, quantile_cont(b, 0.975) AS hi FROM b)""")
def line_slope_seeds(spark, sf):
    t = H.line_slope(written(_ladder(spark, sf), "ladder"), N_BOOT)  # asked several times, pairs are met once
    return t.select("points", *[rounded(c, 5).alias(c) for c in ("slope", "lo", "hi")])


@query(f"""WITH {GENES}, {K._LINK}, {_LADDER.replace('AS n,', 'AS rung,')}, m AS ({K._MH.format(k='rung')}), e AS (SELECT ln(rung) AS x, ln(R / S) AS y, 1 / ({K._SE.split(' AS ')[0]} * {K._SE.split(' AS ')[0]}) AS w FROM m WHERE R > 0 AND S > 0),
s AS (SELECT sum(w) AS w, sum(w * x) AS x, sum(w * y) AS y, sum(w * x * x) AS xx, sum(w * x * y) AS xy, corr(x, y) AS r FROM e), l AS (SELECT *, (w * xy - x * y) / nullif(w * xx - x * x, 0) AS b FROM s), f AS (SELECT *, (y - b * x) / w AS a FROM l)
SELECT round(a, 4) AS a, round(b, 4) AS b, round(r, 4) AS r, round(-a / b, 3) AS ln_n_at_1, round((ln(2.45) - a) / b, 3) AS ln_n_at_target FROM f""")
def ladder_weighted_fit(spark, sf):
    t = H.weighted_ladder(L.mantel_haenszel(_ladder(spark, sf), "n"), 2.45)
    return t.select(*[rounded(c, 4).alias(c) for c in ("a", "b", "r")], *[rounded(c, 3).alias(c) for c in ("ln_n_at_1", "ln_n_at_target")])


@query(f"""WITH {GENES}, {K._LINK}, {K._STR}, m AS ({K._MH.format(k='chrom')}), e AS (SELECT chrom, ln(R / S) AS l, {K._SE} FROM m WHERE R > 0 AND S > 0), f AS (SELECT l, l - 1.96 * se AS lo, l + 1.96 * se AS hi, ln(n) AS x FROM e JOIN (SELECT chrom, sum(a + b) AS n FROM t GROUP BY 1) USING (chrom))
SELECT count(*) AS configs, count(*) FILTER (exp(lo) > 1) AS enriched, count(*) FILTER (exp(hi) < 1) AS depleted, round(regr_slope(l, x), 4) AS slope, round(corr(x, l), 4) AS r FROM f""")
def link_summary_flags(spark, sf):
    t = written(K._strata(spark, sf), "strata")  # asked twice, pairs are met once
    n = t.groupBy("chrom").agg(F.sum(F.col("a") + F.col("b")).alias("n"))
    s = H.link_summary(L.mantel_haenszel(t, "chrom").join(n, "chrom"))
    return s.select("configs", "enriched", "depleted", rounded("slope", 4).alias("slope"), rounded("r", 4).alias("r"))


@query("""WITH g AS (SELECT power(10.0, 2 + 3 * i / 119.0) AS n_link, o FROM range(120) t(i), (VALUES (3.0::DOUBLE), (2.0), (1.5)) v(o)), p AS (SELECT *, o * 0.0095::DOUBLE / (1 - 0.0095::DOUBLE + o * 0.0095::DOUBLE) AS p1 FROM g)
SELECT o AS odds_ratio, round(n_link, 3) AS n_link, round((p1 - 0.0095::DOUBLE) / sqrt(p1 * (1 - p1) / n_link + 0.0095::DOUBLE * (1 - 0.0095::DOUBLE) / 3030000.0::DOUBLE), 5) AS z FROM p""")
def power_curve_odds(spark, sf):
    return H.power_curve(spark, [3.0, 2.0, 1.5], 0.0095, 3.03e6).select("odds_ratio", rounded("n_link", 3).alias("n_link"), rounded("z", 5).alias("z"))


@query(f"""WITH {SCORES}, k AS (SELECT y, CASE WHEN y = 1 THEN 1 - s ELSE s END AS a, row_number() OVER (PARTITION BY y ORDER BY CASE WHEN y = 1 THEN 1 - s ELSE s END, doc_id) AS k, count(*) OVER (PARTITION BY y) AS n FROM sc),
q AS (SELECT y, a FROM k WHERE k = least(ceil((n + 1) * (1 - 0.1)), n)), t AS (SELECT y, s <= (SELECT a FROM q WHERE y = 0) AS in0, 1 - s <= (SELECT a FROM q WHERE y = 1) AS in1 FROM sc), h AS (SELECT *, cast(CASE WHEN y = 1 THEN in1 ELSE in0 END AS INTEGER) AS hit FROM t)
SELECT count(*) AS n, round(avg(hit), 6) AS coverage, round(avg(hit) FILTER (y = 0), 6) AS coverage_0, round(avg(hit) FILTER (y = 1), 6) AS coverage_1, round(avg(cast(in0 <> in1 AS INTEGER)), 6) AS singleton_share FROM h""")
def conformal_coverage(spark, sf):
    return shown(H.conformal_coverage(scores(spark, sf), "y", "s", 0.1, "doc_id"))


@query(f"WITH {SCORES}, n AS (SELECT count(*) FILTER (y = 0) AS a, count(*) FILTER (y = 1) AS b FROM sc) SELECT doc_id, round(least(20.0, greatest(0.05, s / greatest(1 - s, 1e-6) * a / greatest(b, 1))), 6) AS weight FROM sc, n WHERE y = 0")
def domain_ratio_weights(spark, sf):
    return shown(H.domain_weights(scores(spark, sf), "y", "s").select("doc_id", "weight"))


# --- alignment ---------------------------------------------------------------------------------------------------


@query("""WITH n AS (SELECT l_suppkey AS donor, l_partkey AS feature, l_orderkey % 2 AS lib, count(*) AS n FROM lineitem GROUP BY 1, 2, 3)
SELECT a.donor, a.feature, a.n AS n1, b.n AS n2 FROM n a JOIN n b USING (donor, feature) WHERE a.lib = 0 AND b.lib = 1""")
def intersection_alignment(spark, sf):
    n = read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("donor"), F.col("l_partkey").alias("feature")).agg(*[F.count(F.when(F.col("l_orderkey") % 2 == k, 1)).alias(f"n{k + 1}") for k in (0, 1)])
    return n.where("n1 > 0 AND n2 > 0")  # one aggregate, no join


@query(f"""WITH {GENES}, d AS (SELECT user_id, chrom AS tchrom, mid AS tss FROM pk QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY mid, peak) = 1)
SELECT peak, user_id, mid - tss AS distance FROM pk JOIN d USING (user_id) WHERE chrom = tchrom AND abs(mid - tss) <= {WINDOW}""")
def dictionary_lookup(spark, sf):
    p = peaks(spark, sf)
    first = A.keep_first(p, "user_id", "mid", "peak").select("user_id", F.col("chrom").alias("tchrom"), F.col("mid").alias("tss"))
    return A.lookup(p, first, "user_id", WINDOW).select("peak", "user_id", "distance")


@query("""WITH k AS (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS new_id FROM nation WHERE n_regionkey <> 2)
SELECT s_suppkey, coalesce(new_id, -1) AS new_id FROM supplier LEFT JOIN k ON s_nationkey = n_nationkey""")
def dense_remap(spark, sf):
    ids = A.dense_ids(read(spark, sf, "nation").where("n_regionkey <> 2").withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey")
    return A.remapped(read(spark, sf, "supplier"), ids, "s_nationkey").select("s_suppkey", "new_id")


@query("""WITH a AS (SELECT concat('b', c_custkey, '-', c_nationkey) AS raw FROM customer), b AS (SELECT concat('b', o_custkey) AS code, min(o_orderkey) AS pos FROM orders GROUP BY 1)
SELECT raw, coalesce(pos, -1) AS pos FROM a LEFT JOIN b ON regexp_replace(raw, '-[0-9]+$', '') = code""")
def barcode_alignment(spark, sf):
    a = read(spark, sf, "customer").select(F.concat(F.lit("b"), "c_custkey", F.lit("-"), "c_nationkey").alias("raw")).withColumn("code", A.barcode("raw"))
    b = read(spark, sf, "orders").groupBy(F.concat(F.lit("b"), "o_custkey").alias("code")).agg(F.min("o_orderkey").alias("pos"))
    return a.join(b, "code", "left").select("raw", F.coalesce("pos", F.lit(-1)).alias("pos"))


@query("""SELECT count(*) FILTER (b.k IS NULL) AS only_first, count(*) FILTER (a.k IS NULL) AS only_second FROM (SELECT DISTINCT c_custkey AS k FROM customer) a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders) b ON a.k = b.k""")
def key_assertion(spark, sf):
    return A.unmatched(read(spark, sf, "customer").select(F.col("c_custkey").alias("k")), read(spark, sf, "orders").select(F.col("o_custkey").alias("k")), "k")


@query(f"WITH {GENES}, {K._LINK}, o AS (SELECT DISTINCT gene, peak FROM lk WHERE link AND user_id % 2 = 0) SELECT gene, peak, prox FROM lk WHERE (gene, peak) IN (SELECT gene, peak FROM o)")
def restrict_to_tested(spark, sf):
    even = genes(spark, sf).where(F.col("user_id") % 2 == 0)  # a pair's gene is that of the linked one
    linked = lambda p: P.linked_pairs(even, p, WINDOW, K.LINK, K.NEAR)
    sure = linked(peaks(spark, sf)).where("sure")
    # a link is its own match; another row of the same pair only comes from an id that stands twice. Pairs are never
    # joined with those ids, as that would shuffle them all where the ids are too many to be broadcast: peaks are
    twice = peaks(spark, sf).groupBy("peak").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("peak")
    again = linked(written(peaks(spark, sf).join(twice, "peak", "left_semi"), "twice"))
    more = again.where("NOT sure").join(again.where("sure").select("gene", "peak"), ["gene", "peak"], "left_semi")
    return sure.unionByName(more).select("gene", "peak", "prox")


@query("SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def keep_first_order(spark, sf):
    return A.keep_first(read(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderpriority")


@query(f"WITH {GENES}, {K._LINK}, {K._BAND} SELECT cast(band AS INTEGER) AS bin, cast(sum(reference) AS BIGINT) AS total FROM bc WHERE band IS NOT NULL GROUP BY 1")
def histogram_stack_sum(spark, sf):
    # what lies nearer than each edge; the last one, of the window, holds its lower end
    spans = [(-e, False, e, False) for e in K.EDGES[:-1]] + [(-WINDOW, True, WINDOW, False)]
    k = P.near_counts(genes(spark, sf).withColumn("seed", F.col("user_id") % 3), peaks(spark, sf), WINDOW, spans, "seed")
    each = k.groupBy("seed").agg(F.array(*[F.sum(F.col("near")[i + 1] - F.col("near")[i]) for i in range(len(K.EDGES) - 1)]).alias("values"))
    return A.stacked(each, "values").where("total > 0")


@query("""SELECT c_custkey, cast(c_mktsegment = 'BUILDING' AS INTEGER) AS "is_BUILDING", cast(c_mktsegment = 'FURNITURE' AS INTEGER) AS "is_FURNITURE", cast(c_mktsegment = 'HOUSEHOLD' AS INTEGER) AS "is_HOUSEHOLD", cast(c_mktsegment = 'MACHINERY' AS INTEGER) AS "is_MACHINERY" FROM customer""")
def one_hot_segment(spark, sf):
    return A.one_hot(read(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]).drop("c_mktsegment")


@query(f"WITH {PAIRS} SELECT celltype, round(min(n_eff), 6) AS lo, round(max(n_eff), 6) AS hi, round(median(n_eff), 6) AS mid, round(max(n_eff) / min(n_eff), 6) AS span FROM pz GROUP BY 1")
def n_eff_span(spark, sf):
    n = F.col("n_eff")
    return shown(C.packaged_pairs(pairs(spark, sf)).groupBy("celltype").agg(F.min(n).alias("lo"), F.max(n).alias("hi"), F.median(n).alias("mid"), (F.max(n) / F.min(n)).alias("span")))


@query(f"WITH {CELLS}, t AS (SELECT split_part(feature, '-', 1) AS family, obs, sum(value) AS total FROM ob GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY total DESC, obs) AS k FROM t) SELECT family, count(*) AS picked, min(total) AS target FROM k WHERE k <= 20 GROUP BY 1")
def equal_depth_target(spark, sf):
    t = cells(spark, sf).groupBy(F.split("feature", "-")[0].alias("family"), "obs").agg(F.sum("value").alias("total"))
    k = F.row_number().over(Window.partitionBy("family").orderBy(F.desc("total"), "obs"))
    return t.withColumn("k", k).where("k <= 20").groupBy("family").agg(F.count(F.lit(1)).alias("picked"), F.min("total").alias("target"))


@query(f"WITH {CELLS}, t AS (SELECT split_part(feature, '-', 1) AS family, obs, sum(value) AS total FROM ob GROUP BY 1, 2) SELECT family, count(*) FILTER (total >= 3) AS deep, count(*) FILTER (total >= 3) >= 30 AS enough FROM t GROUP BY 1")
def depth_gate(spark, sf):
    t = cells(spark, sf).groupBy(F.split("feature", "-")[0].alias("family"), "obs").agg(F.sum("value").alias("total"))
    return t.groupBy("family").agg(F.count_if(F.col("total") >= 3).alias("deep")).withColumn("enough", F.col("deep") >= 30)


@query(f"WITH {CELLS} SELECT feature, count(DISTINCT obs) AS n FROM ob WHERE value > 0 GROUP BY 1 HAVING count(DISTINCT obs) >= 0.1 * (SELECT count(DISTINCT obs) FROM ob)")
def detection_filter(spark, sf):
    return A.detected(cells(spark, sf))


@query(f"WITH {CELLS} SELECT obs, feature, round(log2(value * 1e4 / sum(value) OVER (PARTITION BY obs) + 1), 6) AS x FROM ob")
def scale_log2(spark, sf):
    return shown(cells(spark, sf).select("obs", "feature", A.scaled_log2("value", "obs").alias("x")))


@query(f"WITH {PAIRS} SELECT donor, celltype, round(n_eff / median(n_eff) OVER (PARTITION BY celltype), 6) AS relative FROM pz")
def median_normalised(spark, sf):
    return shown(C.packaged_pairs(pairs(spark, sf)).select("donor", "celltype", A.by_median("n_eff", "celltype").alias("relative")))


@query("""WITH a AS (SELECT l_orderkey * 10 + l_linenumber AS pos, min(l_partkey) AS v FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey * 10 + l_linenumber AS pos, max(l_partkey) AS v FROM lineitem WHERE l_linenumber < 6 GROUP BY 1)
SELECT count(*) AS places, count(*) FILTER (a.v IS DISTINCT FROM b.v) AS mismatches FROM a FULL JOIN b ON a.pos = b.pos""")
def ordered_equality(spark, sf):
    li = read(spark, sf, "lineitem").withColumn("pos", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return A.order_mismatches(li.groupBy("pos").agg(F.min("l_partkey").alias("v")), li.where("l_linenumber < 6").groupBy("pos").agg(F.max("l_partkey").alias("v")), "pos", "v")


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'fast' ELSE 'slow' END AS cls, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status FROM orders""")
def value_recode(spark, sf):
    fast = F.col("o_orderpriority").startswith("1") | F.col("o_orderpriority").startswith("2")
    named = F.create_map(*[F.lit(x) for x in ("F", "done", "O", "open")])
    return read(spark, sf, "orders").select("o_orderkey", F.when(fast, "fast").otherwise("slow").alias("cls"), F.coalesce(named[F.col("o_orderstatus")], "o_orderstatus").alias("status"))


@query("SELECT o_custkey, min(o_orderstatus) AS o_orderstatus, count(*) AS n FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 1 AND count(*) >= 2")
def single_group_keys(spark, sf):
    return A.single_group(read(spark, sf, "orders"), "o_custkey", "o_orderstatus", 2)


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")
def n_deepest(spark, sf):
    return read(spark, sf, "lineitem").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(25).select("l_orderkey", "l_linenumber", "l_extendedprice")
