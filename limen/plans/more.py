"""Further queries of the catalogue: nulls, calibration by donors, embeddings, learning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from limen.functions.numeric import hash_number, rounded
from limen.operators import embedding as E
from limen.operators import expression as X
from limen.operators import latent as Z
from limen.operators import learning as G
from limen.operators import links as L
from limen.operators import neighbours as N
from limen.operators import tests as T
from limen.operators.composition import indexed_donors
from limen.plans import catalogue as K
from limen.plans.catalogue import query, shown
from limen.plans.domain import CELLS, COUNTS, GENES, SCORES, cells, read, scores


@query(f"""WITH {GENES}, {K._LINK}, t AS (SELECT chrom, count(*) FILTER (link) AS n, count(*) AS m FROM lk GROUP BY 1), w AS (SELECT *, sum(n) OVER () - n AS rn, sum(m - n) OVER () - (m - n) AS rm FROM t)
SELECT chrom, round((n + 0.5) * (rm + 0.5) / ((m - n + 0.5) * (rn + 0.5)), 6) AS odds_ratio FROM w""")
def category_odds_internal(spark, sf):
    hit = F.col("marked")[0]
    t = K._links(spark, sf).groupBy("chrom").agg(F.sum(hit).alias("n"), F.sum(F.col("n") - hit).alias("o"))
    w = Window.partitionBy()  # a row for each category
    rest = lambda c: F.sum(c).over(w) - F.col(c)
    return shown(t.select("chrom", L.haldane(F.col("n"), F.col("o"), rest("n"), rest("o")).alias("odds_ratio")))


_NULLT = f"""lk2 AS (SELECT *, cast(('0x' || substr(md5(concat('null|', gene, '|', peak)), 1, 8)) AS BIGINT) % 100 < 18 AS nl FROM lk),
nt AS (SELECT chrom, user_id % 3 AS seed, {K._ABCD}, count(*) FILTER (nl AND prox) AS na, count(*) FILTER (nl AND NOT prox) AS nb FROM lk2 GROUP BY 1, 2)"""


@query(f"""WITH {GENES}, {K._LINK}, {_NULLT}, x AS (SELECT chrom, seed, a, b, na AS c, nb AS d, bool_or(least(a, b, na, nb) = 0) OVER (PARTITION BY chrom) AS h FROM nt),
t AS (SELECT chrom, a + CASE WHEN h THEN 0.5 ELSE 0 END AS a, b + CASE WHEN h THEN 0.5 ELSE 0 END AS b, c + CASE WHEN h THEN 0.5 ELSE 0 END AS c, d + CASE WHEN h THEN 0.5 ELSE 0 END AS d FROM x),
m AS ({K._MH.format(k='chrom')}), e AS (SELECT *, {K._SE} FROM m WHERE R > 0 AND S > 0) SELECT chrom, {K._MHE} FROM e""")
def positional_or_vs_null(spark, sf):
    k = K._links(spark, sf, F.col("user_id") % 3, marks=[K.LINK, ("null|", 18, 18)])
    side = lambda m, near: F.sum(F.when((F.col("d") == 0) == near, F.col("marked")[m]).otherwise(0)).cast("double")
    t = k.groupBy("chrom", F.col("g").alias("seed")).agg(side(0, True).alias("a"), side(0, False).alias("b"), side(1, True).alias("c"), side(1, False).alias("d"))
    return shown(L.mantel_haenszel(t, "chrom", correct=True))


@query(f"""WITH {K._R}, {K._P}, k AS (SELECT *, p * count(*) OVER (PARTITION BY fam) / row_number() OVER (PARTITION BY fam ORDER BY p, test) AS raw FROM ps),
q AS (SELECT test, least(1.0, min(raw) OVER (PARTITION BY fam ORDER BY p DESC, test DESC ROWS UNBOUNDED PRECEDING)) AS q FROM k), v AS (SELECT feature, split_part(feature, '-', 1) AS fam, sum(value * value) AS v FROM ob GROUP BY 1, 2),
vq AS (SELECT feature, (rank() OVER (PARTITION BY fam ORDER BY v) + (count(*) OVER (PARTITION BY fam, v) - 1) / 2.0) / count(*) OVER (PARTITION BY fam) AS z FROM v)
SELECT x, y, round(r, 6) AS r, round(q, 6) AS q FROM rr JOIN q ON test = concat(x, '|', y) JOIN vq a ON a.feature = x JOIN vq b ON b.feature = y WHERE round(r, 6) >= 0.02 AND round(q, 6) <= 0.5 AND a.z > 0.25 AND b.z > 0.25""")
def archr_style_links(spark, sf):
    r = K._r(spark, sf)
    q = L.bh_q(K._p(spark, sf), "fam").select("test", "q")
    tests = r.withColumn("test", F.concat_ws("|", "x", "y")).join(q, "test").select("x", "y", rounded("r").alias("r"), rounded("q").alias("q"))
    v = cells(spark, sf).groupBy("feature", F.split("feature", "-")[0].alias("fam")).agg(F.sum(F.col("value") * F.col("value")).alias("v"))
    return L.strict_links(tests, v.select("feature", L.quantile_rank("v", "fam").alias("quantile")), 0.02, 0.5)


_CURVE = f"""WITH {COUNTS}, {K._SUMS}, dn AS (SELECT donor, row_number() OVER (ORDER BY donor) - 1 AS i, count(*) OVER () AS n FROM per),
dr AS (SELECT m AS k, rep, cast(('0x' || substr(md5(concat('0|', m, '|', rep, '|', j)), 1, 8)) AS BIGINT) % (SELECT max(n) FROM dn) AS i FROM (VALUES (4), (8), (16)) t(m), range(60) r(rep), range(16) d(j) WHERE j < m),
b AS (SELECT k, rep, (sum(m) * sum(sxy) - sum(sx) * sum(sy)) / nullif(sum(m) * sum(sxx) - sum(sx) * sum(sx), 0) AS b FROM dr JOIN dn USING (i) JOIN per USING (donor) GROUP BY 1, 2)
SELECT cast(k AS INTEGER) AS donors, count(b) AS reps, round(quantile_cont(b, 0.025), 5) AS lo, round(quantile_cont(b, 0.5), 5) AS mid, round(quantile_cont(b, 0.975), 5) AS hi FROM b GROUP BY 1"""


@query(_CURVE)
def calibration_curve_donors(spark, sf):
    per = X.slope_sums(K._floors(spark, sf))
    donors = indexed_donors(per)
    grid = spark.range(60).withColumnRenamed("id", "rep").withColumn("k", F.explode(F.array(F.lit(4), F.lit(8), F.lit(16)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    n = donors.agg(F.max("n").alias("n"))
    drawn = grid.crossJoin(n).select("k", "rep", (hash_number(F.lit(0), "k", "rep", "j") % F.col("n")).alias("i")).join(donors.select("i", "donor"), "i").join(per, "donor")
    s = {c: F.sum(c) for c in ("m", "sx", "sy", "sxx", "sxy")}
    b = drawn.groupBy("k", "rep").agg(((s["m"] * s["sxy"] - s["sx"] * s["sy"]) / F.nullif(s["m"] * s["sxx"] - s["sx"] * s["sx"], F.lit(0.0))).alias("b"))
    return b.groupBy(F.col("k").alias("donors")).agg(F.count("b").alias("reps"), *[rounded(F.percentile("b", q), 5).alias(c) for c, q in (("lo", 0.025), ("mid", 0.5), ("hi", 0.975))])


@query("""WITH s AS (SELECT vec_id AS seed, embedding AS sv FROM embeddings WHERE vec_id % 50 = 0), d AS (SELECT seed, vec_id, sqrt(list_sum([(cast(p[1] AS DOUBLE) - cast(p[2] AS DOUBLE)) * (cast(p[1] AS DOUBLE) - cast(p[2] AS DOUBLE)) for p in list_zip(embedding, sv)])) AS distance FROM embeddings, s WHERE vec_id <> seed)
SELECT seed, vec_id, round(distance, 5) AS distance, cast(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY distance, vec_id) AS rank FROM d) WHERE rank <= 5""")
def knn_topk(spark, sf):
    return _knn(spark, sf).withColumn("distance", rounded("distance", 5))


def _knn(spark, sf):
    e = read(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return N.nearest(e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("seed"), F.col("v").alias("sv")), 5)


@query()
def knn_groups_thinned(spark, sf):
    return N.thinned_groups(_knn(spark, sf), 0.8)


@query(f"""WITH {CELLS}, n AS (SELECT count(DISTINCT user_id) AS n FROM events), d AS (SELECT feature, count(*) AS df FROM ob GROUP BY 1)
SELECT obs, feature, round(ln(1 + 1e4 * value / sum(value) OVER (PARTITION BY obs) * ln(1 + n / df)), 6) AS w FROM ob JOIN d USING (feature), n""")
def tfidf_log(spark, sf):
    n = read(spark, sf, "events").agg(F.countDistinct("user_id")).first()[0]
    return shown(E.tf_idf(cells(spark, sf), n))


@query()
def lsi_components(spark, sf):
    n = read(spark, sf, "events").agg(F.countDistinct("user_id")).first()[0]
    return shown(Z.latent_components(E.tf_idf(cells(spark, sf), n), 5))


@query()
def multinomial_null(spark, sf):
    """Observed over expected floor: both libraries redrawn from the pooled profile, each at its own depth."""
    both = X.side_by_side(K._bulk(spark, sf), ["donor", "celltype"])

    def redraw(key, pdf):
        pdf = pdf.sort_values("feature")
        a, b = pdf["c1"].to_numpy(float), pdf["c2"].to_numpy(float)
        p = (a + b) / (a + b).sum()
        rng = np.random.default_rng([0, int(key[0]), sum(map(ord, key[1]))])
        draws = [rng.multinomial(int(x.sum()), p) for x in (a, b)]
        return pdf[["donor", "celltype", "feature"]].assign(c1=draws[0], c2=draws[1])

    null = both.where("c1 + c2 > 0").groupBy("donor", "celltype").applyInPandas(redraw, "donor int, celltype string, feature long, c1 long, c2 long")
    o = X.floors(both, ["donor", "celltype"], 50).select("donor", "celltype", F.col("floor").alias("observed"))
    e = X.floors(null, ["donor", "celltype"], 50).select("donor", "celltype", F.col("floor").alias("expected"))
    return shown(o.join(e, ["donor", "celltype"]).withColumn("ratio", F.col("observed") / F.col("expected")))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights (intercept first) of the penalised optimum, by Newton's method."""
    z = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(z.shape[1])
    ridge = l2 * np.diag([0.0] + [1.0] * x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge + 1e-9 * np.eye(len(w)), z.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


@query()
def lodo_logreg(spark, sf):
    """Leave one group (language) out: fitted on all labelled rows of the others, standardised on them; every labelled
    row of the group is scored."""
    return _left_out(_labelled(spark, sf))


def _labelled(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "lang", F.ln(F.col("n_chars") + 1.0).alias("x0"), (F.regexp_count("text", F.lit("[*#$%&]")) / (F.col("n_chars") + 1.0)).alias("x1"))
    return read(spark, sf, "labels").join(d, "doc_id").select("doc_id", "lang", "quality", "x0", "x1")


def _left_out(rows):
    """(doc_id, lang, y, p) of each of rows. p is null where the others have one class only or a feature is null."""
    fits = G.fit_logistic(rows, ["x0", "x1"], "quality", "lang", leave_out=True)
    p = G.score_logistic(rows, fits, ["x0", "x1"], "lang")
    return p.select("doc_id", "lang", F.col("quality").cast("int").alias("y"), F.round("p", 6).alias("p"))


@query()
def domain_ratio_fitted(spark, sf):
    """Ratio of densities of one language's rows to all others', by a discriminator that is fitted on all of them."""
    rows = _labelled(spark, sf)
    w = G.domain_ratio(rows.where("lang = 'en'"), rows.where("lang <> 'en'"), ["x0", "x1"])
    return w.select("doc_id", rounded("d").alias("d"), rounded("weight").alias("weight"))


_WEIGHT = "1 + (doc_id % 7) / 4.0"


@query(f"""WITH {SCORES}, a AS (SELECT y, doc_id, CASE WHEN y = 1 THEN 1 - s ELSE s END AS a, {_WEIGHT} AS w FROM sc),
c AS (SELECT y, a, sum(w) OVER (PARTITION BY y ORDER BY a, doc_id ROWS UNBOUNDED PRECEDING) AS cw, sum(w) OVER (PARTITION BY y) + avg(w) OVER (PARTITION BY y) AS total, count(*) OVER (PARTITION BY y) AS n FROM a)
SELECT y, n, round(coalesce(min(a) FILTER (cw >= (1 - 0.1) * total), max(a)), 6) AS threshold FROM c GROUP BY y, n""")
def conformal_weighted(spark, sf):
    """Thresholds by class at weights that each row has."""
    s = scores(spark, sf).select("y", "doc_id", F.when(F.col("y") == 1, 1 - F.col("s")).otherwise(F.col("s")).alias("a"), F.expr(_WEIGHT).cast("double").alias("w"))
    return shown(T.weighted_conformal_thresholds(s, "y", "a", "w", 0.1, "doc_id"))


@query("""WITH c AS (SELECT vec_id, unnest(cast(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM c GROUP BY i),
z AS (SELECT vec_id, list((x - m) / s ORDER BY i) AS v FROM c JOIN m USING (i) GROUP BY vec_id), d AS (SELECT a.vec_id AS seed, b.vec_id, sqrt(list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(a.v, b.v)])) AS distance FROM z a JOIN z b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT seed, vec_id, round(distance, 5) AS distance, cast(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY distance, vec_id) AS rank FROM d) WHERE rank <= 5""")
def knn_zscored(spark, sf):
    """Nearest neighbours of a stated set of seeds, each dimension less its mean over its deviation."""
    e = read(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    z = N.zscored(e, "v", 64)
    near = N.nearest(z, z.where("vec_id % 50 = 0").select(F.col("vec_id").alias("seed"), F.col("v").alias("sv")), 5)
    return near.select("seed", "vec_id", rounded("distance", 5).alias("distance"), "rank")
