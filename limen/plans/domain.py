"""How the analysis's roles map onto the driver's tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limen.operators.composition import replicate_counts


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    return replicate_counts(li, F.col("l_suppkey"), F.concat("l_returnflag", "l_linestatus"), F.col("l_orderkey") % 2)


PAIRS = """pairs AS (SELECT l_suppkey AS donor, concat(l_returnflag, l_linestatus) AS celltype,
 count(*) FILTER (l_orderkey % 2 = 0) AS n1, count(*) FILTER (l_orderkey % 2 = 1) AS n2 FROM lineitem GROUP BY 1, 2),
tot AS (SELECT *, sum(n1) OVER (PARTITION BY donor) AS t1, sum(n2) OVER (PARTITION BY donor) AS t2 FROM pairs),
shr AS (SELECT *, n1 / t1 AS f1, n2 / t2 AS f2 FROM tot WHERE t1 > 0 AND t2 > 0),
pz AS (SELECT donor, celltype, p, 2.0 / (1.0 / greatest(n1, 1) + 1.0 / greatest(n2, 1)) AS n_eff, abs(f1 - f2) / sqrt(p * (1 - p)) AS z
 FROM (SELECT *, (f1 + f2) / 2 AS p FROM shr) WHERE p > 0 AND p < 1),
wz AS (SELECT donor, celltype, p, 2.0 / (1.0 / t1 + 1.0 / t2) AS n_eff, abs(f1 - f2) / sqrt(p * (1 - p)) AS z
 FROM (SELECT *, (n1 + n2) / (t1 + t2) AS p FROM shr WHERE t1 >= 50 AND t2 >= 50) WHERE p > 0 AND p < 1 AND f1 <> f2),
kt AS (SELECT celltype, sqrt(avg(power(z / sqrt(2 / n_eff), 2))) AS kappa, avg(p) AS mean_fraction, count(*) AS n_pairs FROM pz GROUP BY 1),
kp AS (SELECT sqrt(avg(power(z / sqrt(2 / n_eff), 2))) AS kappa, count(*) AS n_pairs, count(DISTINCT donor) AS n_donors FROM pz)"""


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(donor, celltype, lib, feature, value): quantities as counts of features."""
    li, s = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "supplier")
    rows = li.join(s, li["l_suppkey"] == s["s_suppkey"])
    return rows.select(F.col("s_nationkey").alias("donor"), F.col("l_returnflag").alias("celltype"), (F.col("l_orderkey") % 2).cast("int").alias("lib"), (F.col("l_partkey") % 300).alias("feature"), F.col("l_quantity").cast("long").alias("value"))


COUNTS = """cnt AS (SELECT s_nationkey AS donor, l_returnflag AS celltype, cast(l_orderkey % 2 AS INTEGER) AS lib, l_partkey % 300 AS feature, cast(l_quantity AS BIGINT) AS value
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
bulk AS (SELECT donor, celltype, lib, feature, cast(sum(value) AS BIGINT) AS "count" FROM cnt WHERE value <> 0 GROUP BY 1, 2, 3, 4),
sbs AS (SELECT donor, celltype, feature, coalesce(sum("count") FILTER (lib = 0), 0) AS c1, coalesce(sum("count") FILTER (lib = 1), 0) AS c2 FROM bulk GROUP BY 1, 2, 3),
sbt AS (SELECT *, sum(c1) OVER (PARTITION BY donor, celltype) AS t1, sum(c2) OVER (PARTITION BY donor, celltype) AS t2 FROM sbs),
sbm AS (SELECT *, c1 * 1e6 / t1 AS m1, c2 * 1e6 / t2 AS m2 FROM sbt WHERE t1 > 0 AND t2 > 0 AND (c1 > 0 OR c2 > 0)),
fl AS (SELECT donor, celltype, quantile_cont(abs(log2(m1 + 1) - log2(m2 + 1)), 0.5) AS floor, corr(ln(1 + m1), ln(1 + m2)) AS r, count(*) AS n_genes,
 2.0 / (1.0 / max(t1) + 1.0 / max(t2)) AS n_eff FROM sbm GROUP BY 1, 2 HAVING count(*) >= 50)"""


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = peaks(spark, sf_dir)
    first = e.groupBy("chrom", "user_id").agg(F.min("mid").alias("tss"))
    return first.select(F.concat_ws("-", "chrom", "user_id").alias("gene"), "chrom", "tss", "user_id")


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000)
    return e.select(F.col("event_id").alias("peak"), F.col("event_type").alias("chrom"), at.alias("mid"), "user_id")


WINDOW, NEAR = 6 * 3600, 600
GENES = f"""pk AS (SELECT event_id AS peak, event_type AS chrom, cast(floor(epoch_us(ts) / 1000000) AS BIGINT) AS mid, user_id FROM events),
gn AS (SELECT concat(chrom, '-', user_id) AS gene, chrom, min(mid) AS tss, user_id FROM pk GROUP BY chrom, user_id),
bd AS (SELECT gene, gn.chrom, tss, peak, mid, gn.user_id FROM gn JOIN pk ON gn.chrom = pk.chrom AND mid >= tss - {WINDOW} AND mid < tss + {WINDOW})"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(obs, feature, value): how often a user had an event type on a day."""
    e = read(spark, sf_dir, "events")
    f = F.concat_ws("-", "event_type", F.date_format("ts", "yyyyMMdd"))
    return e.groupBy(F.col("user_id").alias("obs"), f.alias("feature")).agg(F.count(F.lit(1)).cast("double").alias("value"))


CELLS = """ob AS (SELECT user_id AS obs, concat(event_type, '-', strftime(ts, '%Y%m%d')) AS feature, cast(count(*) AS DOUBLE) AS value FROM events GROUP BY 1, 2)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, y, s): quality labels with a score from the text's length."""
    d, lab = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return lab.join(d, "doc_id").select("doc_id", F.col("quality").alias("y"), (F.col("n_chars") / (F.col("n_chars") + 2000.0)).alias("s"))


SCORES = "sc AS (SELECT doc_id, quality AS y, n_chars / (n_chars + 2000.0) AS s FROM labels JOIN documents USING (doc_id))"
