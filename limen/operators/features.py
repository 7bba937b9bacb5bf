"""Features of each cell type from counts of genes and of peaks: how many independent elements a gene has, how far
they lie, how evenly accessibility is spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limen.functions.numeric import normal_two_sided
from limen.operators.links import band_join, bh_threshold
from limen.operators.sampling import greedy_decorrelated
from limen.sources.scratch import written


def expressed(rna: DataFrame, sizes: DataFrame, share: float = 0.10) -> DataFrame:
    """(celltype, gene) of genes seen in at least a share of the type's cells."""
    seen = rna.where("value > 0").groupBy("celltype", "gene").agg(F.countDistinct("cell").alias("_seen"))
    return seen.join(F.broadcast(sizes), "celltype").where(F.col("_seen") >= share * F.col("n")).select("celltype", "gene")


def correlations(a: DataFrame, b: DataFrame, pairs: DataFrame, sizes: DataFrame, x: str, y: str) -> DataFrame:
    """r of pairs (celltype, x, y) over each type's cells from sparse rows a (celltype, cell, x, v) and b (celltype,
    cell, y, v): absent values are zeros. 0 where a side is constant."""
    side = lambda t, k, s: t.groupBy("celltype", k).agg(F.sum("v").alias(f"s{s}"), F.sum(F.col("v") * F.col("v")).alias(f"q{s}"))
    met = pairs.select("celltype", x, y).join(a.withColumnRenamed("v", "_a"), ["celltype", x]).join(b.withColumnRenamed("v", "_b"), ["celltype", "cell", y])
    cross = met.groupBy("celltype", x, y).agg(F.sum(F.col("_a") * F.col("_b")).alias("_ab"))
    t = pairs.join(cross, ["celltype", x, y], "left").join(side(a, x, "x"), ["celltype", x], "left").join(side(b, y, "y"), ["celltype", y], "left").join(F.broadcast(sizes), "celltype").fillna(0.0, ["_ab", "sx", "qx", "sy", "qy"])
    n = F.col("n").cast("double")
    vx, vy = n * F.col("qx") - F.col("sx") * F.col("sx"), n * F.col("qy") - F.col("sy") * F.col("sy")
    # a constant side: what rounding leaves of the difference of two like numbers
    flat = (vx <= 1e-9 * n * F.col("qx")) | (vy <= 1e-9 * n * F.col("qy"))
    r = F.when(flat, 0.0).otherwise(F.try_divide(n * F.col("_ab") - F.col("sx") * F.col("sy"), F.sqrt(vx) * F.sqrt(vy)))
    return t.select(*pairs.columns, "n", F.coalesce(r, F.lit(0.0)).alias("r"))


def correlation_p(r: str, n: str) -> Column:
    """Two-sided p of a correlation by the normal law."""
    c = F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), F.col(r)))
    return normal_two_sided(c * F.sqrt((F.col(n) - 2) / (1 - c * c)))


def features_by_type(rna: DataFrame, atac: DataFrame, genes: DataFrame, peaks: DataFrame, sizes: DataFrame, window: int, near: int, fdr: float = 0.05, collinear: float = 0.7, share: float = 0.10, subset: Column | None = None) -> DataFrame:
    """One row a type. rna (celltype, cell, gene, value), atac (celltype, cell, peak, value): depth-equalised counts;
    genes (gene, chrom, tss), peaks (peak, chrom, mid), sizes (celltype, n cells); subset: a condition on genes.

    Genes with two peaks or more in their window are tested, each with all of them, on ln(1 + count); one false
    discovery correction holds for all pairs of a type. A gene's redundancy is how many of its linked peaks are left
    when, by strength, those that correlate with one before are dropped; 0 without links. distal_frac: links farther
    than near from the gene's start; entropy: of accessibility over peaks."""
    log = lambda t, k: t.where("value <> 0").select("celltype", "cell", k, F.log1p("value").alias("v"))
    a, p = log(rna, "gene"), log(atac, "peak")
    near_by = band_join(genes, peaks, window).select("gene", "peak", F.abs(F.col("mid") - F.col("tss")).alias("distance"))
    many = near_by.groupBy("gene").agg(F.count(F.lit(1)).alias("_hits")).where("_hits >= 2").select("gene")
    seen = expressed(rna, sizes, share)
    tests = correlations(a, p, seen.join(many, "gene").join(near_by, "gene").select("celltype", "gene", "peak", "distance"), sizes, "gene", "peak")
    tests = written(tests.withColumn("p", correlation_p("r", "n")), "tests")
    cut = bh_threshold(tests, fdr, "celltype").select("celltype", "threshold")
    links = written(tests.join(F.broadcast(cut), "celltype").where("p <= threshold"), "links")
    # peaks of one gene against each other, linked ones only
    ours = links.select("celltype", "gene", F.col("peak").alias("u"))
    both = ours.join(links.select("celltype", "gene", F.col("peak").alias("w")), ["celltype", "gene"]).where("u < w")
    as_peak = lambda k: p.withColumnRenamed("peak", k)
    r = correlations(as_peak("u"), as_peak("w"), both.select("celltype", "u", "w").distinct(), sizes, "u", "w")
    key = F.to_json(F.struct("celltype", "gene"))
    against = both.join(r.select("celltype", "u", "w", "r"), ["celltype", "u", "w"]).select(key.alias("gene"), F.col("u").alias("p"), F.col("w").alias("q"), "r")
    left = greedy_decorrelated(links.select(key.alias("gene"), "peak", F.abs("r").alias("strength")), against, collinear)
    tested = tests.select("celltype", "gene").distinct().withColumn("_key", key)
    red = tested.join(left.select(F.col("gene").alias("_key"), "admitted"), "_key", "left").withColumn("red", F.coalesce("admitted", F.lit(0)))
    chosen = subset if subset is not None else F.lit(False)
    per = red.groupBy("celltype").agg(
        F.percentile("red", 0.5).alias("redundancy"), F.avg("red").alias("redundancy_mean"), F.count(F.lit(1)).alias("n_genes_tested"),
        F.percentile(F.when(chosen, F.col("red")), 0.5).alias("redundancy_subset"), F.count_if(chosen).alias("n_subset_genes"),
    )
    far = links.groupBy("celltype").agg(F.count(F.lit(1)).alias("n_links"), F.avg((F.col("distance") > near).cast("double")).alias("distal_frac"))
    open_ = atac.where("value > 0").groupBy("celltype", "peak").agg(F.sum("value").alias("s"))
    total = open_.groupBy("celltype").agg(F.sum("s").alias("t"))
    f = F.col("s") / F.col("t")
    ent = open_.join(F.broadcast(total), "celltype").groupBy("celltype").agg((-F.sum(f * F.ln(f))).alias("entropy"))
    n_exp = seen.groupBy("celltype").agg(F.count(F.lit(1)).alias("n_expressed"))
    return per.join(far, "celltype", "left").join(ent, "celltype", "left").join(n_exp, "celltype", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))
