"""Regulation layer: positional windows, correlation from moments, false discovery, odds ratios, pooling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from limen.functions.numeric import average_rank, hash_number
from limen.operators.pairs import near_counts


def band_join(genes: DataFrame, peaks: DataFrame, window: int, closed: bool = False) -> DataFrame:
    """Pairs of a gene (chrom, tss) and a peak (chrom, mid) with mid in [tss - window, tss + window), or closed.

    Genes are repeated for the bins of one window's width that their window meets (three at most), the join is an
    equi-join on chromosome and bin, and the band is checked exactly: no nested loops, and a peak meets a gene once.
    """
    reach = F.col("tss") + window
    spread = genes.withColumn("bin", F.explode(F.sequence(F.floor((F.col("tss") - window) / window), F.floor(reach / window))))
    hit = (F.col("mid") >= F.col("tss") - window) & ((F.col("mid") <= reach) if closed else (F.col("mid") < reach))
    return spread.join(peaks.withColumn("bin", F.floor(F.col("mid") / window)), ["chrom", "bin"]).where(hit).drop("bin")


def band_counts(genes: DataFrame, peaks: DataFrame, window: int, near: int, closed: bool = False, keep_zero: bool = True) -> DataFrame:
    """Per gene the peaks in its window and within near; genes without peaks stay with zeros if keep_zero."""
    n = near_counts(genes, peaks, window, [(-window, True, window, closed), (-near, True, near, closed)], "gene")
    n = n.groupBy("gene").agg(F.sum(F.col("near")[0]).alias("n_tot"), F.sum(F.col("near")[1]).alias("n_prox")).where("n_tot > 0")
    out = genes.join(n, "gene", "left" if keep_zero else "inner")
    return out.select("gene", "chrom", F.coalesce("n_tot", F.lit(0)).alias("n_tot"), F.coalesce("n_prox", F.lit(0)).alias("n_prox"))


def repaired_elsewhere(genes: DataFrame, seed: int = 0) -> DataFrame:
    """The null pairing: each gene takes the window of a gene of another chromosome, chosen by hash numbers.

    Genes of a chromosome are ranked by hash; a gene's partner is at the hashed position among the genes of a hashed
    other chromosome. Only per-chromosome counts (a handful of rows) meet every gene."""
    ranked = genes.withColumn("pos", F.row_number().over(Window.partitionBy("chrom").orderBy(hash_number(F.lit(seed), "gene"), "gene")) - 1)
    sizes = genes.groupBy("chrom").agg(F.count(F.lit(1)).alias("size"))
    order = sizes.agg(F.sort_array(F.collect_list(F.struct("chrom", "size"))).alias("all"))  # chromosomes: a fixed few
    own = ranked.crossJoin(F.broadcast(order)).withColumn("others", F.filter("all", lambda c: c["chrom"] != F.col("chrom"))).where(F.size("others") > 0)
    pick = F.element_at("others", ((hash_number(F.lit(seed), F.lit("c"), "gene") % F.size("others")) + 1).cast("int"))
    own = own.withColumn("pick", pick).select("gene", "chrom", F.col("pick.chrom").alias("to_chrom"), (hash_number(F.lit(seed), F.lit("p"), "gene") % F.col("pick.size")).alias("to_pos"))
    to = ranked.select(F.col("chrom").alias("to_chrom"), F.col("pos").cast("long").alias("to_pos"), F.col("gene").alias("partner"), F.col("tss").alias("partner_tss"))
    return own.join(to, ["to_chrom", "to_pos"]).select("gene", "chrom", "partner", "to_chrom", "partner_tss")


def pair_correlation(cells: DataFrame, pairs: DataFrame, n_obs: int, inflate: bool = True) -> DataFrame:
    """r of feature pairs (x, y) over sparse cells (obs, feature, value): moments, population deviations, and the
    factor n / (n - 1) unless inflate is off; pairs with a constant feature get 0."""
    m = cells.groupBy("feature").agg((F.sum("value") / n_obs).alias("mean"), (F.sum(F.col("value") * F.col("value")) / n_obs).alias("sq"))
    m = m.withColumn("sd", F.sqrt(F.greatest(F.col("sq") - F.col("mean") * F.col("mean"), F.lit(0.0))))
    cx = cells.select(F.col("feature").alias("x"), "obs", F.col("value").alias("vx"))
    cy = cells.select(F.col("feature").alias("y"), "obs", F.col("value").alias("vy"))
    both = pairs.join(cx, "x").join(cy, ["y", "obs"]).groupBy("x", "y").agg((F.sum(F.col("vx") * F.col("vy")) / n_obs).alias("xy"))
    side = lambda c: m.select(F.col("feature").alias(c), F.col("mean").alias(f"m{c}"), F.col("sd").alias(f"s{c}"))
    j = pairs.join(both, ["x", "y"], "left").join(side("x"), "x").join(side("y"), "y")
    r = (F.coalesce("xy", F.lit(0.0)) - F.col("mx") * F.col("my")) / (F.col("sx") * F.col("sy")) * (n_obs / (n_obs - 1.0) if inflate else 1.0)
    return j.select("x", "y", F.when((F.col("sx") > 0) & (F.col("sy") > 0), r).otherwise(0.0).alias("r"))


def bh_threshold(tests: DataFrame, alpha: float, *family: str, p: str = "p", m_extra: int = 0) -> DataFrame:
    """Per family the largest p with p <= alpha * rank / (m + m_extra), -1 if none."""
    w = Window.partitionBy(*family)
    k = F.row_number().over(w.orderBy(p))
    m = F.count(F.lit(1)).over(w) + m_extra
    ok = tests.withColumn("_ok", F.col(p) <= alpha * k / m)
    return ok.groupBy(*family).agg(F.coalesce(F.max(F.when(F.col("_ok"), F.col(p))), F.lit(-1.0)).alias("threshold"), F.count(F.lit(1)).alias("m"))


def bh_q(tests: DataFrame, *family: str, p: str = "p", tie: str = "test") -> DataFrame:
    """Adds q: the least of p * m / rank over this and larger p, 1 at most."""
    w = Window.partitionBy(*family)
    raw = tests.withColumn("_raw", F.col(p) * F.count(F.lit(1)).over(w) / F.row_number().over(w.orderBy(p, tie)))
    down = w.orderBy(F.col(p).desc(), F.col(tie).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return raw.withColumn("q", F.least(F.min("_raw").over(down), F.lit(1.0))).drop("_raw")


def quantile_rank(value: str, *partition: str) -> Column:
    return average_rank(value, *partition) / F.count(F.lit(1)).over(Window.partitionBy(*partition))


def strict_links(tests: DataFrame, variances: DataFrame, least_r: float = 0.45, most_q: float = 1e-4, least_quantile: float = 0.25) -> DataFrame:
    """Tests (x, y, r, q) that are strong, pass false discovery, and whose features both vary more than a quantile.
    variances: (feature, quantile)."""
    fine = variances.where(F.col("quantile") > least_quantile).select("feature")
    kept = tests.where((F.col("r") >= least_r) & (F.col("q") <= most_q))
    return kept.join(fine, kept["x"] == fine["feature"], "left_semi").join(fine.withColumnRenamed("feature", "other"), F.col("y") == F.col("other"), "left_semi")


def haldane(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Odds ratio of a 2 x 2 table with a half in each cell."""
    return ((a + 0.5) * (d + 0.5)) / ((b + 0.5) * (c + 0.5))


def mantel_haenszel(tables: DataFrame, *by: str, correct: bool = False) -> DataFrame:
    """Pooled odds ratio of strata (a, b, c, d), with the Robins-Breslow-Greenland interval. correct: a half in each
    cell of every stratum of a key if any of its cells is empty."""
    t = tables
    if correct:
        empty = F.bool_or(F.least("a", "b", "c", "d") == 0).over(Window.partitionBy(*by))
        t = t.withColumn("_h", F.when(empty, 0.5).otherwise(0.0)).withColumns({x: F.col(x) + F.col("_h") for x in "abcd"})
    n = F.col("a") + F.col("b") + F.col("c") + F.col("d")
    ad, bc = F.col("a") * F.col("d") / n, F.col("b") * F.col("c") / n
    p, q = (F.col("a") + F.col("d")) / n, (F.col("b") + F.col("c")) / n
    s = t.where(n > 0).groupBy(*by).agg(F.sum(ad).alias("R"), F.sum(bc).alias("S"), F.sum(p * ad).alias("PR"), F.sum(p * bc + q * ad).alias("M"), F.sum(q * bc).alias("QS"), F.count(F.lit(1)).alias("strata"))
    s = s.where("R > 0 AND S > 0")
    var = F.col("PR") / (2 * F.col("R") ** 2) + F.col("M") / (2 * F.col("R") * F.col("S")) + F.col("QS") / (2 * F.col("S") ** 2)
    s = s.withColumns({"log_or": F.ln(F.col("R") / F.col("S")), "se": F.sqrt(var)})
    return s.select(*by, "strata", F.exp("log_or").alias("odds_ratio"), F.exp(F.col("log_or") - 1.96 * F.col("se")).alias("lo"), F.exp(F.col("log_or") + 1.96 * F.col("se")).alias("hi"), "log_or", "se")


def over_repeats(pooled: DataFrame, *by: str) -> DataFrame:
    """Pooled estimates of repeats in one: variance within plus variance between."""
    s = pooled.groupBy(*by).agg(F.avg("log_or").alias("log_or"), (F.avg(F.col("se") ** 2) + F.coalesce(F.var_samp("log_or"), F.lit(0.0))).alias("v"), F.count(F.lit(1)).alias("repeats"))
    return s.select(*by, "repeats", F.exp("log_or").alias("odds_ratio"), F.exp(F.col("log_or") - 1.96 * F.sqrt("v")).alias("lo"), F.exp(F.col("log_or") + 1.96 * F.sqrt("v")).alias("hi"))


def leave_one_out(tables: DataFrame, key: str) -> DataFrame:
    """Log odds ratio of the totals without each key's table: totals minus the part, by one window over few rows."""
    t = tables.groupBy(key).agg(*[F.sum(x).alias(x) for x in "abcd"])
    rest = {x: F.sum(x).over(Window.partitionBy()) - F.col(x) for x in "abcd"}
    return t.select(key, F.ln(haldane(*[rest[x] for x in "abcd"])).alias("log_or_without"))


def leave_one_out_summary(tables: DataFrame, key: str, worst: int = 3) -> DataFrame:
    """One row: the log odds ratio of all tables, its range when one key is left out, and the keys that move it most."""
    left = leave_one_out(tables, key)
    whole = tables.agg(*[F.sum(x).alias(x) for x in "abcd"]).select(F.ln(haldane(*[F.col(x) for x in "abcd"])).alias("log_or"))
    moved = left.crossJoin(F.broadcast(whole)).withColumn("_by", F.abs(F.col("log_or_without") - F.col("log_or")))  # one row
    top = F.slice(F.sort_array(F.collect_list(F.struct((-F.round("_by", 9)).alias("o"), F.col(key).alias("k")))), 1, worst)  # a row a key
    return moved.agg(F.first("log_or").alias("log_or"), F.min("log_or_without").alias("low"), F.max("log_or_without").alias("high"), F.array_join(F.transform(top, lambda x: x["k"].cast("string")), ",").alias("worst"))


def band_of(distance: Column, edges: list[int]) -> Column:
    """Index of the band that holds |distance|: left-closed, the last closed on both sides; null outside."""
    d = F.abs(distance)
    out = F.when(d == edges[-1], len(edges) - 2)
    for i in range(len(edges) - 1):
        out = out.when((d >= edges[i]) & (d < edges[i + 1]), i)
    return out


def g_statistic(bands: DataFrame, observed: str = "observed", reference: str = "reference") -> DataFrame:
    """2 * sum(o * ln(o / e)), e from the reference's shares."""
    w = Window.partitionBy()
    e = F.col(reference) * F.sum(observed).over(w) / F.sum(reference).over(w)
    t = bands.withColumn("_e", e).where(F.col("_e") > 0)
    return t.agg((2 * F.sum(F.when(F.col(observed) > 0, F.col(observed) * F.ln(F.col(observed) / F.col("_e"))).otherwise(0.0))).alias("g"), (F.count(F.lit(1)) - 1).alias("df"))


def band_median(bands: DataFrame, edges: list[int]) -> DataFrame:
    """Median distance by interpolation within the band that holds half the mass."""
    cum = F.sum("n").over(Window.orderBy("band").rowsBetween(Window.unboundedPreceding, 0))  # a row for each band
    t = bands.withColumns({"cum": cum, "half": F.sum("n").over(Window.partitionBy()) / 2.0})
    lo, hi = (F.element_at(F.array(*[F.lit(float(x)) for x in edges]), (F.col("band") + k).cast("int")) for k in (1, 2))
    at = lo + (hi - lo) * (F.col("half") - (F.col("cum") - F.col("n"))) / F.col("n")
    return t.where("cum >= half AND n > 0").agg(F.min_by(at, F.col("band")).alias("median_distance"))
