"""Expression layer: pseudobulks, floors of replicate pairs, power laws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from limen.functions.numeric import correlation, harmonic_n
from limen.operators.composition import resampled_sums


def pseudobulk(rows: DataFrame, groups: list[str], feature: str = "feature", value: str = "value") -> DataFrame:
    """Sums by group and feature; explicit zeros are dropped (and counted by ``zero_count``)."""
    return rows.where(F.col(value) != 0).groupBy(*groups, feature).agg(F.sum(value).alias("count"))


def zero_count(rows: DataFrame, value: str = "value") -> DataFrame:
    return rows.agg(F.count_if(F.col(value) == 0).alias("zeros"), F.count(F.lit(1)).alias("entries"))


def group_info(cells: DataFrame, groups: list[str], cell: str = "cell") -> DataFrame:
    return cells.groupBy(*groups).agg(F.countDistinct(cell).alias("n_cells"))


def cpm(bulk: DataFrame, groups: list[str], count: str = "count") -> DataFrame:
    """Adds cpm, null for a group without counts."""
    total = F.sum(count).over(Window.partitionBy(*groups))
    return bulk.withColumn("cpm", F.when(total > 0, F.col(count) * 1e6 / total))


def side_by_side(bulk: DataFrame, keys: list[str], library: str = "lib", feature: str = "feature", count: str = "count") -> DataFrame:
    """(keys, feature, c1, c2) of libraries 0 and 1: one aggregate instead of a full outer join."""
    side = lambda k: F.coalesce(F.sum(F.when(F.col(library) == k, F.col(count))), F.lit(0))
    return bulk.groupBy(*keys, feature).agg(side(0).alias("c1"), side(1).alias("c2"))


def floors(both: DataFrame, keys: list[str], min_genes: int = 200) -> DataFrame:
    """Median |difference of log2(CPM + 1)| over features seen in either library, Pearson r of ln(CPM + 1), and
    how many; pairs with fewer than min_genes features or an empty library have none."""
    w = Window.partitionBy(*keys)
    x = both.withColumns({"t1": F.sum("c1").over(w), "t2": F.sum("c2").over(w)}).where("t1 > 0 AND t2 > 0 AND (c1 > 0 OR c2 > 0)")
    x = x.withColumns({f"m{i}": F.try_divide(F.col(f"c{i}") * 1e6, F.col(f"t{i}")) for i in (1, 2)})
    return (
        x.groupBy(*keys)
        .agg(
            F.percentile(F.abs(F.log2(F.col("m1") + 1) - F.log2(F.col("m2") + 1)), 0.5).alias("floor"),
            correlation(F.log1p("m1"), F.log1p("m2")).alias("r"),
            F.count(F.lit(1)).alias("n_genes"),
            harmonic_n(F.first("t1"), F.first("t2")).alias("n_eff"),
        )
        .where(F.col("n_genes") >= min_genes)
    )


LAW = {
    "n_obs": lambda x, y: F.count(F.lit(1)),
    "b": lambda x, y: F.regr_slope(F.ln(y), F.ln(x)),
    "a": lambda x, y: F.exp(F.regr_intercept(F.ln(y), F.ln(x))),
}


def power_law(df: DataFrame, x: str, y: str, *by: str, least: int = 1) -> DataFrame:
    """y = a * x**b by least squares on logarithms, rows with x, y > 0."""
    cx, cy = F.col(x), F.col(y)
    fine = df.where((cx > 0) & (cy > 0))
    aggs = [f(cx, cy).alias(k) for k, f in LAW.items()] + [F.median(x).alias("median_x")]
    return (fine.groupBy(*by).agg(*aggs) if by else fine.agg(*aggs)).where(F.col("n_obs") >= least)


def support_sensitivity(df: DataFrame, thresholds: list[float], x: str = "n_eff", y: str = "floor") -> DataFrame:
    """The law at each least x: one pass, rows repeated once for each threshold that they meet."""
    each = df.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))).where(F.col(x) >= F.col("threshold"))
    return power_law(each, x, y, "threshold", least=5)


def inverse_prediction(law: DataFrame, target: float) -> DataFrame:
    """x at which the law reaches the target."""
    return law.withColumn("needed", F.exp((F.ln(F.lit(float(target))) - F.ln("a")) / F.col("b")))


def median_intercept(df: DataFrame, slope: float, x: str = "n_eff", y: str = "floor") -> DataFrame:
    return df.agg(F.exp(F.median(F.ln(y) - slope * F.ln(x))).alias("a_fixed"))


def stratified_slopes(df: DataFrame, by: str, x: str = "n_eff", y: str = "floor", least: int = 8, span: float = 3.0) -> DataFrame:
    fit = df.groupBy(by).agg(F.count(F.lit(1)).alias("n_obs"), (F.max(x) / F.min(x)).alias("span"), F.regr_slope(F.ln(y), F.ln(x)).alias("b"))
    return fit.where((F.col("n_obs") >= least) & (F.col("span") >= span))


def slope_sums(df: DataFrame, x: str = "n_eff", y: str = "floor") -> DataFrame:
    """Sufficient statistics of the law for each donor."""
    lx, ly = F.ln(x), F.ln(y)
    return df.groupBy("donor").agg(F.count(F.lit(1)).alias("m"), F.sum(lx).alias("sx"), F.sum(ly).alias("sy"), F.sum(lx * lx).alias("sxx"), F.sum(lx * ly).alias("sxy"))


def slope_bootstrap(df: DataFrame, n_boot: int, seed: int = 0, x: str = "n_eff", y: str = "floor") -> DataFrame:
    """(rep, b) of donor-clustered resamples."""
    per = slope_sums(df, x, y)
    below = F.nullif(F.col("m") * F.col("sxx") - F.col("sx") * F.col("sx"), F.lit(0.0))
    return resampled_sums(per, n_boot, seed).select("rep", ((F.col("m") * F.col("sxy") - F.col("sx") * F.col("sy")) / below).alias("b"))


def partial_correlation(df: DataFrame, x: Column, y: Column, z: Column) -> DataFrame:
    """Correlation of x and y with z held fixed, from the three plain ones."""
    r = df.agg(correlation(x, y).alias("xy"), correlation(x, z).alias("xz"), correlation(y, z).alias("yz"))
    return r.select(((F.col("xy") - F.col("xz") * F.col("yz")) / F.sqrt((1 - F.col("xz") ** 2) * (1 - F.col("yz") ** 2))).alias("partial_r"))


def aggregate_counts(counts: DataFrame, members: DataFrame) -> DataFrame:
    """Sums of counts (cell, feature, value) over aggregates: members (aggregate, cell), a cell in any number of them."""
    return members.join(counts, "cell").groupBy("aggregate", "feature").agg(F.sum("value").alias("count"))
