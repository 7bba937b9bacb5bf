"""Exact distributions: binomial draws by inversion, rank sums by counting, order statistics of two depths."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from limen.functions.numeric import hash_number, normal_two_sided
from limen.operators.links import haldane
from limen.operators.ranges import dealt, running_total


def log_gamma(c: Column) -> Column:
    return F.reflect(F.lit("org.apache.commons.math3.special.Gamma"), F.lit("logGamma"), c.cast("double")).cast("double")


def binomial_draws(rows: DataFrame, key: str, n: str, p: str, n_draws: int, seed: int = 0, width: float = 10.0) -> DataFrame:
    """(key, rep, k): n_draws binomial numbers for each row (unique key, n, p), by inverting the distribution at hash
    numbers of (seed, key, rep).

    The distribution stands at the values within ``width`` deviations of the mean, beyond which it is smaller than any
    double tells; numbers and distribution are merged in one order, and the points of it that lie below a number are
    counted. A row costs a few square roots of n, and n_draws."""
    size, chance = F.col(n).cast("double"), F.col(p)
    sd = F.sqrt(size * chance * (1 - chance))
    low = F.greatest(F.lit(0), F.floor(size * chance - width * sd - 1)).cast("long")
    high = F.least(F.col(n).cast("long"), F.ceil(size * chance + width * sd + 1).cast("long"))
    t = rows.where(F.col(n).isNotNull() & F.col(p).isNotNull()).select(key, size.alias("_n"), chance.alias("_p"), low.alias("_low"), high.alias("_high"))
    points = t.withColumn("_k", F.explode(F.sequence("_low", "_high")))
    k = F.col("_k")
    inner = log_gamma(F.col("_n") + 1) - log_gamma(k + 1) - log_gamma(F.col("_n") - k + 1) + k * F.ln("_p") + (F.col("_n") - k) * F.ln(1 - F.col("_p"))
    mass = F.when(F.col("_p") <= 0, (k == 0).cast("double")).when(F.col("_p") >= 1, (k == F.col("_n")).cast("double")).otherwise(F.exp(inner))
    below = F.sum("_mass").over(Window.partitionBy(key).orderBy("_k").rowsBetween(Window.unboundedPreceding, 0))
    steps = points.withColumn("_mass", mass).select(key, below.alias("_u"), F.lit(1).alias("_step"), F.lit(None).cast("long").alias("rep"), "_low", "_high")
    drawn = t.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1)))).withColumn("rep", F.col("rep").cast("long"))
    u = (hash_number(F.lit(seed), key, "rep") + 0.5) / float(1 << 32)
    drawn = drawn.select(key, u.alias("_u"), F.lit(0).alias("_step"), "rep", "_low", "_high")
    passed = F.sum("_step").over(Window.partitionBy(key).orderBy("_u", "_step").rowsBetween(Window.unboundedPreceding, 0))
    met = steps.unionByName(drawn).withColumn("_passed", passed).where("_step = 0")
    return met.select(key, "rep", F.least(F.col("_low") + F.col("_passed"), F.col("_high")).alias("k"))


def odds_ratio_intervals(tables: DataFrame, key: str, n_draws: int = 2000, seed: int = 0) -> DataFrame:
    """tables (unique key, a, b, c, d): the odds ratio with half a count added to each cell, and its interval when the
    first cell is drawn anew among a + b; the background (c, d) is taken as fixed. Null intervals where a + b is 0."""
    h = lambda a, b: (a + 0.5) * (F.col("d") + 0.5) / ((b + 0.5) * (F.col("c") + 0.5))
    t = tables.withColumns({"_n": F.col("a") + F.col("b"), "_p": (F.col("a") + 0.5) / (F.col("a") + F.col("b") + 1.0)})
    k = binomial_draws(t.where("_n > 0"), key, "_n", "_p", n_draws, seed)
    drawn = k.join(t.select(key, "_n", "c", "d"), key).withColumn("_or", h(F.col("k"), F.col("_n") - F.col("k")))
    ci = drawn.groupBy(F.col(key).alias("_key")).agg(F.percentile("_or", 0.025).alias("lo"), F.percentile("_or", 0.975).alias("hi"))
    seen = tables.withColumn("odds_ratio", haldane(F.col("a"), F.col("b"), F.col("c"), F.col("d")))
    return seen.join(ci, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")


@lru_cache(maxsize=256)
def rank_sum_counts(n1: int, n0: int) -> list[int]:
    """In how many of the orders of n1 and n0 distinct values U takes each value from 0 to n1 n0: products of
    (1 - x^(n0 + i)) / (1 - x^i), term by term, in whole numbers."""
    counts = [1] + [0] * (n1 * n0)
    for i in range(1, n1 + 1):
        for u in range(n1 * n0, n0 + i - 1, -1):
            counts[u] -= counts[u - n0 - i]
        for u in range(i, n1 * n0 + 1):
            counts[u] += counts[u - i]
    return counts


def rank_sum_exact(n1: int, n0: int, u: float) -> float:
    """Two-sided p of U without ties: twice the smaller tail, 1 at most."""
    counts = rank_sum_counts(n1, n0)
    u = int(round(u))
    tail = sum(counts[: u + 1]) if u <= n1 * n0 / 2 else sum(counts[u:])
    return min(1.0, 2 * (tail / sum(counts)))


def rank_sum_p(stats: DataFrame, ties: Column, most: int = 50) -> DataFrame:
    """stats (n1, n0, u, z) with p_value and exact: by counting where both sides have fewer than ``most`` values and
    none of them tie, else by the normal law with corrections for ties and continuity (z). Null where a side is empty
    or all values tie."""

    @F.pandas_udf("double")
    def counted(n1, n0, u):
        import pandas as pd

        return pd.Series([rank_sum_exact(int(a), int(b), x) for a, b, x in zip(n1, n0, u)])

    small = (F.col("n1") > 0) & (F.col("n0") > 0) & (F.col("n1") < most) & (F.col("n0") < most) & ~ties
    # rows that are not counted go to Python as (1, 1, 0): their value is not taken
    safe = lambda c, other: F.when(small, F.col(c)).otherwise(F.lit(other))
    p = counted(safe("n1", 1), safe("n0", 1), safe("u", 0.0))
    return stats.withColumn("_c", p).withColumn("p_value", F.when(small, F.col("_c")).otherwise(normal_two_sided("z"))).withColumn("exact", small).drop("_c")


def joint_quantile_depths(cells: DataFrame, per_type: int) -> DataFrame:
    """cells (celltype, depth_a, depth_r): per type the strictest pair of thresholds at one common quantile of both
    depths that at least per_type cells clear, and how many do; the least depths where no pair has so many.

    A cell clears a quantile as far up as its rank lets it; on both margins as far as the lesser of its ranks. So the
    quantile is an order statistic of those, and no search is needed: ranks come from counts of distinct values over
    sorted ranges, three orderings in all, whatever the number of types."""
    t = cells.select("celltype", F.col("depth_a").cast("double").alias("a"), F.col("depth_r").cast("double").alias("r")).dropna()

    def ranked(rows: DataFrame, by: str) -> DataFrame:
        """(celltype, by, upto): how many cells of the type have so much or less."""
        counts = rows.groupBy("celltype", by).agg(F.count(F.lit(1)).alias("_n"))
        return running_total(dealt(counts, ["celltype"], [by], "ranks"), ["celltype"], [by], F.col("_n"), "upto").drop("_part")

    ra, rr = ranked(t, "a"), ranked(t, "r")
    size = t.groupBy("celltype").agg(F.count(F.lit(1)).alias("n"))
    both = t.join(ra.select("celltype", "a", F.col("upto").alias("ua")), ["celltype", "a"]).join(rr.select("celltype", "r", F.col("upto").alias("ur")), ["celltype", "r"])
    # places below the top that the threshold must go down for the cell to clear both
    down = both.join(F.broadcast(size), "celltype").select("celltype", "n", (F.col("n") - F.least("ua", "ur")).alias("down"))
    reached = ranked(down.select("celltype", "down"), "down")
    goal = reached.where(F.col("upto") >= per_type).groupBy("celltype").agg(F.min("down").alias("_down"))
    at = size.join(goal, "celltype", "left").withColumn("_place", F.col("n") - F.coalesce(F.col("_down"), F.col("n") - 1))
    pick = lambda table, by, name: table.join(F.broadcast(at.select("celltype", "_place")), "celltype").where(F.col("upto") >= F.col("_place")).groupBy("celltype").agg(F.min(by).alias(name))
    found = at.join(pick(ra, "a", "depth_a"), "celltype").join(pick(rr, "r", "depth_r"), "celltype")
    clear = both.join(F.broadcast(found.select("celltype", "_place")), "celltype").where((F.col("ua") >= F.col("_place")) & (F.col("ur") >= F.col("_place")))
    kept = clear.groupBy("celltype").agg(F.count(F.lit(1)).alias("eligible"))
    return found.join(kept, "celltype", "left").select("celltype", "depth_a", "depth_r", F.coalesce("eligible", F.lit(0)).alias("eligible"))
