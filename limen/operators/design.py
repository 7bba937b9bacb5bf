"""Study design: what a plan resolves, and what a target needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limen.config import Settings
from limen.functions.numeric import half_even

# Default plans (donors, nuclei) and the ladder of nuclei of the expression table.
DESIGNS = [(10, 2000), (20, 5000), (50, 10000), (200, 20000)]
LADDER = [25, 50, 100, 200, 500, 1000]


def resolvable_difference(kappa: Column, donors: Column, nuclei: Column, s: Settings) -> Column:
    """Percentage points that a plan resolves."""
    return 100 * s.z * kappa * (s.abundance * (1 - s.abundance)) ** 0.5 * F.sqrt(2 / (donors * nuclei))


def nuclei_required(kappa: Column, s: Settings, target_pp: float | None = None) -> Column:
    per = s.z * (s.abundance * (1 - s.abundance)) ** 0.5 * 100 / (target_pp or s.target_pp)
    return half_even(2 * F.pow(kappa * per, F.lit(2)))


def named_kappas(pooled: DataFrame, by_type: DataFrame) -> DataFrame:
    """(source, kappa): multinomial, pooled, median category, worst category."""
    types = by_type.agg(F.median("kappa").alias("m"), F.max("kappa").alias("w"))
    one = pooled.select("kappa").crossJoin(types)
    return one.select(F.expr("stack(4, 'multinomial', double(1), 'pooled', kappa, 'median', m, 'worst', w) AS (source, kappa)"))


def composition_design(kappas: DataFrame, s: Settings, designs: list[tuple[int, int]] = DESIGNS) -> DataFrame:
    """(donors, nuclei) with a column for each named kappa."""
    if any(d <= 0 or n <= 0 for d, n in designs):
        raise ValueError("donors and nuclei must be positive")
    plans = kappas.sparkSession.createDataFrame(designs, "donors long, nuclei long")
    grid = plans.crossJoin(kappas).withColumn("pp", F.bround(resolvable_difference(F.col("kappa"), F.col("donors"), F.col("nuclei"), s), 3))
    return grid.groupBy("donors", "nuclei").pivot("source", ["multinomial", "pooled", "median", "worst"]).agg(F.first("pp"))


def composition_requirement(kappas: DataFrame, s: Settings) -> DataFrame:
    return kappas.select("source", nuclei_required(F.col("kappa"), s).alias("nuclei"))


def expression_design(law: DataFrame, ladder: list[int] = LADDER) -> DataFrame:
    """law (a, b, median_x): the floor at each n, marked where it lies far outside of the support."""
    steps = law.withColumn("nuclei", F.explode(F.array(*[F.lit(n).cast("long") for n in ladder])))
    return steps.select("nuclei", (F.col("a") * F.pow("nuclei", F.col("b"))).alias("threshold"), (F.col("nuclei") > 10 * F.col("median_x")).alias("extrapolated"))
