"""Column functions: bounds, rounding, logarithms, distribution functions, portable hash numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded(c: str | Column, digits: int = 6) -> Column:
    """Rounded double without negative zero; NaN and infinities as null."""
    x = col(c).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(F.round(x, digits) + F.lit(0.0))


def half_even(c: str | Column) -> Column:
    """Nearest integer, halves to the even one."""
    return F.rint(col(c)).cast("long")


def clip(c: str | Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(c)))


def harmonic_n(n1: str | Column, n2: str | Column) -> Column:
    """Effective number of a pair: 2 / (1/n1 + 1/n2)."""
    return F.try_divide(F.lit(2.0), F.try_divide(F.lit(1.0), col(n1)) + F.try_divide(F.lit(1.0), col(n2)))


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson r as an aggregate, null where a side is constant (the built-in raises an error under ANSI)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def erfc(c: str | Column) -> Column:
    x = col(c).cast("double")
    # the method takes no null
    return F.when(x.isNotNull(), F.reflect(F.lit("org.apache.commons.math3.special.Erf"), F.lit("erfc"), F.coalesce(x, F.lit(0.0))).cast("double"))


def normal_two_sided(z: str | Column) -> Column:
    return erfc(F.abs(col(z)) / F.lit(2.0**0.5))


def chi2_sf(x: str | Column, df: int) -> Column:
    return F.reflect(F.lit("org.apache.commons.math3.special.Gamma"), F.lit("regularizedGammaQ"), F.lit(df / 2.0), (col(x) / 2).cast("double")).cast("double")


def student_two_sided(t: str | Column, df: str | Column) -> Column:
    d = col(df).cast("double")
    x = d / (d + col(t) * col(t))
    return F.reflect(F.lit("org.apache.commons.math3.special.Beta"), F.lit("regularizedBeta"), x, d / 2, F.lit(0.5)).cast("double")


def hash_number(*parts: str | Column) -> Column:
    """A number in 0 .. 2**32 - 1 from md5 of the parts, the same in any engine."""
    key = F.concat_ws("|", *[col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")


def average_rank(value: str, *partition: str) -> Column:
    """Rank from 1 with ties at their mean; within the partition."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*partition).orderBy(value)
    ties = Window.partitionBy(*partition, value)
    return F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2.0
