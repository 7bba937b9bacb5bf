"""Alignment, lookup and recoding of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def keep_first(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key in order, by partial aggregation; order should tell rows of a key apart."""
    rest = [c for c in df.columns if c != key]
    picked = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(key, *[F.col("_r")[c].alias(c) for c in rest])


def lookup(rows: DataFrame, names: DataFrame, key: str, window: int) -> DataFrame:
    """rows (key, chrom, mid) with the place (tchrom, tss) of their name, where chromosomes agree within the window."""
    found = rows.join(names, key).where("chrom = tchrom")
    return found.withColumn("distance", F.col("mid") - F.col("tss")).where(F.abs("distance") <= window)


def dense_ids(names: DataFrame, key: str) -> DataFrame:
    """(key, new_id): gapless numbers of a dictionary's keys. A dictionary, not a table of rows: one window orders it."""
    return names.select(key).distinct().withColumn("new_id", F.row_number().over(Window.orderBy(key)) - 1)


def remapped(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """rows with new_id, -1 where the dictionary lacks the key."""
    return rows.join(ids, key, "left").withColumn("new_id", F.coalesce("new_id", F.lit(-1)))


def barcode(c: str | Column) -> Column:
    """A barcode without the number of its library."""
    return F.regexp_replace(c, "-[0-9]+$", "")


def unmatched(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Keys that only one of two tables has: one row; both counts are 0 where keys agree."""
    left, right = (d.select(*keys).distinct().withColumn(n, F.lit(1)) for d, n in ((a, "_a"), (b, "_b")))
    both = left.join(right, list(keys), "full")
    return both.agg(F.count_if(F.col("_b").isNull()).alias("only_first"), F.count_if(F.col("_a").isNull()).alias("only_second"))


def order_mismatches(a: DataFrame, b: DataFrame, pos: str, value: str) -> DataFrame:
    """Places at which two sequences (pos, value) differ, or that only one has."""
    j = a.select(pos, F.col(value).alias("_x")).join(b.select(pos, F.col(value).alias("_y")), pos, "full")
    return j.agg(F.count(F.lit(1)).alias("places"), F.count_if(~F.col("_x").eqNullSafe(F.col("_y"))).alias("mismatches"))


def one_hot(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """An indicator for each value but the first in order."""
    return df.withColumns({f"is_{v}": (F.col(column) == v).cast("int") for v in sorted(values)[1:]})


def stacked(df: DataFrame, values: str) -> DataFrame:
    """(bin, total): sum of arrays of counts, place by place."""
    return df.select(F.posexplode(values).alias("bin", "v")).groupBy("bin").agg(F.sum("v").alias("total"))


def by_median(value: str, *partition: str) -> Column:
    return F.try_divide(F.col(value), F.median(value).over(Window.partitionBy(*partition)))


def scaled_log2(value: str, obs: str, to: float = 1e4) -> Column:
    """log2 of values scaled to a common total of each observation."""
    return F.log2(F.col(value) * to / F.sum(value).over(Window.partitionBy(obs)) + 1)


def detected(cells: DataFrame, share: float = 0.1) -> DataFrame:
    """(feature, n): features that at least this share of the observations have."""
    n = cells.agg(F.countDistinct("obs").alias("_n"))
    held = cells.where("value > 0").groupBy("feature").agg(F.countDistinct("obs").alias("n"))
    return held.crossJoin(F.broadcast(n)).where(F.col("n") >= share * F.col("_n")).drop("_n")  # one row


def single_group(rows: DataFrame, key: str, group: str, least: int) -> DataFrame:
    """(key, group, n) of the keys of one group only and enough rows."""
    g = rows.groupBy(key).agg(F.min(group).alias(group), F.max(group).alias("_hi"), F.count(F.lit(1)).alias("n"))
    return g.where((F.col(group) == F.col("_hi")) & (F.col("n") >= least)).drop("_hi")
