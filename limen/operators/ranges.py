"""Order-dependent steps over sorted ranges: no group meets in one task, whatever its size.

Rows are dealt by range of (group, order) and written with the number of their range. What a range needs to know of
those before it (sums, last values) comes from a table with one row for each range and group, which is small: as many
rows as ranges and groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from limen.sources.scratch import written


def dealt(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """df as a written table, in ranges of (group, order), with the range's number in _part."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    return written(df.repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id()), name)


def _null_safe(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    on = F.lit(True)
    for c in names:
        on = on & a[c].eqNullSafe(b[c])
    return on


def running_total(placed: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """placed (from dealt) with the sum of value over the group's rows up to the own one, in order."""
    rows = placed.withColumn("_value", value)
    parts = rows.groupBy("_part", *group).agg(F.sum("_value").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = parts.select("_part", *group, before.alias("_before"))
    own = F.sum("_value").over(Window.partitionBy("_part", *group).orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_own", own)
    out = rows.join(F.broadcast(shift), _null_safe(rows, shift, ["_part", *group]))
    return out.select(*[rows[c] for c in placed.columns], (F.col("_before") + F.col("_own")).alias(name))


def previous(placed: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """placed (from dealt) with the value of the group's row before, in order; null for the first one."""
    sort = [F.col(c).asc_nulls_first() for c in order]
    lasts = placed.groupBy("_part", *group).agg(F.max_by(value, F.struct(*order)).alias("_last"))
    shift = lasts.select("_part", *group, F.lag("_last").over(Window.partitionBy(*group).orderBy("_part")).alias("_before"))
    rows = placed.withColumn("_own", F.lag(value).over(Window.partitionBy("_part", *group).orderBy(*sort)))
    first = F.row_number().over(Window.partitionBy("_part", *group).orderBy(*sort)) == 1
    rows = rows.withColumn("_first", first)
    out = rows.join(F.broadcast(shift), _null_safe(rows, shift, ["_part", *group]))
    return out.select(*[rows[c] for c in placed.columns], F.when(rows["_first"], F.col("_before")).otherwise(rows["_own"]).alias(name))


def weighted_cut(df: DataFrame, group: str, value: str, tie: str, weight: str, share: float, extra: Column) -> DataFrame:
    """Per group n and the value at which the running sum of weights, in order of (value, tie), first reaches ``share``
    of the total and ``extra`` (an aggregate); the largest value where it does not.

    Two passes over the ranges: their sums tell in which one each group's cut lies, and only that one is sorted."""
    placed = dealt(df.select(group, value, tie, weight), [group], [value, tie], "weights")
    parts = placed.groupBy("_part", group).agg(F.sum(weight).alias("_sum"), F.count(F.lit(1)).alias("_n"), F.max(value).alias("_top"))
    goal = placed.groupBy(F.col(group).alias("_g")).agg(((F.sum(weight) + extra) * share).alias("_goal"))
    order = Window.partitionBy(group).orderBy("_part")
    sums = parts.withColumn("_to", F.sum("_sum").over(order)).withColumn("n", F.sum("_n").over(Window.partitionBy(group)))
    sums = sums.join(F.broadcast(goal), F.col(group).eqNullSafe(F.col("_g")))
    reached = F.min(F.when(F.col("_to") >= F.col("_goal"), F.struct("_part", (F.col("_to") - F.col("_sum")).alias("before")))).alias("at")
    cut = sums.groupBy(F.col(group).alias("_g")).agg(reached, F.max("_top").alias("_top"), F.first("_goal").alias("_goal"), F.first("n").alias("n"))
    inside = placed.join(F.broadcast(cut), placed[group].eqNullSafe(cut["_g"]) & (placed["_part"] == cut["at._part"]))
    run = F.col("at.before") + F.sum(weight).over(Window.partitionBy(group).orderBy(value, tie).rowsBetween(Window.unboundedPreceding, 0))
    first = inside.withColumn("_run", run).where(F.col("_run") >= F.col("_goal")).groupBy(F.col(group).alias("_h")).agg(F.min(value).alias("_cut"))
    # sums by range and row by row may differ in the last digit: the range's last value is then the cut
    tops = parts.select(F.col(group).alias("_i"), "_part", F.col("_top").alias("_end"))
    out = cut.join(first, cut["_g"].eqNullSafe(first["_h"]), "left").join(tops, cut["_g"].eqNullSafe(tops["_i"]) & (F.col("at._part") == tops["_part"]), "left")
    return out.select(F.col("_g").alias(group), "n", F.coalesce("_cut", "_end", cut["_top"]).alias("threshold"))
