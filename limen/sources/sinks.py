"""Sinks: delimited files, one JSON record, union of unlike rows, upsert by key, resumption by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def union_rows(*parts: DataFrame) -> DataFrame:
    """All rows; columns in the order in which they first appear, absent ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_record(df: DataFrame, path: str) -> None:
    """A small result as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def upsert(old: DataFrame, new: DataFrame, *keys: str, version: str | None = None) -> DataFrame:
    """Of rows with equal keys the latest: by version, or new before old (within one side all but one arbitrary)."""
    both = union_rows(old.withColumn("_side", F.lit(0)), new.withColumn("_side", F.lit(1)))
    order = [F.col(version).desc(), F.col("_side").desc()] if version else [F.col("_side").desc()]
    return both.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k", "_side")


def still_to_do(jobs: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Jobs of a grid without a result: what a resumed run has to compute."""
    return jobs.join(done, list(keys), "left_anti")
