"""Checks at the boundary: columns, ranges, keys."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, required: Iterable[str], what: str = "input") -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing columns {missing}; present: {df.columns}")
    return df


def reject_rows(df: DataFrame, bad: Column, why: str) -> DataFrame:
    """df, if no row is bad; else an error with their number."""
    n = df.agg(F.count_if(bad)).first()[0]
    if n:
        raise ValueError(f"{n} rows: {why}")
    return df


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
