"""Sparse triplets laid out by row: an offset table, spans cut at row boundaries, and reads that open only their files.

The offset table has each row's length and the running sum of lengths before it. A span is the rows that start within
``span_entries`` consecutive entries, so it holds whole rows; it is a folder of its own, in which a row of more
entries than that lies in several files. Slices find their spans in the offset table and name them to the scan, which
opens no other folder. The number of spans is the number of folders, which Spark's own listing holds on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SPAN_ENTRIES = 4 << 20
#: Rows whose running sums one task makes; the totals of as many rows are one row of the next step.
STRETCH = 1 << 13


@dataclass
class RowLayout:
    """entries: row, col, value, span; offsets: row, start, length, span."""

    entries: DataFrame
    offsets: DataFrame

    def spans(self) -> DataFrame:
        """The chunks of a scan: span, first_row, last_row, n_rows, start, entries."""
        o = self.offsets.groupBy("span").agg(F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.count(F.lit(1)).alias("n_rows"), F.min("start").alias("start"), F.sum("length").alias("entries"))
        return o

    def _within(self, spans: DataFrame) -> DataFrame:
        return self.entries.where(F.col("span").isin([r["span"] for r in spans.select("span").distinct().collect()]))

    def rows(self, wanted: DataFrame) -> DataFrame:
        """The entries of the wanted rows (a table with a column row, once each, and what else it has, such as new numbers)."""
        found = self._within(self.offsets.join(wanted.select("row"), "row", "left_semi"))
        return found.join(wanted, "row").drop("span")

    def between(self, first: int, last: int) -> DataFrame:
        """The entries of rows first to last, both included."""
        inside = F.col("row").between(first, last)
        return self._within(self.offsets.where(inside)).where(inside).drop("span")


def offsets(entries: DataFrame, span_entries: int = SPAN_ENTRIES) -> DataFrame:
    """row, start (entries before it), length, span: prefix sums in two steps, by stretches of rows and within them."""
    length = entries.groupBy("row").agg(F.count(F.lit(1)).alias("length")).withColumn("_stretch", F.expr(f"row div {STRETCH}"))
    before = Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    totals = length.groupBy("_stretch").agg(F.sum("length").alias("_n"))
    shift = totals.select("_stretch", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    own = F.coalesce(F.sum("length").over(Window.partitionBy("_stretch").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = length.withColumn("_own", own).join(shift, "_stretch").withColumn("start", F.col("_shift") + F.col("_own"))
    return start.select("row", "start", "length", F.expr(f"start div {span_entries}").alias("span"))


def write_rows(entries: DataFrame, path: str, span_entries: int = SPAN_ENTRIES) -> RowLayout:
    """entries: row, col, value; written below path by row."""
    spark = entries.sparkSession
    offsets(entries, span_entries).write.parquet(f"{path}/offsets")
    table = spark.read.parquet(f"{path}/offsets").select("row", "span", F.expr(f"length div {span_entries} + 1").alias("_parts"))
    # a row longer than a span is dealt over several tasks and files
    placed = entries.select("row", "col", "value").join(table, "row").withColumn("_part", F.pmod(F.xxhash64("col"), F.col("_parts")))
    placed.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "span", "_part").sortWithinPartitions("span", "row", "col").drop("_parts", "_part").write.partitionBy("span").parquet(f"{path}/entries")
    return open_rows(spark, path)


def open_rows(spark: SparkSession, path: str) -> RowLayout:
    table = spark.read.parquet(f"{path}/offsets")
    kept = spark.read.option("basePath", f"{path}/entries").parquet(f"{path}/entries") if table.limit(1).count() else spark.createDataFrame([], "row long, col long, value long, span long")
    return RowLayout(kept.withColumn("span", F.col("span").cast("long")), table)


def take_columns(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """The non-zero entries of the wanted columns (col, new) under their new numbers."""
    return entries.where("value <> 0").join(wanted.select("col", "new"), "col").select("row", F.col("new").alias("col"), "value")


def numbered(df: DataFrame, name: str = "index") -> DataFrame:
    """df, just read from files, with gapless numbers from 0: the places of its rows by file name and within the file.

    A row for each block that Spark reads is broadcast. df is read twice: the same files give the same rows."""
    block = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")]
    placed = df.select("*", *block, F.monotonically_increasing_id().alias("_at"))
    sizes = placed.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = sizes.select("_file", "_start", (before - F.col("_first")).alias("_shift"))
    return placed.join(F.broadcast(shift), ["_file", "_start"]).select(*df.columns, (F.col("_at") + F.col("_shift")).alias(name))
