"""Structured Streaming twin of the pseudobulk: files of count rows in, running sums by group and feature out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def count_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """New Parquet files below path as a stream; resumption is the checkpoint's, by file."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_pseudobulk(stream: DataFrame, groups: list[str], feature: str = "feature", value: str = "value") -> DataFrame:
    """Sums so far by group and feature, explicit zeros dropped; state has a row for each group and feature."""
    return stream.where(F.col(value) != 0).groupBy(*groups, feature).agg(F.sum(value).alias("count"))


def start(bulk: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Run over all files that are there, then stop; the sums are the in-memory table ``name`` (small results)."""
    return bulk.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def bulk_by_batch(spark: SparkSession, path: str, cells: DataFrame, groups: list[str], work: str, max_bytes: int, split: int) -> StreamingQuery:
    """Pseudobulk of a MatrixMarket file in micro-batches that resume within the file: each batch writes its sums to a
    folder of its own below work, so a batch that is repeated overwrites what it wrote.

    cells: col and the groups of each column. They are written once, in the order of col, and a batch asks for those
    between its least and largest column: where the file has its columns in order, each cell is read by a batch or two.
    The checkpoint and the reader's notes lie below work as well."""
    from limen.sources.matrix_market import matrix_stream

    held = f"{work}/cells"
    cells.repartitionByRange("col").sortWithinPartitions("col").write.mode("overwrite").option("parquet.block.size", 1 << 20).parquet(held)

    def sums(batch: DataFrame, number: int) -> None:
        low, high = batch.agg(F.min("col"), F.max("col")).first()
        near = batch.sparkSession.read.schema(cells.schema).parquet(held).where(F.col("col").between(low, high))
        rows = batch.join(near, "col").withColumnRenamed("row", "feature").where("value <> 0")
        rows.groupBy(*groups, "feature").agg(F.sum("value").alias("count")).write.mode("overwrite").parquet(f"{work}/sums/batch={number}")

    stream = matrix_stream(spark, path, f"{work}/progress", max_bytes, split)
    return stream.writeStream.foreachBatch(sums).option("checkpointLocation", f"{work}/checkpoint").start()


def finish(query: StreamingQuery) -> None:
    """Process all that is there, then stop."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def matrix_bulk(spark: SparkSession, work: str, groups: list[str]) -> DataFrame:
    """What the batches below work add up to; complete once the stream has ended."""
    return spark.read.parquet(f"{work}/sums").groupBy(*groups, "feature").agg(F.sum("count").alias("count"))
