"""Exact duplicates by a log-structured merge index of digests, in DataFrame operations only.

Memtables: each task's rows, sorted by digest and flushed as runs of at most ``run_rows`` rows, Parquet files
with a Bloom filter on the digest. Compaction merges the runs into one level that keeps the smallest id and the
number of rows of each digest. Hits (digests of more than one row) are verified byte by byte: a bitmap filter of
fixed size, built from the digests that have hits, lets only texts that may be hits go on, and those are compared
within their digest. Rows of digests whose texts differ are grouped by the text itself, so the result holds even
for digests that collide.

Defined results: a null text counts as empty; the text of a group is what is left after each run of ASCII white
space became one space; a null id is larger than any other, so a group keeps it only if it has no other; rows that
share the smallest id all are kept (they are the same document); an empty table gives an empty result; other
columns of the input are not read, so their names do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import one_spaced, reread, saved, work_dir

#: Rows of a run at most.
RUN_ROWS = 2_000_000
#: Bits of the hit filter: 2 MB whatever the input, in pieces of 32,768 bits. With more hits than bits it
#: lets more texts pass; the comparison behind it stays exact.
FILTER_BITS = 1 << 24


class DigestIndex:
    """Runs and the compacted level of an index below one folder."""

    def __init__(self, spark, path: str, run_rows: int = RUN_ROWS):
        self.spark, self.path, self.run_rows = spark, path, run_rows

    def flush(self, rows: DataFrame) -> None:
        """Append rows (digest, id) as sorted runs; each call adds runs, none is rewritten."""
        self._write(rows.sortWithinPartitions("digest", "id"), "runs", "append")

    def _write(self, rows: DataFrame, level: str, mode: str) -> None:
        (
            rows.write.mode(mode)
            .option("maxRecordsPerFile", self.run_rows)
            .option("parquet.bloom.filter.enabled#digest", "true")
            .option("parquet.bloom.filter.expected.ndv#digest", "100000")
            .parquet(f"{self.path}/{level}")
        )
        self.schema = getattr(self, "schema", None) or rows

    def runs(self) -> DataFrame:
        return reread(self.spark, f"{self.path}/runs", self.schema)

    def compact(self) -> DataFrame:
        """Merge all runs: for each digest the smallest id and the number of rows, sorted by digest."""
        merged = self.runs().groupBy("digest").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        path = f"{self.path}/level1"
        merged.sortWithinPartitions("digest").write.option("parquet.bloom.filter.enabled#digest", "true").option("parquet.bloom.filter.expected.ndv#digest", "100000").parquet(path)
        return reread(self.spark, path, merged)


def _bit(digest: Column) -> Column:
    """Place of a digest in the hit filter: its first 24 bits."""
    return F.conv(F.substring(F.hex(digest), 1, 6), 16, 10).cast("long") % F.lit(FILTER_BITS)


def hit_filter(digests: DataFrame) -> DataFrame:
    """(bucket, bits) of a bitmap over digests: 512 rows of 4 KB at most."""
    at = digests.select(_bit(F.col("digest")).alias("at"))
    return at.groupBy(F.expr("bitmap_bucket_number(at)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("bits"))


def may_hit(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """The rows whose digest has its bit set in the filter."""
    at = _bit(F.col("digest"))
    marked = rows.withColumn("_at", at)
    joined = marked.join(F.broadcast(bits), F.expr("bitmap_bucket_number(_at)") == F.col("bucket"))
    place = F.expr("bitmap_bit_position(_at)")
    byte = F.conv(F.hex(F.expr("substring(bits, cast(bitmap_bit_position(_at) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return joined.where(F.floor(byte / F.pow(F.lit(2), place % 8)) % 2 == 1).select(*rows.columns)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per row of df: id_col, keep_id, group_size, kept, text_sha256."""
    spark = df.sparkSession
    index = DigestIndex(spark, path or work_dir(spark, "lsm"))
    texts = df.select(F.col(id_col).alias("id"), one_spaced(text_col).alias("norm"))
    keyed = texts.withColumn("digest", F.unhex(F.sha2(F.col("norm"), 256)))
    index.flush(keyed.select("digest", "id"))
    level = index.compact()

    hits = level.where("group_size > 1")
    passing = may_hit(keyed, hit_filter(hits))
    compared = passing.join(hits.select("digest"), "digest").groupBy("digest").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi"))
    torn = saved(compared.where("lo <> hi").select("digest"), "torn")

    rows = index.runs().join(level, "digest")
    if torn.isEmpty():
        found = rows
    else:
        apart = keyed.join(torn, "digest")
        groups = apart.groupBy("digest", "norm").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        again = apart.alias("a").join(groups.alias("g"), ["digest", "norm"]).select("digest", "id", "keep_id", "group_size")
        found = rows.join(torn, "digest", "left_anti").select("digest", "id", "keep_id", "group_size").unionByName(again)
    return found.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that exact_dedup keeps, all columns. Rows that share id and text are one document: all stay."""
    gone = exact_dedup(df, id_col, text_col).where("not kept").select(F.struct(F.col(id_col).alias("id"), F.col("text_sha256").alias("sha")).alias("key")).distinct()
    # compared as structs: no name of df can clash, and null ids compare as well
    own = F.struct(df[id_col].alias("id"), F.sha2(one_spaced(df[text_col]), 256).alias("sha"))
    return df.join(gone, own == gone["key"], "left_anti")
