"""What the operators share: the shared folder, written tables, shipping the package to executors."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts write it.
ASCII_SPACE = r"[\x20\x09-\x0D]+"

#: Bytes of an Arrow batch between Spark and Python at most (a single row may be larger): long texts and index
#: blocks must not meet by the thousand.
BATCH_BYTES = 1 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

_shipped: set[str] = set()


_caches: dict[str, dict] = {}


def own_caches(operator: str, cache: dict) -> dict:
    """cache, after those of other operators are emptied: Python workers outlive a stage, and would keep them all."""
    if operator not in _caches:
        for other in _caches.values():
            other.clear()
        _caches.clear()
        _caches[operator] = cache
        give_back()
    return cache


def give_back() -> None:
    """Freed memory goes back to the system: an allocator would keep it, and the executor's other processes need it."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library than glibc
        pass


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of tables that are written by now: Spark deletes them when its driver collects what
    refers to them, which by itself may take until the end."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a temporary one if the master
    is local (tests), as on a cluster other machines would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="limen-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/limen-{name}-{uuid.uuid4().hex[:12]}"


def reread(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table at path; its schema is given, so that an empty table is read as well."""
    return spark.read.schema(like.schema).parquet(path)


def saved(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df as a written table in the shared folder: it cuts lineage and outlives any executor."""
    spark = df.sparkSession
    path = path or work_dir(spark, name)
    df.write.parquet(path)
    return reread(spark, path, df)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that no later step reads."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once for each application; bound the bytes of an Arrow batch."""
    if int(spark.conf.get(_BATCH).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(_BATCH, BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(root):
        to = os.path.join(tempfile.mkdtemp(prefix="limen-ship-"), "limen.zip")
        with zipfile.ZipFile(to, "w") as z:
            for folder, _, names in os.walk(root):
                for n in names:
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.join("limen", os.path.relpath(full, root)))
        spark.sparkContext.addPyFile(to)
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: str | Column) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(c.cast("string"), F.lit(""))


def one_spaced(text: str | Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(text_or_empty(text), ASCII_SPACE, " ")


def range_ranked(df: DataFrame, group: list[str], order: list[str], rank: str, name: str) -> DataFrame:
    """Gapless ranks from 0 within each group, in order, without a group ever meeting in one task.

    The rows are range-partitioned by (group, order), sorted and written with their partition number and
    their place in it. A small table of (partition, group) starts follows; it has at most as many rows as
    partitions plus groups (a range partition holds neighbouring groups), so callers keep groups few: it is
    broadcast. Ties in order are ranked by place.
    """
    spark = df.sparkSession
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    low = (1 << 33) - 1
    placed = (
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit(low)))
    )
    placed = saved(placed, name)
    counts = placed.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    rows = sorted(counts.collect(), key=lambda r: r["_part"])
    total: dict[tuple, int] = {}
    starts = []
    for r in rows:
        key = tuple(r[g] for g in group)
        starts.append((r["_part"], *key, total.get(key, 0) - r["_first"]))
        total[key] = total.get(key, 0) + r["_n"]
    fields = {f.name: f for f in placed.schema.fields}
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("_part", T.IntegerType()), *[fields[g] for g in group], T.StructField("_shift", T.LongType())])
    shift = spark.createDataFrame(starts, schema)
    on = placed["_part"] == shift["_part"]
    for g in group:
        on = on & placed[g].eqNullSafe(shift[g])
    joined = placed.join(F.broadcast(shift), on)
    return joined.select(*[placed[c] for c in df.columns], (placed["_place"] + shift["_shift"]).alias(rank))
