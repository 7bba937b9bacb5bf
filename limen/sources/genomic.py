"""Readers of positional text formats: MatrixMarket, GTF, BED, BEDPE, interval names."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from limen.sources.matrix_market import open_matrix
from limen.sources.row_layout import numbered
from limen.sources.scratch import written

INTERVAL = r"^(.+?)[:-](\d+)-(\d+)$"


def interval_columns(name: str) -> list[Column]:
    """chrom and mid of names like chr1:10-20 or chr1-10-20; null where a name is none."""
    part = lambda i: F.nullif(F.regexp_extract(name, INTERVAL, i), F.lit(""))
    return [part(1).alias("chrom"), F.expr(f"(try_cast(nullif(regexp_extract({name}, r'{INTERVAL}', 2), '') AS BIGINT) + try_cast(nullif(regexp_extract({name}, r'{INTERVAL}', 3), '') AS BIGINT)) div 2").alias("mid")]


def read_delimited(spark: SparkSession, path: str | list[str], schema: str, sep: str = "\t", header: bool = True, comment: str | None = None, quote: str | None = None) -> DataFrame:
    """Text table by an explicit schema; quote=None takes quotes as plain characters. Gzip by suffix."""
    r = spark.read.schema(schema).option("sep", sep).option("header", header).option("quote", quote or "\u0000")
    return (r.option("comment", comment) if comment else r).csv(path)


def read_matrix_market(spark: SparkSession, path: str, rows: int | None = None, cols: int | None = None) -> tuple[DataFrame, tuple[int, int, int]]:
    """((row, col, value), (rows, cols, entries)) of a coordinate file; indices from 0, explicit zeros kept.

    The text is parsed once, into a written table that is checked against the head of the file and, where given, the
    numbers of feature and barcode names; ValueError where they differ. For scans without that table see
    limen.sources.matrix_market.open_matrix."""
    m = open_matrix(spark, path, rows, cols)
    try:
        table = written(m.entries, "matrix")
    except PySparkException as wrong:
        raise ValueError(f"{path}: {wrong}") from None
    m.check()
    return table, m.head.dims


def read_dictionary(spark: SparkSession, path: str | list[str], schema: str, header: bool = False) -> DataFrame:
    """A table of feature or barcode names with index, the place of each line from 0: the row or column of a matrix
    that it names."""
    return numbered(read_delimited(spark, path, schema, header=header))


def read_gtf_genes(spark: SparkSession, path: str) -> DataFrame:
    """(gene_name, gene_id, chrom, tss, strand, gene_type) of gene lines; tss by strand."""
    t = read_delimited(spark, path, "chrom string, source string, kind string, start long, end long, score string, strand string, frame string, attributes string", header=False, comment="#").where("kind = 'gene'")
    attr = lambda k: F.nullif(F.regexp_extract("attributes", f'{k} "([^"]+)"', 1), F.lit("")).alias(k)
    return t.select(attr("gene_name"), attr("gene_id"), "chrom", F.when(F.col("strand") == "-", F.col("end")).otherwise(F.col("start")).alias("tss"), "strand", attr("gene_type"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    t = read_delimited(spark, path, "chrom string, start long, end long", header=False)
    return t.where(F.col("chrom").startswith("chr")).withColumn("mid", F.expr("(start + end) div 2"))


def read_bedpe(spark: SparkSession, path: str) -> DataFrame:
    """Links with the peak side chosen by type: the first anchor for peak-gene, the second for gene-peak."""
    t = read_delimited(spark, path, "c1 string, s1 long, e1 long, c2 string, s2 long, e2 long, name string, corr double, x string, y string, sig double, dist long, type string", header=False)
    first = F.col("type") == "peak-gene"
    names = [F.regexp_extract("name", "<([^>]*)><([^>]*)>", i) for i in (1, 2)]
    gene = F.regexp_replace(F.when(first, names[1]).otherwise(names[0]), r"\.\d+$", "")
    return t.where("type IN ('peak-gene', 'gene-peak')").select(
        F.when(first, F.col("c1")).otherwise(F.col("c2")).alias("chrom"),
        F.when(first, F.expr("(s1 + e1) div 2")).otherwise(F.expr("(s2 + e2) div 2")).alias("mid"),
        gene.alias("gene"), "corr", "sig", "dist",
    )


def read_run_records(spark: SparkSession, path: str, schema: str | None = None, tag: str = r"([^/]+)\.json$") -> DataFrame:
    """JSON records, one a file, with the tag that the file's name holds."""
    r = spark.read.option("multiLine", True)
    df = (r.schema(schema) if schema else r).json(path)
    return df.withColumn("tag", F.regexp_extract(F.col("_metadata.file_path"), tag, 1))
