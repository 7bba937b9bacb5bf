"""Queries of the matrix sources: matrices are written from the given tables, then scanned, sliced and streamed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from limen.operators.expression import pseudobulk
from limen.plans.catalogue import query
from limen.plans.domain import read
from limen.sources.matrix_market import Matrix, open_matrix, write_matrix
from limen.sources.row_layout import RowLayout, take_columns, write_rows
from limen.sources.scratch import place
from limen.streaming.pseudobulk import bulk_by_batch, finish, matrix_bulk

FEATURES = 300
#: Bytes of a range and of a micro-batch of the queries' matrices: small ones have several all the same.
SPLIT, TRIGGER = 1 << 20, 8 << 20
SPAN = 2000


def _quantities(spark, sf) -> Matrix:
    """Quantities of lineitem as a matrix of features and orders, written in the order of its columns and opened."""
    orders = read(spark, sf, "orders").agg(F.max("o_orderkey")).first()[0] + 1
    li = read(spark, sf, "lineitem").select((F.col("l_partkey") % FEATURES).alias("row"), F.col("l_orderkey").alias("col"), F.col("l_quantity").cast("long").alias("value"))
    # ranges of columns serve the sums as well: one shuffle
    li = li.repartitionByRange("col").groupBy("row", "col").agg(F.sum("value").alias("value")).sortWithinPartitions("col", "row")
    path = place(spark, "matrix")
    write_matrix(li, path, FEATURES, orders)
    return open_matrix(spark, path, rows=FEATURES, cols=orders, split=SPLIT)


def _cells(spark, sf) -> DataFrame:
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("col"), F.col("o_orderpriority").alias("grp"))


BULK = f"""SELECT o_orderpriority AS grp, l_partkey % {FEATURES} AS feature, cast(sum(cast(l_quantity AS BIGINT)) AS BIGINT) AS "count"
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2"""


@query(BULK)
def matrix_scan_pseudobulk(spark, sf):
    """One scan of a MatrixMarket matrix in ranges of bytes, summed by the groups of its columns."""
    cells = _quantities(spark, sf).entries.join(_cells(spark, sf), "col").withColumnRenamed("row", "feature")
    return pseudobulk(cells, ["grp"])


@query(BULK)
def matrix_stream_pseudobulk(spark, sf):
    """The same by micro-batches that resume within the file."""
    path, work = _quantities(spark, sf).path, place(spark, "matrix-stream")
    finish(bulk_by_batch(spark, path, _cells(spark, sf), ["grp"], work, TRIGGER, SPLIT))
    return matrix_bulk(spark, work, ["grp"])


@query("SELECT count(*) AS stored, count_if(q = 0) AS zeros, cast(sum(q) AS BIGINT) AS total, cast(max(p) AS BIGINT) AS last_row, cast(max(o) AS BIGINT) AS last_col FROM (SELECT l_partkey % 300 AS p, l_orderkey AS o, sum(cast(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY 1, 2)")
def matrix_scan_checked(spark, sf):
    """Totals of a scan whose number of triplets is held against the head of the file."""
    m = _quantities(spark, sf)
    total = m.entries.agg(F.count_if(F.col("value") == 0).alias("zeros"), F.sum("value").alias("total"), F.max("row").alias("last_row"), F.max("col").alias("last_col")).collect()
    return spark.createDataFrame([(m.check(), *total[0])], "stored long, zeros long, total long, last_row long, last_col long")


def _by_part(spark, sf) -> RowLayout:
    """Quantities by part (row) and supplier (col), laid out by row."""
    entries = read(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("col")).agg(F.sum(F.col("l_quantity").cast("long")).alias("value"))
    return write_rows(entries, place(spark, "rows"), SPAN)


ENTRIES = "en AS (SELECT l_partkey AS row, l_suppkey AS col, cast(sum(cast(l_quantity AS BIGINT)) AS BIGINT) AS value FROM lineitem GROUP BY 1, 2)"
OFFSETS = f"""{ENTRIES}, ln AS (SELECT row, count(*) AS length FROM en GROUP BY 1),
ofs AS (SELECT row, length, cast(sum(length) OVER (ORDER BY row) - length AS BIGINT) AS start FROM ln)"""


@query(f"""WITH {ENTRIES}, wanted AS (SELECT p_partkey AS row, row_number() OVER (ORDER BY p_partkey) - 1 AS new FROM part WHERE p_size = 15)
SELECT row, new, col, value FROM en JOIN wanted USING (row)""")
def matrix_row_slice(spark, sf):
    """Wanted rows of a layout by row, under new numbers: only the spans that hold them are opened."""
    parts = read(spark, sf, "part").where("p_size = 15").select(F.col("p_partkey").alias("row"))
    wanted = parts.withColumn("new", (F.row_number().over(Window.orderBy("row")) - 1).cast("long"))  # the asked rows: few
    return _by_part(spark, sf).rows(wanted).select("row", "new", "col", "value")


@query(f"WITH {ENTRIES}, m AS (SELECT max(row) AS top FROM en) SELECT row, col, value FROM en, m WHERE row BETWEEN top // 4 AND top // 3")
def matrix_row_range(spark, sf):
    """A range of rows."""
    layout = _by_part(spark, sf)
    top = layout.offsets.agg(F.max("row")).first()[0] or 0
    return layout.between(top // 4, top // 3).select("row", "col", "value")


@query(f"""WITH {OFFSETS} SELECT start // {SPAN} AS span, min(row) AS first_row, max(row) AS last_row, count(*) AS n_rows, min(start) AS start, cast(sum(length) AS BIGINT) AS entries, cast(sum(total) AS BIGINT) AS total
FROM ofs JOIN (SELECT row, sum(value) AS total FROM en GROUP BY 1) USING (row) GROUP BY 1""")
def matrix_chunk_scan(spark, sf):
    """Sums by chunk, each of whole rows."""
    layout = _by_part(spark, sf)
    return layout.spans().join(layout.entries.groupBy("span").agg(F.sum("value").alias("total")), "span")


@query(f"WITH {ENTRIES}, w AS (SELECT s_suppkey AS col, row_number() OVER (ORDER BY s_suppkey) - 1 AS new FROM supplier WHERE s_nationkey = 3) SELECT row, new AS col, value FROM en JOIN w USING (col) WHERE value <> 0")
def matrix_column_extract(spark, sf):
    """Wanted columns under new numbers, zeros left out."""
    few = read(spark, sf, "supplier").where("s_nationkey = 3").select(F.col("s_suppkey").alias("col"))
    wanted = few.withColumn("new", (F.row_number().over(Window.orderBy("col")) - 1).cast("long"))
    return take_columns(_by_part(spark, sf).entries, wanted)
