"""Small cases of operators: limits, edges, readers, streaming."""

import gzip

import pytest
from pyspark.sql import functions as F

from limen.api import check_composition, check_expression, estimate_composition
from limen.config import Settings
from limen.functions import numeric as N
from limen.operators import composition as C
from limen.operators import design as D
from limen.operators import expression as X
from limen.operators import links as L
from limen.sources import genomic as G
from limen.sources import sinks as S
from limen.validate import duplicate_keys, require_columns


@pytest.mark.parametrize("bad", [{"abundance": 0}, {"abundance": 1}, {"abundance": -0.2}, {"abundance": 1.5}, {"target_pp": 0}])
def test_settings_are_checked(bad):
    with pytest.raises(ValueError):
        Settings(**bad)


def test_settings_are_frozen():
    with pytest.raises(Exception):
        Settings().seed = 3


def floor_of(spark, a, b, least=200):
    df = spark.createDataFrame([("k", i, x, y) for i, (x, y) in enumerate(zip(a, b))], "key string, feature int, c1 long, c2 long")
    r = X.floors(df, ["key"], least).collect()
    return r[0]["floor"] if r else None


def test_floor_of_a_pair(spark):
    same = list(range(1, 501))
    assert floor_of(spark, same, same) == 0
    assert floor_of(spark, [1, 2, 3], [1, 2, 3]) is None
    assert floor_of(spark, [1] * 300, [0] * 300) is None
    assert floor_of(spark, [1] * 300, [1] * 250 + [0] * 50, 300) is not None


def test_pair_criterion(spark):
    df = spark.createDataFrame([("A", "x", 100, 100), ("A", "y", 100, 100), ("B", "x", 100, 10), ("B", "y", 100, 10), ("C", "x", 95, 5), ("C", "y", 95, 95)], "donor string, celltype string, n1 long, n2 long")
    assert {r.donor for r in C.pair_criterion(df, 50).where("included_in_fit").collect()} == {"A", "C"}


def test_design_laws(spark):
    one = spark.createDataFrame([(1.0, 2.0)], "k1 double, k2 double")
    s = Settings()
    r = one.select(D.nuclei_required(F.col("k1"), s).alias("a"), D.nuclei_required(F.col("k2"), s).alias("b"), D.resolvable_difference(F.col("k1"), F.lit(20), F.lit(5000), s).alias("c"), D.resolvable_difference(F.col("k1"), F.lit(20), F.lit(20000), s).alias("d")).first()
    assert r.a == 6915 and r.b / r.a == pytest.approx(4, rel=1e-3) and r.c / r.d == pytest.approx(2)
    with pytest.raises(ValueError):
        D.composition_design(spark.createDataFrame([("pooled", 1.0)], "source string, kappa double"), s, [(0, 5)])


def test_input_checks(spark):
    with pytest.raises(ValueError, match="missing"):
        require_columns(spark.range(1), ["donor"])
    with pytest.raises(ValueError, match="negative"):
        check_composition(spark.createDataFrame([("A", "x", -1, 2)], "donor string, celltype string, n1 long, n2 long"))
    with pytest.raises(ValueError, match="positive"):
        check_expression(spark.createDataFrame([("A", "x", 0.0, 2.0)], "donor string, celltype string, n_eff double, floor double"))
    with pytest.raises(ValueError):
        estimate_composition(spark.createDataFrame([], "donor string, celltype string, z double, n_eff double"))
    assert duplicate_keys(spark.createDataFrame([(1,), (1,), (2,)], "k int"), "k").count() == 1


def test_band_edges(spark):
    g = spark.createDataFrame([("g", "c", 100)], "gene string, chrom string, tss long")
    p = spark.createDataFrame([(i, "c", m) for i, m in enumerate([89, 90, 100, 109, 110, 111])] + [(9, "d", 100)], "peak int, chrom string, mid long")
    assert sorted(r.mid for r in L.band_join(g, p, 10).collect()) == [90, 100, 109]
    assert sorted(r.mid for r in L.band_join(g, p, 10, closed=True).collect()) == [90, 100, 109, 110]
    far = spark.createDataFrame([("h", "e", 5)], "gene string, chrom string, tss long")
    assert [tuple(r) for r in L.band_counts(far, p, 10, 3).collect()] == [("h", "e", 0, 0)]


def test_distribution_functions(spark):
    r = spark.range(1).select(N.erfc(F.lit(1.0)).alias("e"), N.chi2_sf(F.lit(3.841458820694124), 1).alias("c"), N.student_two_sided(F.lit(2.228138851964939), F.lit(10)).alias("t"), N.half_even(F.lit(2.5)).alias("h")).first()
    assert (r.e, r.c, r.t, r.h) == (pytest.approx(0.15729920705), pytest.approx(0.05), pytest.approx(0.05), 2)


def test_false_discovery(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.02), ("c", 0.03), ("d", 0.9)], "test string, p double").withColumn("fam", F.lit(1))
    assert L.bh_threshold(df, 0.05, "fam").first()["threshold"] == 0.03
    assert L.bh_threshold(df, 0.001, "fam").first()["threshold"] == -1
    assert [round(r.q, 6) for r in L.bh_q(df, "fam").orderBy("test").collect()] == [0.04, 0.04, 0.04, 0.9]


def test_correlation_of_moments(spark):
    cells = spark.createDataFrame([(o, f, float(v)) for o, (a, b) in enumerate([(1, 2), (2, 4), (3, 7), (0, 1)]) for f, v in (("a", a), ("b", b), ("k", 5)) if v], "obs int, feature string, value double")
    pairs = spark.createDataFrame([("a", "b"), ("a", "k")], "x string, y string")
    got = {(r.x, r.y): r.r for r in L.pair_correlation(cells, pairs, 4, inflate=False).collect()}
    import numpy as np

    assert got["a", "b"] == pytest.approx(np.corrcoef([1, 2, 3, 0], [2, 4, 7, 1])[0, 1])
    assert got["a", "k"] == 0


def test_text_formats(spark, tmp_path):
    m = tmp_path / "m.mtx.gz"
    m.write_bytes(gzip.compress(b"%%MatrixMarket matrix coordinate integer general\n% x\n3 4 3\n1 1 5\n3 4 0\n2 2 7\n"))
    df, dims = G.read_matrix_market(spark, str(m))
    assert dims == (3, 4, 3) and sorted(map(tuple, df.collect())) == [(0, 0, 5), (1, 1, 7), (2, 3, 0)]
    t = tmp_path / "a.gtf"
    t.write_text('#c\nchr1\ts\tgene\t10\t20\t.\t-\t.\tgene_id "G1"; gene_name "N";\nchr1\ts\texon\t10\t20\t.\t-\t.\tgene_id "G1";\n')
    assert [tuple(r) for r in G.read_gtf_genes(spark, str(t)).collect()] == [("N", "G1", "chr1", 20, "-", None)]
    b = tmp_path / "a.bed"
    b.write_text("chr1\t10\t21\nx\t1\t2\n")
    assert [r.mid for r in G.read_bed(spark, str(b)).collect()] == [15]
    e = tmp_path / "a.bedpe"
    e.write_text("chr1\t10\t20\tchr1\t90\t100\t<P1><GENE.1>\t0.5\tx\ty\t1e-3\t80\tpeak-gene\nchr1\t10\t20\tchr1\t90\t100\t<GENE2><P2>\t0.5\tx\ty\t1e-3\t80\tgene-peak\n")
    assert sorted((r.gene, r.mid) for r in G.read_bedpe(spark, str(e)).collect()) == [("GENE", 15), ("GENE2", 95)]
    j = tmp_path / "run_7.json"
    j.write_text('{"n": 3,\n "bands": [1, 2]}')
    assert [(r.n, r.tag) for r in G.read_run_records(spark, str(j)).collect()] == [(3, "run_7")]


def test_sinks(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "z", 1)], "k int, v string, w int")
    assert sorted((r.k, r.v) for r in S.upsert(a, b, "k").collect()) == [(1, "x"), (2, "z")]
    assert S.union_rows(a, b).columns == ["k", "v", "w"]
    assert [r.k for r in S.still_to_do(a, b, "k").collect()] == [1]
    S.write_csv(a, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2


def test_streaming_pseudobulk_equals_the_batch(spark, tmp_path):
    from limen.streaming.pseudobulk import count_stream, running_pseudobulk, start

    rows = spark.createDataFrame([("a", i % 3, i % 4) for i in range(40)], "grp string, feature int, value int")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    q = start(running_pseudobulk(count_stream(spark, str(tmp_path / "in"), "grp string, feature int, value int", 1), ["grp"]), "bulk", str(tmp_path / "ck"))
    q.awaitTermination(120)
    want = {tuple(r) for r in X.pseudobulk(rows, ["grp"]).collect()}
    assert {tuple(r) for r in spark.table("bulk").collect()} == want


def test_partitioning_does_not_matter(spark):
    rows = spark.createDataFrame([(f"d{i % 7}", f"t{i % 5}", i % 9 + 1, i % 4 + 2) for i in range(300)], "donor string, celltype string, n1 int, n2 int").groupBy("donor", "celltype").agg(F.sum("n1").alias("n1"), F.sum("n2").alias("n2"))
    once = [C.kappa(C.packaged_pairs(rows.repartition(n))).first()["kappa"] for n in (1, 5)]
    assert once[0] == pytest.approx(once[1], rel=1e-12)
