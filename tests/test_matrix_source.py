"""The MatrixMarket source against plain parses: ranges, folders, kinds, resumption; slices by row and their files."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from limen.sources.genomic import read_dictionary
from limen.sources.matrix_market import Bytes, open_matrix, parse, write_matrix
from limen.sources.row_layout import offsets, take_columns, write_rows
from limen.streaming.pseudobulk import bulk_by_batch, finish, matrix_bulk


def matrix(seed, n, field="integer", rows=40, cols=500, odd=True):
    rng = random.Random(seed)
    value = lambda: rng.randint(0, 9) if field == "integer" else round(rng.uniform(-2, 2), rng.randint(0, 12))
    entries = [(rng.randrange(rows), rng.randrange(cols), 1 if field == "pattern" else value()) for _ in range(n)]
    lines = [f"{r + 1} {c + 1}" + ("" if field == "pattern" else f" {v}") for r, c, v in entries]
    if odd:
        lines = [x for line in lines for x in ([line, "% a comment"] if rng.random() < 0.01 else ["", line.replace(" ", "\t  ")] if rng.random() < 0.01 else [line])]
    return entries, f"%%MatrixMarket matrix coordinate {field} general\n%made here\n{rows} {cols} {n}\n" + "\n".join(lines)


def got(m):
    return sorted(tuple(r) for r in m.entries.collect())


@pytest.mark.parametrize("field", ["integer", "real", "pattern"])
@pytest.mark.parametrize("split", [1, 97, 4096, 1 << 20])
def test_equals_a_plain_parse(spark, tmp_path, field, split):
    entries, text = matrix(1, 30 if split == 1 else 3000, field)
    path = tmp_path / "m.mtx"
    path.write_text(text)
    m = open_matrix(spark, str(path), rows=40, cols=500, split=split)
    assert got(m) == sorted(entries)
    assert m.check() == len(entries)
    if split < 1 << 20:
        assert m.entries.rdd.getNumPartitions() == -(-(path.stat().st_size - m.head.body) // split)


def test_every_cut_gives_every_line_once(tmp_path):
    text = "%%MatrixMarket x\n" + "".join(f"{i} {'x' * (i % 7)}\n" for i in range(60)) + "last"
    path = tmp_path / "t"
    path.write_text(text)
    source = Bytes(str(path))
    for cut in range(1, len(text)):
        for size in (3, 1000):
            parts = [b"".join(x for _, x in source.blocks(a, b, size)) for a, b in ((0, cut), (cut, len(text)))]
            assert b"".join(parts) == text.encode() and (not parts[1] or text[len(parts[0]) - 1] == "\n")


def test_folder_of_files_and_gzip(spark, tmp_path):
    entries, text = matrix(2, 2000, odd=False)
    head, body = text.split("\n")[:3], text.split("\n")[3:]
    folder = tmp_path / "m"
    folder.mkdir()
    (folder / "z-head").write_text("\n".join(head) + "\n")
    for k in range(4):
        (folder / f"part-{k}").write_text("\n".join(body[k::4]) + "\n" * (k % 2))
    (folder / "_SUCCESS").write_text("")
    m = open_matrix(spark, f"file://{folder}", split=1000)
    assert got(m) == sorted(entries) and m.check() == 2000
    (tmp_path / "m.mtx.gz").write_bytes(gzip.compress(text.encode()))
    m = open_matrix(spark, str(tmp_path / "m.mtx.gz"), split=1000)
    assert got(m) == sorted(entries) and m.check() == 2000


def test_written_and_read_back(spark, tmp_path):
    rows = [(0, 4, 1.5), (2, 0, -0.25), (1, 1, 0.0)]
    write_matrix(spark.createDataFrame(rows, "row long, col long, value double"), f"file://{tmp_path}/w", 3, 5)
    m = open_matrix(spark, f"file://{tmp_path}/w")
    assert (m.head.dims, got(m)) == ((3, 5, 3), sorted(rows))
    write_matrix(spark.createDataFrame([], "row long, col long, value long"), f"file://{tmp_path}/e", 0, 0)
    m = open_matrix(spark, f"file://{tmp_path}/e")
    assert (m.head.dims, got(m), m.check()) == ((0, 0, 0), [], 0)


def test_symmetric(spark, tmp_path):
    for kind, sign in (("symmetric", 1), ("skew-symmetric", -1)):
        path = tmp_path / kind
        path.write_text(f"%%MatrixMarket matrix coordinate integer {kind}\n3 3 2\n2 1 5\n3 3 {0 if sign < 0 else 7}\n")
        m = open_matrix(spark, str(path))
        assert got(m) == sorted([(1, 0, 5), (0, 1, sign * 5), (2, 2, 0 if sign < 0 else 7)]) and m.check() == 2


@pytest.mark.parametrize("body, said", [("2 2 1\n3 1 1\n", "declares"), ("2 2 1\n1 1 0.5\n", "fraction"), ("2 2 1\n1 1\n", "fields"), ("2 2 1\n1 1 1 1\n", "fields"), ("2 2\n", "dimension line"), ("", "dimension line")])
def test_faults_are_told(spark, tmp_path, body, said):
    path = tmp_path / "m.mtx"
    path.write_text("%%MatrixMarket matrix coordinate integer general\n" + body)
    with pytest.raises(Exception, match=said):
        open_matrix(spark, str(path)).entries.collect()


def test_names_and_counts_are_checked(spark, tmp_path):
    path = tmp_path / "m.mtx"
    path.write_text("%%MatrixMarket matrix coordinate real general\n2 3 5\n1 1 0.7\n2 3 3.9\n")
    with pytest.raises(ValueError, match="2 rows, but 4 names"):
        open_matrix(spark, str(path), rows=4)
    m = open_matrix(spark, str(path), rows=2, cols=3)
    assert got(m) == [(0, 0, 0.7), (1, 2, 3.9)]
    with pytest.raises(ValueError, match="2 triplets, the file declares 5"):
        m.check()


def test_wholes_stay_exact():
    assert [x.tolist() for x in parse(b"9007199254740993 1 9007199254740993\n", "integer")] == [[9007199254740993], [1], [9007199254740993]]
    assert [x.tolist() for x in parse(b"9007199254740993  1  9007199254740993\n", "integer")] == [[9007199254740993], [1], [9007199254740993]]


def test_stream_resumes_within_the_file(spark, tmp_path):
    entries, text = matrix(3, 4000)
    path = tmp_path / "m.mtx"
    path.write_text(text)
    cells = spark.createDataFrame([(c, f"g{c % 3}") for c in range(500)], "col long, grp string")
    expected = {}
    for r, c, v in entries:
        if v:
            expected[f"g{c % 3}", r] = expected.get((f"g{c % 3}", r), 0) + v
    work, most = f"file://{tmp_path}/work", len(text) // 9
    started = []
    for leg in range(3):  # stopped in the midst twice, then left to end
        q = bulk_by_batch(spark, str(path), cells, ["grp"], work, most, 512)
        if leg < 2:
            while not q.lastProgress or q.lastProgress["numInputRows"] == 0:
                if q.exception():
                    raise q.exception()
            q.stop()
        else:
            finish(q)
        started.append(len(list((tmp_path / "work" / "sums").glob("batch=*"))))
    assert started[0] < started[2] and started[2] >= 9
    assert {(r.grp, r.feature): r["count"] for r in matrix_bulk(spark, work, ["grp"]).collect()} == expected


def test_batches_ask_for_their_cells(spark, tmp_path):
    """Cells are made ready once (before: every batch read and shuffled all of them)."""
    lines = [f"{k % 7 + 1} {c + 1} {k % 5 + 1}" for c in range(600) for k in range(4)]
    path = tmp_path / "m.mtx"
    path.write_text("\n".join(["%%MatrixMarket matrix coordinate integer general", f"7 600 {len(lines)}", *lines]))
    asked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def group(c):
        asked.add(1)
        return f"g{c % 3}"

    cells = spark.range(600).select(F.col("id").alias("col"), group.asNondeterministic()("id").alias("grp"))
    work = f"file://{tmp_path}/work"
    finish(bulk_by_batch(spark, str(path), cells, ["grp"], work, path.stat().st_size // 9, 512))
    assert len(list((tmp_path / "work" / "sums").glob("batch=*"))) >= 9 and asked.value <= 3 * 600
    assert sum(r["count"] for r in matrix_bulk(spark, work, ["grp"]).collect()) == sum(int(x.split()[2]) for x in lines)


def test_matrix_is_written_in_the_order_of_its_columns(spark):
    from limen.plans.matrices import _quantities

    at = [r.col for r in _quantities(spark, "/root/testdata/sf0.001").entries.select("col").collect()]
    assert at == sorted(at)


def files_read(df):
    """Files that the scans of a plan open, after partition pruning."""
    leaves = df._jdf.queryExecution().sparkPlan().collectLeaves()
    return sum(leaves.apply(k).selectedPartitions().totalNumberOfFiles() for k in range(leaves.size()))


def test_slices_open_only_their_files(spark, tmp_path):
    entries = sorted({(r, c): v for r, c, v in matrix(4, 6000, rows=300)[0]}.items())
    entries = [(r, c, v) for (r, c), v in entries] + [(300, c, 1) for c in range(3000)]  # a row with a third of all
    df = spark.createDataFrame(entries, "row long, col long, value long").repartition(5)
    layout = write_rows(df, f"file://{tmp_path}/rows", 250)
    by_row = {}
    for r, *_ in entries:
        by_row[r] = by_row.get(r, 0) + 1
    start, expected = 0, []
    for r in sorted(by_row):
        expected.append((r, start, by_row[r], start // 250))
        start += by_row[r]
    assert sorted(map(tuple, layout.offsets.collect())) == expected
    spans = {r.span: r for r in layout.spans().collect()}
    assert sum(s.entries for s in spans.values()) == len(entries)
    assert all(s.entries < 250 + by_row[s.last_row] for s in spans.values())
    whole = layout.entries.inputFiles()
    assert len([f for f in whole if f"span={expected[-1][3]}/" in f]) > 1  # the long row is in several files
    wanted = spark.createDataFrame([(7, 0), (200, 1), (999, 2)], "row long, new long")
    part = layout.rows(wanted)
    assert sorted((r.row, r.col, r.value, r.new) for r in part.collect()) == sorted((*e, {7: 0, 200: 1}[e[0]]) for e in entries if e[0] in (7, 200))
    near = layout.between(20, 24)
    assert sorted(map(tuple, near.collect())) == sorted(e for e in entries if 20 <= e[0] <= 24)
    held = {expected_row[3] for expected_row in expected if 20 <= expected_row[0] <= 24}
    assert files_read(near) == len([f for f in whole if any(f"span={s}/" in f for s in held)]) < len(whole)


def test_empty_layout_columns_and_numbers(spark, tmp_path):
    none = spark.createDataFrame([], "row long, col long, value long")
    layout = write_rows(none, f"file://{tmp_path}/none", 10)
    assert layout.entries.count() == layout.spans().count() == layout.between(0, 9).count() == 0
    df = spark.createDataFrame([(0, 5, 2), (1, 5, 0), (2, 6, 3)], "row long, col long, value long")
    assert take_columns(df, spark.createDataFrame([(5, 0)], "col long, new long")).collect() == [(0, 0, 2)]
    assert sorted(map(tuple, offsets(df, 2).collect())) == [(0, 0, 1, 0), (1, 1, 1, 0), (2, 2, 1, 1)]


def test_dictionary_keeps_places(spark, tmp_path):
    names = [f"name{i}" for i in range(5000)]
    (tmp_path / "one.tsv").write_text("".join(f"{n}\tpeak\n" for n in names))
    folder = tmp_path / "many"
    folder.mkdir()
    for k, (a, b) in enumerate([(0, 10), (10, 3000), (3000, 3001), (3001, 5000)]):
        (folder / f"part-{k}").write_text("".join(f"{n}\tpeak\n" for n in names[a:b]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    try:
        for path in (tmp_path / "one.tsv", folder):
            named = read_dictionary(spark, str(path), "name string, kind string")
            assert named.rdd.getNumPartitions() > 1
            assert {r.name: r["index"] for r in named.collect()} == {n: i for i, n in enumerate(names)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
