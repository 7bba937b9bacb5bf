"""MatrixMarket: a triplet may read like the dimension line; dimensions are checked."""

import pytest

from limen.sources.genomic import read_matrix_market


def written(tmp_path, body):
    path = tmp_path / "m.mtx"
    path.write_text("%%MatrixMarket matrix coordinate integer general\n% made here\n" + body)
    return f"file://{path}"


def test_a_triplet_like_the_dimension_line_stays(spark, tmp_path):
    df, dims = read_matrix_market(spark, written(tmp_path, "3 3 3\n1 1 5\n2 3 0\n3 3 3\n"))
    assert dims == (3, 3, 3)
    assert sorted(tuple(r) for r in df.collect()) == [(0, 0, 5), (1, 2, 0), (2, 2, 3)]


@pytest.mark.parametrize("body", ["2 2 2\n1 1 1\n", "2 2 1\n3 1 1\n", "2 2 1\n1 0 1\n", ""])
def test_wrong_dimensions_raise(spark, tmp_path, body):
    with pytest.raises(ValueError):
        read_matrix_market(spark, written(tmp_path, body))
