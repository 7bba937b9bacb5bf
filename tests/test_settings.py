"""Settings are checked; what the command line sets reaches the estimators."""

import pytest

from limen.__main__ import parser
from limen.api import estimate_expression
from limen.config import Settings


def test_flags():
    args = parser().parse_args(["--min-nuclei", "20", "--min-n-eff", "300"])
    assert (args.min_nuclei, args.min_n_eff) == (20, 300.0)
    assert parser().parse_args([]).min_nuclei == Settings().min_cells


def test_min_n_eff(spark):
    rows = [(f"d{i % 4}", f"t{i}", 100.0 * (i + 1), 2.0 / (i + 1)) for i in range(12)]
    df = spark.createDataFrame(rows, "donor string, celltype string, n_eff double, floor double")
    n = [estimate_expression(df, Settings(n_boot=20, min_n_eff=k)) for k in (0.0, 500.0)]
    assert [r.n_obs for r in n] == [12, 8]


def test_flags_of_design_and_bootstrap():
    args = parser().parse_args(["--target-pp", "2", "--bootstrap", "50", "-v"])
    assert (args.target, args.n_boot, args.verbose, args.out) == (2.0, 50, True, "limen_out")


@pytest.mark.parametrize("name, value", [("abundance", 0), ("abundance", 1.0), ("target_pp", 0), ("z", -1), ("min_n_eff", -0.1), ("min_cells", -1), ("n_boot", 0), ("z", float("nan"))])
def test_rules(name, value):
    with pytest.raises(ValueError, match=name):
        Settings(**{name: value})
