"""python -m limen --composition FILE --expression FILE --out DIR: floors, intervals and design tables."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from limen.api import estimate_composition, estimate_expression
from limen.config import Settings
from limen.operators import design as D
from limen.sources.sinks import write_csv

log = logging.getLogger("limen")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="limen", description=__doc__)
    p.add_argument("--composition", help="CSV: donor, celltype and n1, n2 or z, n_eff[, p]")
    p.add_argument("--expression", help="CSV: donor, celltype, n_eff, floor[, n1, n2]")
    p.add_argument("--out", default="limen_out", help="folder of the tables (limen_out)")
    s = Settings()
    p.add_argument("--abundance", type=float, default=s.abundance)
    p.add_argument("--target-pp", "--target", dest="target", type=float, default=s.target_pp, help="percentage points to resolve")
    p.add_argument("--min-nuclei", type=int, default=s.min_cells, help="nuclei of either library of a pair")
    p.add_argument("--min-n-eff", type=float, default=s.min_n_eff, help="least n_eff of an expression row")
    p.add_argument("--bootstrap", "--n-boot", dest="n_boot", type=int, default=s.n_boot, help="replicates of donors")
    p.add_argument("--seed", type=int, default=s.seed)
    p.add_argument("-v", "--verbose", action="store_true", help="tell what is read and written")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if not args.composition and not args.expression:
        print("give --composition, --expression or both", file=sys.stderr)
        return 2
    logging.basicConfig(level=logging.INFO if args.verbose else logging.WARNING, format="%(message)s")
    s = Settings(abundance=args.abundance, target_pp=args.target, min_cells=args.min_nuclei, min_n_eff=args.min_n_eff, n_boot=args.n_boot, seed=args.seed)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    def read(path: str):
        log.info("reading %s", path)
        return spark.read.option("header", True).option("inferSchema", True).csv(path)

    def write(df, name: str) -> None:
        log.info("writing %s/%s", args.out, name)
        write_csv(df, f"{args.out}/{name}")

    if args.composition:
        df = read(args.composition)
        if "n1" not in df.columns:
            print("composition: no n1, n2; the pair criterion is not applied", file=sys.stderr)
        c = estimate_composition(df, s)
        print(c.summary())
        kappas = D.named_kappas(spark.createDataFrame([(c.kappa,)], "kappa double"), c.by_type)
        need = D.composition_requirement(kappas, s)
        print("nuclei needed: " + ", ".join(f"{r['source']} {r['nuclei']:,}" for r in need.collect()))
        write(c.by_type, "kappa_by_celltype")
        write(D.composition_design(kappas, s), "composition_design")
        write(need, "composition_requirement")
    if args.expression:
        df = read(args.expression)
        e = estimate_expression(df, s)
        print(e.summary())
        law = spark.createDataFrame([(e.a, e.b, e.median_n_eff)], "a double, b double, median_x double")
        write(D.expression_design(law).withColumn("threshold", F.round("threshold", 4)), "expression_thresholds")
    return 0


if __name__ == "__main__":
    sys.exit(main())
