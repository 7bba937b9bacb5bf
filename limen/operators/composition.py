"""Composition layer: how far category shares of replicate libraries differ beyond multinomial noise."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from limen.functions.hashing import CHUNK, Joined
from limen.functions.numeric import correlation, harmonic_n, hash_number
from limen.operators.ranges import dealt, running_total

#: Of a bootstrap: donors that a task holds, draws that it makes, about, and the most tasks that a donor is sent to.
BLOCK, DRAWS, SHARES = 1 << 18, 10_000_000, 64


def by_donor():
    return Window.partitionBy("donor")


def replicate_counts(rows: DataFrame, donor: Column, celltype: Column, library: Column) -> DataFrame:
    """(donor, celltype, n1, n2): counts in libraries 0 and 1, zero where a category is absent from one."""
    keyed = rows.select(donor.alias("donor"), celltype.alias("celltype"), library.alias("lib"))
    return keyed.groupBy("donor", "celltype").agg(F.count_if(F.col("lib") == 0).alias("n1"), F.count_if(F.col("lib") == 1).alias("n2"))


def pair_criterion(pairs: DataFrame, least: int = 50) -> DataFrame:
    """Adds included_in_fit: both libraries of the donor have at least ``least`` cells over all categories."""
    both = F.least(F.sum("n1").over(by_donor()), F.sum("n2").over(by_donor()))
    return pairs.withColumn("included_in_fit", both >= least)


def library_shares(pairs: DataFrame, least: int = 0) -> DataFrame:
    """Adds t1, t2 and f1, f2 (shares of the library); donors with a library below ``least`` go."""
    out = pairs.withColumns({"t1": F.sum("n1").over(by_donor()), "t2": F.sum("n2").over(by_donor())})
    return out.where((F.col("t1") >= max(least, 1)) & (F.col("t2") >= max(least, 1))).withColumns({"f1": F.try_divide("n1", "t1"), "f2": F.try_divide("n2", "t2")})


def descriptive_pairs(pairs: DataFrame, least: int = 50) -> DataFrame:
    out = library_shares(pairs, least)
    return out.select("donor", "celltype", "f1", "f2", F.abs(F.col("f1") - F.col("f2")).alias("absdiff"), F.log2((F.col("f1") + 1e-3) / (F.col("f2") + 1e-3)).alias("log2_ratio"))


def weighted_pairs(pairs: DataFrame, least: int = 50) -> DataFrame:
    """z with the share pooled over cells and n_eff of library totals; pairs with p outside (0, 1) or z = 0 go."""
    s = library_shares(pairs, least).withColumn("p", (F.col("n1") + F.col("n2")) / (F.col("t1") + F.col("t2"))).where("p > 0 AND p < 1")
    z = F.try_divide(F.abs(F.col("f1") - F.col("f2")), F.sqrt(F.col("p") * (1 - F.col("p"))))
    return s.select("donor", "celltype", "p", harmonic_n("t1", "t2").alias("n_eff"), z.alias("z")).where("z > 0")


def packaged_pairs(pairs: DataFrame) -> DataFrame:
    """z with the mean of the two shares and n_eff of the category's own counts (1 at least); z = 0 stays."""
    s = library_shares(pairs).withColumn("p", (F.col("f1") + F.col("f2")) / 2)
    z = F.when((F.col("p") > 0) & (F.col("p") < 1), F.abs(F.col("f1") - F.col("f2")) / F.sqrt(F.col("p") * (1 - F.col("p"))))
    out = s.select("donor", "celltype", "p", harmonic_n(F.greatest("n1", F.lit(1)), F.greatest("n2", F.lit(1))).alias("n_eff"), z.alias("z"))
    return out.where("z IS NOT NULL")


def ratio() -> Column:
    """Observed over multinomial discrepancy."""
    return F.col("z") / F.sqrt(2 / F.col("n_eff"))


def rms(c: Column) -> Column:
    return F.sqrt(F.avg(c * c))


def composition_input(df: DataFrame) -> DataFrame:
    """Either form: raw counts (n1, n2) or precomputed (z, n_eff); raw counts win."""
    if {"n1", "n2"} <= set(df.columns):
        return packaged_pairs(df)
    if {"z", "n_eff"} <= set(df.columns):
        return df.withColumn("p", F.col("p") if "p" in df.columns else F.lit(None).cast("double"))
    raise ValueError(f"neither n1, n2 nor z, n_eff among {df.columns}")


def kappa(pairs: DataFrame) -> DataFrame:
    return pairs.agg(rms(ratio()).alias("kappa"), F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("donor").alias("n_donors"))


def kappa_by(pairs: DataFrame, *keys: str, least: int = 1) -> DataFrame:
    out = pairs.groupBy(*keys).agg(rms(ratio()).alias("kappa"), F.avg("p").alias("mean_fraction"), F.count(F.lit(1)).alias("n_pairs"))
    return out.where(F.col("n_pairs") >= least)


def abundance_correlation(by_type: DataFrame) -> DataFrame:
    """Pearson r of ln(mean share) and kappa; null unless there are three types with positive shares."""
    fine = (F.count(F.lit(1)) > 2) & (F.min("mean_fraction") > 0)
    return by_type.agg(F.when(fine, correlation(F.ln("mean_fraction"), F.col("kappa"))).alias("abundance_r"), F.count(F.lit(1)).alias("n_types"))


def multiplicities(donors: DataFrame, n_boot: int, seed: int = 0) -> DataFrame:
    """(rep, donor, w): how often each replicate draws a donor, by portable hash numbers.

    donors: (donor, i, n) with i from 0 and n their number. Statistics are functions of sums over donors, so a
    replicate costs a row a donor and not a row an observation."""
    spark = donors.sparkSession
    reps = spark.range(n_boot).withColumnRenamed("id", "rep")
    draws = donors.select("i", "n").crossJoin(F.broadcast(reps))  # n_boot rows: a parameter
    picks = draws.select("rep", (hash_number(F.lit(seed), F.col("rep"), F.col("i")) % F.col("n")).alias("i")).groupBy("rep", "i").agg(F.count(F.lit(1)).alias("w"))
    return picks.join(donors.select("i", "donor"), "i").select("rep", "donor", "w")


def indexed_donors(rows: DataFrame) -> DataFrame:
    """(donor, i, n). Donors are the units of a study: their number is small by design, one window orders them."""
    d = rows.select("donor").distinct()
    return d.select("donor", (F.row_number().over(Window.orderBy("donor")) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))


def resampled_sums(per: DataFrame, n_boot: int, seed: int = 0, by: str | None = None) -> DataFrame:
    """([by], rep, sums..): the sums of per's statistics (all columns but by and donor) over the donors that each
    replicate draws, as many as there are, by portable hash numbers of seed, [by,] replicate and draw.

    Donors are placed by ranges, then a task takes a block of them and some replicates, draws the places in arrays and
    adds up those in its block: no draw is a row. Blocks and replicates of a task are bounded, and a donor is sent to
    SHARES tasks at most."""
    own = [by] if by else []
    stats = [c for c in per.columns if c not in ("donor", *own)]
    placed = running_total(dealt(per, own, ["donor"], "donors"), own, ["donor"], F.lit(1), "_at")
    sizes = per.groupBy(*own).agg(F.count(F.lit(1)).alias("_n"))  # a row a cohort
    placed = placed.join(F.broadcast(sizes), placed[by].eqNullSafe(sizes[by])).drop(sizes[by]) if by else placed.crossJoin(F.broadcast(sizes))
    i, shares = F.col("_at") - 1, F.least(F.lit(SHARES), F.ceil(F.col("_n") * n_boot / DRAWS))
    t = placed.select(*own, i.alias("i"), "_n", shares.alias("_of"), F.floor(i / BLOCK).alias("_block"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in stats])
    t = t.withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_of") - 1)))

    def draw(key, table):
        n, of = table["_n"][0].as_py(), table["_of"][0].as_py()
        share, block = key[-2].as_py(), key[-1].as_py()
        own_key = [key[0].as_py()] if by else []
        prefix = "|".join(str(x) for x in (seed, *own_key) if x is not None)
        values = np.zeros((min(BLOCK, n - block * BLOCK), len(stats)))
        values[table["i"].to_numpy() - block * BLOCK] = np.column_stack([table[c].to_numpy() for c in stats])
        reps = range(share, n_boot, of)
        sums = np.zeros((len(reps), len(stats)))
        for start in range(0, n, CHUNK):
            tails = [str(x).encode() for x in range(start, min(start + CHUNK, n))]
            for size in sorted({len(x) for x in tails}):
                part = [x for x in tails if len(x) == size]
                places = np.arange(len(part))
                for k, rep in enumerate(reps):
                    at = Joined([f"{prefix}|{rep}|".encode()], part).numbers(np.zeros(len(part), np.intp), places).astype(np.int64) % n - block * BLOCK
                    sums[k] += values[at[(at >= 0) & (at < len(values))]].sum(axis=0)
        out = [pa.array(own_key * len(reps), key[0].type)] if by else []
        return pa.Table.from_arrays([*out, pa.array(list(reps), pa.int64()), *map(pa.array, sums.T)], [*own, "rep", *stats])

    schema = ", ".join([*[f"{c} {per.schema[c].dataType.simpleString()}" for c in own], "rep long", *[f"{c} double" for c in stats]])
    keys = [*own, "_share", "_block"]
    count = int(per.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = t.repartition(count, *keys).groupBy(*keys).applyInArrow(draw, schema)
    return drawn.groupBy(*own, "rep").agg(*[F.sum(c).alias(c) for c in stats])


def kappa_bootstrap(pairs: DataFrame, n_boot: int, seed: int = 0) -> DataFrame:
    """(rep, kappa) of donor-clustered resamples."""
    per = pairs.groupBy("donor").agg(F.sum(ratio() * ratio()).alias("ss"), F.count(F.lit(1)).alias("m"))
    return resampled_sums(per, n_boot, seed).select("rep", F.sqrt(F.col("ss") / F.col("m")).alias("kappa"))


def contrast_vs_floor(shares: DataFrame, kappa_value: float, z: float = 1.96) -> DataFrame:
    """shares: (grp A or B, donor, celltype, n, total). Per type the difference of donor-mean shares, its floor
    from binomial variance times kappa squared, their ratio and whether the difference exceeds the floor."""
    f = F.col("n") / F.col("total")
    of = lambda g, x: F.when(F.col("grp") == g, x)
    agg = shares.groupBy("celltype").agg(
        F.avg(of("A", f)).alias("mean_a"), F.avg(of("B", f)).alias("mean_b"), F.avg(f).alias("p"),
        F.sum(of("A", 1 / F.col("total"))).alias("ia"), F.sum(of("B", 1 / F.col("total"))).alias("ib"),
        F.count(of("A", F.lit(1))).alias("n_donor_a"), F.count(of("B", F.lit(1))).alias("n_donor_b"),
    )
    var = kappa_value**2 * F.col("p") * (1 - F.col("p")) * (F.col("ia") / F.pow("n_donor_a", F.lit(2)) + F.col("ib") / F.pow("n_donor_b", F.lit(2)))
    out = agg.withColumns({"delta": F.col("mean_a") - F.col("mean_b"), "floor_share": z * F.sqrt(var)})
    return out.select("celltype", "n_donor_a", "n_donor_b", "delta", "floor_share", (F.abs("delta") / F.col("floor_share")).alias("ratio"), (F.abs("delta") > F.col("floor_share")).alias("above"))
