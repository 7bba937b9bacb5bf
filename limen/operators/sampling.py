"""Sampling and sequential operators: reproducible whatever the partitioning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from limen.functions.numeric import hash_number
from limen.operators.ranges import dealt, previous, running_total


def balanced_sample(cells: DataFrame, per_type: int, seed: int = 0) -> DataFrame:
    """per_type cells of each celltype, spread over donors: a cell's rank within its donor decides first."""
    h = hash_number(F.lit(seed), "cell")
    ranked = cells.withColumn("h", h).withColumn("turn", F.row_number().over(Window.partitionBy("celltype", "donor").orderBy("h", "cell")) - 1)
    return ranked.withColumn("pick", F.row_number().over(Window.partitionBy("celltype").orderBy("turn", "h", "cell"))).where(F.col("pick") <= per_type).select("celltype", "donor", "cell", "turn", "pick")


def joint_depth_threshold(cells: DataFrame, per_type: int, a0: float, r0: float, most: float = 3.0) -> DataFrame:
    """The largest common scale t at which every type keeps per_type cells with both depths at t times the targets:
    the per_type-th largest of each cell's lesser relative depth, the least over types."""
    s = F.least(F.col("depth_a") / a0, F.col("depth_r") / r0)
    w = Window.partitionBy("celltype").orderBy(F.col("s").desc(), "cell")
    nth = cells.withColumn("s", s).withColumn("k", F.row_number().over(w)).where(F.col("k") == per_type)
    return nth.agg(F.least(F.lit(most), F.min("s")).alias("scale"), F.count(F.lit(1)).alias("types"))


def multinomial_downsample(counts: DataFrame, target: int, seed: int = 0) -> DataFrame:
    """(cell, feature, value) with each cell drawn down to target counts; smaller cells stay. One cell a group."""

    def draw(key, pdf):
        total = int(pdf["value"].sum())
        if total > target:
            rng = np.random.default_rng([seed, abs(int(key[0]))])
            pdf = pdf.sort_values("feature")
            pdf = pdf.assign(value=rng.multinomial(target, pdf["value"].to_numpy(float) / total))
        return pdf[pdf["value"] > 0][["cell", "feature", "value"]]

    rows = counts.select(F.col("cell").cast("long"), F.col("feature").cast("long"), F.col("value").cast("long"))
    return rows.groupBy("cell").applyInPandas(draw, "cell long, feature long, value long")


def caliper_match(cases: DataFrame, controls: DataFrame, caliper: float, seed: int = 0) -> DataFrame:
    """Nearest controls without replacement within strata: cases in hashed order, ties to the smaller id.

    A stratum in order of x falls into segments wherever neighbours lie farther apart than the caliper: nothing on one
    side can meet anything on the other, so segments are matched each for itself, without joining cases to controls.
    Rows without a stratum or x match nothing."""
    c = cases.select("stratum", F.col("x").cast("double").alias("x"), F.col("id").cast("long").alias("id"), F.lit(0).alias("control"))
    k = controls.select("stratum", F.col("x").cast("double").alias("x"), F.col("id").cast("long").alias("id"), F.lit(1).alias("control"))
    both = c.unionByName(k).dropna(subset=["stratum", "x"]).withColumn("h", hash_number(F.lit(seed), "id"))
    order = ["x", "control", "id"]
    seen = previous(dealt(both, ["stratum"], order, "match"), ["stratum"], order, "x", "_x")
    far = F.when(F.col("_x").isNull() | (F.col("x") - F.col("_x") > caliper), 1).otherwise(0)
    parted = running_total(seen, ["stratum"], order, far, "segment").select("stratum", "segment", *order, "h")

    def match(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["x", "id"])
        pool = pdf[pdf["control"] == 1]
        found = nearest_unused(pool["x"].to_numpy(), pool["id"].to_numpy(), [(r.x, r.id) for r in pdf[pdf["control"] == 0].sort_values(["h", "id"]).itertuples()], caliper)
        return pd.DataFrame([(pdf["stratum"].iloc[0], *m) for m in found], columns=["stratum", "case_id", "control_id", "gap"])

    return parted.groupBy("stratum", "segment").applyInPandas(match, f"stratum {cases.schema['stratum'].dataType.simpleString()}, case_id long, control_id long, gap double")


def nearest_unused(x: np.ndarray, ids: np.ndarray, cases: list[tuple], caliper: float) -> list[tuple]:
    """(case, control, gap): for each case in turn the nearest control that is left, within the caliper. Controls come
    sorted by (x, id); those of one x are a shelf, taken from the front, and empty shelves are skipped at once."""
    places, front = np.unique(x, return_index=True)
    end = np.append(front[1:], len(x))
    front, n = front.copy(), len(places)
    left, right = list(range(n + 1)), list(range(n + 1))  # of shelf i: the next one not empty, from i on (left: 1-based)

    def find(nxt: list[int], i: int) -> int:
        root = i
        while nxt[root] != root:
            root = nxt[root]
        while nxt[i] != root:
            nxt[i], i = root, nxt[i]
        return root

    out = []
    for at, case in cases:
        i = int(np.searchsorted(places, at))
        options = []
        for shelf in (find(right, i), find(left, i) - 1):
            if 0 <= shelf < n and (gap := abs(at - places[shelf])) <= caliper:
                options.append((gap, ids[front[shelf]], shelf))
        if options:
            gap, control, shelf = min(options)
            out.append((case, int(control), float(gap)))
            front[shelf] += 1
            if front[shelf] == end[shelf]:
                right[shelf], left[shelf + 1] = shelf + 1, shelf
    return out


def greedy_decorrelated(candidates: DataFrame, correlations: DataFrame, most: float = 0.7) -> DataFrame:
    """Per gene how many candidates (gene, peak, strength) are admitted in order of strength, none correlated above
    most with one admitted before. correlations: (gene, p, q, r)."""
    both = candidates.join(
        correlations.where(F.abs("r") > most).select("gene", F.col("p").alias("peak"), F.col("q").alias("other"))
        .unionByName(correlations.where(F.abs("r") > most).select("gene", F.col("q").alias("peak"), F.col("p").alias("other"))),
        ["gene", "peak"], "left",
    )
    rows = both.groupBy("gene", "peak", "strength").agg(F.collect_set("other").alias("against"))

    def admit(pdf):
        kept = set()
        for r in pdf.sort_values(["strength", "peak"], ascending=[False, True]).itertuples():
            if not kept.intersection(r.against):
                kept.add(r.peak)
        return pdf.iloc[:1][["gene"]].assign(candidates=len(pdf), admitted=len(kept))

    return rows.groupBy("gene").applyInPandas(admit, f"gene {candidates.schema['gene'].dataType.simpleString()}, candidates long, admitted long")
