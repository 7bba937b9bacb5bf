"""Weights of sparse counts: TF-IDF. Components are in latent.py, neighbours and their groups in neighbours.py."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def tf_idf(cells: DataFrame, n_obs: int, scale: float = 1e4) -> DataFrame:
    """(obs, feature, w): log1p(scale * share of the observation * ln(1 + n / document frequency))."""
    total = F.sum("value").over(Window.partitionBy("obs"))
    df = cells.groupBy("feature").agg(F.count(F.lit(1)).alias("df"))
    return cells.withColumn("tf", F.col("value") / total).join(df, "feature").select("obs", "feature", F.log1p(scale * F.col("tf") * F.ln(1 + n_obs / F.col("df"))).alias("w"))
