"""Ids that are strings or null, and columns named like those the operators use."""

import pytest

pytest.importorskip("limen.llm")

from limen.llm import exact_dedup, jaccard, sharding, substring, toxicity  # noqa: E402

LONG = " ".join(f"w{i}" for i in range(60))
NAMES = ["score", "_id", "key", "_gone", "_sha", "predicted", "held_out", "component_id", "spans", "id", "node", "digest", "_text"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [("a", "x y"), ("b", "x  y"), (None, None), ("c", LONG), ("d", LONG + " q")]
    return spark.createDataFrame([(i, t, *[f"{n}{i}" for n in NAMES]) for i, t in rows], ["doc_id", "text", *NAMES])


def carried(df):
    return {r.doc_id: tuple(r[n] for n in NAMES) for r in df.collect()}


def test_every_column_is_carried(spark, odd):
    labels = spark.createDataFrame([("a", 0), ("b", 0)], "doc_id string, toxic int")
    whole = carried(odd)
    for df, kept in (
        (exact_dedup.drop_exact(odd), {"a", None, "c", "d"}),
        (jaccard.keep_one(odd), {"a", None, "c"}),  # "x y" and "x  y" are one set
        (toxicity.not_toxic(odd, labels), set(whole)),
        (substring.without_repeats(odd), set(whole)),
    ):
        assert df.columns == odd.columns
        assert carried(df) == {i: whole[i] for i in kept}


def test_string_ids(spark, odd):
    assert {r.shard for r in sharding.sharded(odd, 2).collect()} <= {0, 1}
    assert toxicity.toxicity(odd, spark.createDataFrame([], "doc_id string, toxic int")).where("score = 0").count() == 5
