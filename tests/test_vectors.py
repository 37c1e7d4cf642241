"""Centroids over rows, and the recall of the inverted-file index against the exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import dense, vectors
from tidewright.plans import catalogue


def test_centroids_equal_sums(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(200, 5))
    label = [None if i % 9 == 0 else f"g{i % 3}" for i in range(200)]
    rows = [(c, x.tolist()) for c, x in zip(label, v, strict=True)] + [("g1", None), ("zero", [0.0] * 5), ("", [0.0, 2.0, 0.0, 0.0, 0.0])]
    got = {r.c: r for r in vectors.centroids(spark.createDataFrame(rows, "c string, v array<double>").repartition(4), "c", "v").collect()}
    assert set(got) == {None, "g0", "g1", "g2", "zero", ""}
    for c in (None, "g0", "g1", "g2"):
        own = v[[x == c for x in label]]
        assert got[c].n == len(own) and np.allclose(got[c].centroid, own.sum(0) / np.linalg.norm(own.sum(0)))
    assert got["zero"].centroid == [0.0] * 5 and got[""].centroid == [0.0, 1.0, 0.0, 0.0, 0.0]


@pytest.mark.parametrize("k", [10, 50])
def test_recall_at_k(spark, k):
    q, v = catalogue._vectors(spark, "/root/testdata/sf0.1")
    packed, found = dense.vectors(v), vectors.index(v, part=100)
    pairs = lambda df: {(r.qid, r.item_id) for r in df.select("qid", "item_id").collect()}
    exact, got = pairs(dense.top(q, packed, "qid", k)), pairs(vectors.near(q, found, "qid", k))
    assert len(exact & got) >= 0.9 * len(exact)
    every = pairs(vectors.near(q, found, "qid", k, probes=10**6))
    assert every == exact  # all lists together hold all rows


def test_one_list_holds_most_and_few_rows(spark):
    same = spark.range(500).select(F.col("id").alias("item_id"), F.array(F.lit(1.0), F.lit(0.0)).alias("v"))
    found = vectors.index(same, lists=4, part=50)
    assert [r.item_id for r in vectors.near(same.filter("item_id = 3").withColumnRenamed("item_id", "q"), found, "q", 5).orderBy("rn").collect()] == [0, 1, 2, 4, 5]
    assert vectors.near(same.limit(0).withColumnRenamed("item_id", "q"), found, "q", 5).count() == 0
