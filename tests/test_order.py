"""Quantiles, ranks with ties and parts of equal size against plain sorts."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import order, selection

INPUTS = {
    "ties": [1.5] * 500 + [float(i % 7) for i in range(300)],
    "tiny": [5e-324, -5e-324, 0.0, -0.0, 1e-310, 2.0],
    "wide": [1e308, -1e308, 1e-300, -1e-300, 3.0, float("inf"), float("-inf")] * 3,
    "one": [-2.25],
    "two": [1.0, 2.0],
    "close": [1 + i * 2.0**-52 for i in range(101)],
    "none": [],
}


@pytest.mark.parametrize("name", INPUTS)
def test_quantiles_are_exact(spark, name):
    x = INPUTS[name]
    rows = spark.createDataFrame([(v,) for v in x] + [(None,), (float("nan"),)], "v double").repartition(3)
    shares = [0.0, 0.05, 0.25, 0.5, 0.9, 0.99, 1.0]
    own, want = sorted(x), []
    for s in shares:
        p = (len(x) - 1) * s
        lo, hi = (math.floor(p), math.ceil(p)) if x else (0, 0)
        want.append(None if not x else own[lo] if lo == hi else (hi - p) * own[lo] + (p - lo) * own[hi])
    got = order.quantiles(rows, F.col("v"), shares)
    assert all(a == b or (a != a and b != b) for a, b in zip(got, want, strict=True)), (got, want)
    assert order.upper_median(rows, F.col("v")) == (own[len(own) // 2] if own else None)


def test_bits_keep_the_order():
    x = np.array([-np.inf, -1e308, -1.0, -5e-324, 0.0, 5e-324, 1.0, 1e308, np.inf])
    bits = order.ordered_bits(x)
    assert (np.diff(bits.astype(object)) > 0).all() and [order.from_bits(int(b)) for b in bits] == x.tolist()
    assert order.ordered_bits(np.array([-0.0])) == order.ordered_bits(np.array([0.0]))


def test_ranks_and_parts_with_one_value_on_half_of_the_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(3)), 4.0 if rng.random() < 0.5 else float(rng.integers(100))) for i in range(3001)]
    df = spark.createDataFrame(rows, "k long, g long, v double").repartition(7)
    got = {(r.g, r.v): r.place for r in order.average_ranks(df, "g", "v", "place").collect()}
    for g in range(3):
        own = sorted(v for _, x, v in rows if x == g)
        for v in set(own):
            at = [i + 1 for i, x in enumerate(own) if x == v]
            assert got[g, v] == sum(at) / len(at)
    place = {k: i for i, (v, k) in enumerate(sorted((v, k) for k, _, v in rows))}
    assert {r.k: r.before for r in order.running(df, [F.col("v"), F.col("k")]).collect()} == place
    sizes = [751, 750, 750, 750]
    want = np.repeat(np.arange(1, 5), sizes)
    assert all(r.part == want[place[r.k]] for r in order.parts(df, "v", "k", 4, "part").collect())


def test_statistics_of_nothing(spark):
    none = spark.createDataFrame([], "v double")
    assert tuple(selection.numeric_stats(none, "v").first()) == (0, *[None] * 7)
    assert selection.summary(none, "v").first().median is None and selection.rank_stats(none, "v").first().p50 is None


def test_places_within_groups(spark):
    """Half of the rows are one group, which lies in several ranges."""
    rows = [("hot", (i * 7919) % 1009, f"x{i}") for i in range(1009)] + [(None if i % 50 == 0 else f"g{i % 97}", i * 31 % 997, f"y{i}") for i in range(997)]
    table = spark.createDataFrame(rows, "g string, k int, own string").repartition(5)
    # Without merging small ranges, as at sizes where ranges are large.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.own: r.place for r in order.places_within(table, "g", [F.col("k")], "place").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for g in {r[0] for r in rows}:
        for place, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1]), 1):
            want[r[2]] = place
    assert got == want
    assert order.places_within(table.limit(0), "g", [F.col("k")], "place").count() == 0


def test_places_within_groups_deal_rows_once(spark):
    """Groups go on over Arrow batches; only the carried counts are shuffled after the ranges are written."""
    table = spark.createDataFrame([(None if i % 3 == 0 else i % 2, (i * 37) % 101, i) for i in range(101)], "g int, k int, own int").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = order.places_within(table, "g", [F.col("k")], "place")
        got = {r.own: r.place for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for g in (None, 0, 1):
        own = sorted((i for i in range(101) if (None if i % 3 == 0 else i % 2) == g), key=lambda i: (i * 37) % 101)
        want |= {i: place for place, i in enumerate(own, 1)}
    assert got == want and found.columns == ["g", "k", "own", "place"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_part" not in plan
    assert order.places_within(table, "g", [F.col("k")], "place", drop=["k"]).columns == ["g", "own", "place"]
