"""Dense ranks, gains and best items over packed shards, against whole matrices."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import dense
from tidewright.plans.catalogue import _following


def _tables(spark, n=700, queries=40, width=6):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(n, width)).round(1)  # many equal scores
    v[n // 2 :] = v[: n - n // 2]  # and equal items
    ids = rng.permutation(10 * n)[:n]
    base, reasoned = rng.normal(size=(2, queries, width)).round(1)
    target = rng.choice(ids, queries)
    target[::7] = 10**9 + np.arange(len(target[::7]))
    hidden = [(k, int(i)) for k in range(queries) for i in rng.choice(ids, 30, replace=False)] + [(k, int(target[k])) for k in range(10)] + [(1, -5)]
    items = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v, strict=True)] + [(10**8, None)], "item_id long, v array<double>").repartition(3)
    asked = spark.createDataFrame([(k, int(target[k]), base[k].tolist(), reasoned[k].tolist()) for k in range(queries)], "k long, target long, v array<double>, w array<double>")
    return ids, v, base, reasoned, target, sorted(set(hidden)), items, asked


def _rank(scores, ids, target, hidden):
    at = np.flatnonzero(ids == target)
    if not len(at):
        return 0.0, len(ids) + 1, 0.0
    s = scores[at[0]]
    rank = 1 + sum(x > s for x, i in zip(scores, ids, strict=True) if i not in hidden and i != target)
    return s, rank, 1 / math.log2(rank + 1) if rank <= 100 else 0.0


@pytest.mark.parametrize("block", [0, 40, 5000])
def test_gains_with_masks(spark, block):
    ids, v, base, reasoned, target, hidden, items, asked = _tables(spark)
    masked = spark.createDataFrame(hidden, "k long, item_id long")
    got = {r.k: r for r in dense.gains(asked, items, "k", "target", "v", "w", masked, block=block).collect()}
    assert len(got) == len(target)
    for k, r in got.items():
        own = {i for q, i in hidden if q == k}
        for name, q in (("baseline", base[k]), ("cot", reasoned[k])):
            s, rank, ndcg = _rank((v @ q).round(6), ids, target[k], own)
            assert (r[f"{name}_rank"], math.isclose(r[f"{name}_sim"], s), math.isclose(r[f"{name}_ndcg"], ndcg)) == (rank, True, True)
        assert math.isclose(r.cot_gain, r.cot_ndcg - r.baseline_ndcg) and r.known == bool((ids == target[k]).any())


def test_best_items_over_many_shards(spark):
    ids, v, base, _, _, _, items, asked = _tables(spark)
    packed = dense.vectors(items, block=25)
    assert packed.n == 28 and packed.items == 700
    got = {(r.k, r.rn): r.item_id for r in dense.top(asked, packed, "k", 9).collect()}
    for k in range(len(base)):
        s = (v @ base[k]).round(6)
        assert [got[k, n] for n in range(1, 10)] == [int(ids[i]) for i in sorted(range(len(ids)), key=lambda i: (-s[i], ids[i])) if ids[i] != k][:9]


def test_following_ids_over_blocks(spark):
    rows = [(i, i % 3 if i % 11 else 9) for i in [*range(0, 3000, 2), 5000, 9000, 9001, 20000]]
    got = dict(map(tuple, _following(spark.createDataFrame(rows, "item_id long, label long")).collect()))
    for i, c in rows:
        assert got.get(i) == min((j for j, x in rows if x == c and j > i), default=None)


def test_nothing_to_search(spark):
    none = spark.createDataFrame([], "item_id long, v array<double>")
    q = spark.createDataFrame([(1, 5, [1.0, 2.0])], "k long, target long, v array<double>")
    assert [(r["rank"], r.sim, r.known) for r in dense.ranks(q, none, "k", "target").collect()] == [(1, 0.0, False)]
    assert dense.top(q, dense.vectors(none), "k", 3).count() == 0
    assert dense.ranks(q.filter("k > 1"), q.select(F.col("k").alias("item_id"), "v"), "k", "target").count() == 0
