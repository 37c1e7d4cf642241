"""Ranks by packed postings against all cosines, with thousands of distinct texts."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidewright.operators import postings, ranking


def _bag(text):
    return Counter(re.findall(r"[a-z0-9][a-z0-9'-]*", (text or "").lower()))


def _cosine(a, b):
    size = sum(x * x for x in a.values()) * sum(x * x for x in b.values())
    return sum(n * b[t] for t, n in a.items()) / math.sqrt(size) if size else 0.0


def _tables(texts, queries, seed=3):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 900}"
    items = [(10 * i, " ".join(word() for _ in range(rng.randint(2, 9)))) for i in range(texts)]
    items += [(10 * texts + i, items[i % 7][1]) for i in range(texts // 5)] + [(-5, ""), (-4, "!!"), (-3, None)]
    ask = [(k, " ".join(word() for _ in range(rng.choice([0, 3, 40]))) + " " + (rng.choice(items)[1] or ""), rng.choice(items)[0]) for k in range(queries)]
    ask += [(queries, None, 10), (queries + 1, "w1 w2", -99), (queries + 2, "unknown words", 20), (queries + 3, items[0][1], 0), (queries + 4, items[0][1], 10 * texts)]
    masked = [(k, rng.choice(items)[0]) for k, *_ in ask for _ in range(6)] + [(k, t) for k, _, t in ask[:5]] + [(1, 12345678)]
    return items, ask, sorted(set(masked))


def _plain(items, ask, masked):
    bags = [(i, _bag(t)) for i, t in items if t is not None]
    known = {i for i, _ in bags}
    for k, text, target in ask:
        q = _bag(text)
        s = {i: _cosine(q, b) for i, b in bags}
        if target not in known:
            yield k, target, 0.0, False, len(items) + 1, len(items) + 1
            continue
        hidden = {i for u, i in masked if u == k and i != target}
        up = sum(v > s[target] for i, v in s.items() if i not in hidden)
        tied = sum(v == s[target] and i > target for i, v in s.items() if i not in hidden)
        yield k, target, s[target], True, 1 + up, 1 + up + tied


@pytest.mark.parametrize(("texts", "queries", "entries", "ids"), [(10_000, 60, postings.SHARD, 4096), (1500, 80, 100, 20), (300, 30, 7, 1)])
def test_ranks_equal_all_cosines(spark, texts, queries, entries, ids):
    items, ask, masked = _tables(texts, queries)
    items = [(i, t) for i, t in items if t is not None]
    own = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    q = spark.createDataFrame(ask, "user long, text string, target long")
    found = postings.catalogue(own, entries=entries, ids=ids)
    assert found.n >= texts // entries // 2
    for mask in (masked, None):
        hidden = spark.createDataFrame(mask, "user long, item_id long") if mask else None
        got = sorted(map(tuple, postings.ranks(q, found, "user", "target", hidden, total=True).select("user", "target", "sim", "known", "rank_strict", "rank_total").collect()))
        want = sorted(_plain(items, ask, mask or []))
        assert [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in want]
        assert all(math.isclose(a[2], b[2], abs_tol=1e-12) for a, b in zip(got, want, strict=True))


def test_no_row_for_a_query_and_a_text(spark):
    items, ask, _ = _tables(400, 50)
    q = spark.createDataFrame(ask, "user long, text string, target long")
    ranks = ranking.lexical_ranks(q, spark.createDataFrame([(i, t) for i, t in items if t is not None], "item_id long, text string"), "user", "target")
    plan = ranks._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode(word" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert ranks.count() == len(ask)


def test_best_scores_of_texts(spark):
    items, ask, _ = _tables(500, 40)
    items = [(i, t) for i, t in items if t is not None]
    found = postings.catalogue(spark.createDataFrame(items, "item_id long, text string"), entries=64)
    got = {r.user: (r.best, r.n) for r in postings.best_scores(spark.createDataFrame(ask, "user long, text string, target long"), found, "user").collect()}
    for k, text, _ in ask:
        s = [_cosine(_bag(text), _bag(t)) for _, t in items]
        assert (k in got) == any(s)
        if any(s):
            assert math.isclose(got[k][0], max(s)) and got[k][1] == sum(x > 0 for x in s)


def test_blocks_below_the_target_are_skipped():
    rng = np.random.default_rng(0)
    lists = [np.sort(rng.choice(2000, 8)) if i % 64 else np.arange(8) for i in range(4096)]
    shard = postings.Shard.unpacked(postings.shard_of(pa.array([x.tolist() for x in sorted(lists, key=tuple)], pa.list_(pa.int64())), pa.array([[i] for i in range(4096)], pa.list_(pa.int64()))).packed())
    none = np.zeros(0, np.int64)
    asked = lambda: postings.Asked(np.zeros(8, np.int64), np.arange(8), np.ones(8, np.int64), np.array([8]), none, none, none, none)
    every, some = (postings.cosines(shard, asked(), np.array([x])) for x in (0.0, 0.99))
    assert some[3] < every[3] and (some[2] > 0.99).sum() == (every[2] > 0.99).sum() == 64


def test_empty_catalogue_and_no_queries(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    q = spark.createDataFrame([(1, "a", 5)], "user long, text string, target long")
    assert [tuple(r) for r in ranking.lexical_ranks(q, items, "user", "target").collect()] == [(1, 5, 0.0, False, 1)]
    assert ranking.lexical_ranks(q.limit(0), spark.createDataFrame([(5, "a")], "item_id long, text string"), "user", "target").count() == 0


def test_ids_are_in_no_shard_and_a_popular_target_is_many_ranges(spark):
    rng = random.Random(5)
    items = [(7 * i, f"w{i % 11} w{i % 3}") for i in range(20_000)]
    ask = [(k, f"w{rng.randrange(12)} w{rng.randrange(12)}", 7 * (5 if k % 4 else rng.randrange(20_000))) for k in range(300)]
    masked = [(k, 7 * rng.randrange(40)) for k in range(300)]
    found = postings.catalogue(spark.createDataFrame(items, "item_id long, text string"), ids=500)
    assert max(len(r.shard) for r in found.shards.collect()) < 20_000  # an id is eight bytes
    q = spark.createDataFrame(ask, "user long, text string, target long")
    queries, shards = postings._by_range(q.select(q.user.alias("key"), "target"), found)
    dealt = [r["count"] for r in queries.groupBy("salt").count().collect()]
    assert max(dealt) < 60 and queries.count() == 300
    held = [len(r.range_ids) for r in shards.collect()]
    assert sum(held) == 20_000 and max(held) < 4_000
    got = {r.user: (r.rank_strict, r.rank_total) for r in postings.ranks(q, found, "user", "target", spark.createDataFrame(masked, "user long, item_id long"), total=True).collect()}
    some = [r for r in ask if r[0] % 30 < 2]
    assert {k: got[k] for k, *_ in some} == {r[0]: r[4:] for r in _plain(items, some, masked)}


def test_long_batches_of_two_texts_are_worked_on_in_parts(monkeypatch):
    rng = random.Random(2)
    lists = [[[rng.randrange(9) for _ in range(rng.randrange(30))] for _ in range(200)] for _ in range(2)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), *(pa.array(x, pa.list_(pa.int64())) for x in lists)], ["key", "tokens", "own"])
    whole = pa.Table.from_batches(list(postings._dots(iter([batch, batch]))))
    monkeypatch.setattr(postings, "PART", 100)
    parts = list(postings._dots(iter([batch, batch])))
    assert len(parts) > 40 and pa.Table.from_batches(parts).equals(whole)
    for k in range(200):
        assert math.isclose(whole.column("sim")[k].as_py(), _cosine(Counter(lists[0][k]), Counter(lists[1][k])), abs_tol=1e-12)
