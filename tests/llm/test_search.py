"""op13 against scores of all documents worked out in Python."""

import heapq
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import search


def terms(text):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall("[a-z0-9\u0080-\U0010ffff]+", (text or "").translate(fold))


def plain(docs, items, k=10):
    own = [(i, Counter(terms(t))) for i, t in docs]
    own = [(i, c, sum(c.values())) for i, c in own if c]
    n_docs, size, df = len(own), sum(n for *_, n in own), Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        asked, found = Counter(terms(text)), []
        for i, c, n in own:
            m = 25 + 75 * n * n_docs // size
            s = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, times in asked.items() if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0))
        for rank, (s, none, i) in enumerate(heapq.nsmallest(k, found), 1):
            out.append((item, rank, None if none else i, -s))
    return sorted(out, key=repr)


def _docs(n=600):
    rng = random.Random(13)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 400}"
    docs = [(rng.randrange(10**6), " ".join(word() for _ in range(rng.choice([1, 5, 40, 200])))) for _ in range(n)]
    docs += [(None, docs[0][1]), (7, None), (8, ""), (9, "!!"), (3, docs[5][1]), docs[5], docs[5], (-4, "W1 w2, É é 漢字"), (10**15, " ".join(f"w{i}" for i in range(400)) * 3)]
    return docs + [(2_000_000 + i, "copied words w17 w23 w31 again") for i in range(300)]  # many equal scores


def _items(docs):
    rng = random.Random(4)
    return [(1, "w17 w23 w31"), (2, None), (3, "unknown"), (4, docs[3][1]), (4, "w1 w1 w2 é"), (None, "w5 w390 w390"), (6, "copied"), (7, "漢字 É")] + [(20 + i, " ".join(rng.choice(docs)[1].split()[:30])) for i in range(20) if docs]


def _got(spark, docs, items, **how):
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, q int, score string").withColumn("a.b", F.lit(1)).repartition(5)
    queries = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, rank int")
    return sorted(map(tuple, search.search(frame, queries, **how).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.mark.parametrize("how", [{}, {"shard_bytes": 2000, "leaf": 2, "k": 3}, {"block_terms": 40, "leaf": 1}, {"k": 2000}])
def test_equals_all_scores(spark, how):
    docs = _docs()
    assert _got(spark, docs, _items(docs[:600]), **how) == plain(docs, _items(docs[:600]), how.get("k", 10))


def test_empty_tables(spark):
    assert _got(spark, [], [(1, "w1")]) == [] == _got(spark, _docs(20), []) == _got(spark, [(1, None), (2, "")], [(1, "w1")])


def test_bounds_leave_nodes_unseen():
    """Far fewer nodes than the tree has are opened where one document stands out."""
    rng = np.random.default_rng(1)
    docs, words = 4096, 50
    row, term = np.divmod(np.flatnonzero(rng.random(docs * words) < 0.3), words)
    impact = rng.integers(1, 1000, len(row))
    impact[row == 1234] = 10**6
    order = rng.permutation(len(row))
    shard = search.Shard(row[order], term[order], impact[order], docs, words, 4)
    scores = np.zeros(docs, np.int64)
    at, weight = np.arange(0, words, 2), rng.integers(1, 9, words // 2)
    for t, w in zip(at, weight, strict=True):
        np.add.at(scores, row[term == t], w * impact[term == t])
    for k in (1, 10):
        top = []
        opened = search.best_first(shard, np.arange(docs), at, weight, top, k)
        assert sorted(top, reverse=True) == sorted(((int(s), -i) for i, s in enumerate(scores)), reverse=True)[:k]
        assert k > 1 or opened <= 11  # the way from the root to one leaf


def test_impacts_do_not_overflow():
    n, tf = np.array([10**7, 3]), np.array([5 * 10**6, 1])
    got = search.impacts(n, tf, 10**11, 10**13)
    assert got.tolist() == [10**9 * int(t) // (1000 * int(t) + 8 * (25 + 75 * int(x) * 10**11 // 10**13)) for x, t in zip(n, tf, strict=True)]
