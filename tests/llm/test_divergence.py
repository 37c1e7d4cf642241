"""op11 against whole numbers in Python: every group over the whole vocabulary."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, n string, term long"


def plain(rows, min_docs=3, top=200):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        own = re.findall("[a-z\u0080-\U0010ffff]+", (text or "").translate(fold))
        groups.add((lang, source))
        counts[lang, source].update(own)
        df[lang].update(set(own))
    out = []
    for lang in {x for x, _ in groups}:
        vocabulary = [t for t, n in df[lang].items() if n >= min_docs]
        sources = sorted(s for x, s in groups if x == lang)

        def shares(count):
            n = sum(count[t] for t in vocabulary)
            return {t: 1 + 10**9 * (count[t] + 1) // (n + len(vocabulary)) for t in vocabulary}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in vocabulary)) for o in sources if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in vocabulary if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(found[:limit], 1)]
    return sorted(out)


def _rows():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abéZ") for _ in range(rng.randint(1, 3)))
    rows = [(None, None, None), ("", "en", "s0"), ("a A 1a2", None, "s1"), ("a-a", "", ""), ("a", "", "s1"), ("!!", "xx", "s1"), ("alone", "yy", "s2"), ("ünÜn ß 漢字 x" * 3, "en", None)]
    rows += [(" ".join(word() for _ in range(rng.randint(1, 40))), rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s0", "s1", "s2", "S3", "é"])) for _ in range(150)]
    rows += rows[20:40] + [("hot " * 2000, "en", "s0")] * 60 + [("same words in two", "fr", s) for s in ("b", "a") for _ in range(2)]
    return rows


def _got(spark, rows, **how):
    docs = spark.createDataFrame([(i, *r, "x", 7) for i, r in enumerate(rows)], SCHEMA).withColumn("a.b", F.lit(1))
    return sorted(map(tuple, divergence.audit(docs, **how).select("lang", "source", "part", "item", "value", "rank").collect()))


@pytest.mark.parametrize("how", [{}, {"min_docs": 1, "top": 5}, {"min_docs": 10**6}])
def test_equals_plain_counts(spark, how):
    assert _got(spark, _rows(), **how) == plain(_rows(), **how)


def test_empty_table(spark):
    assert _got(spark, []) == []


def test_corrections_in_parts_of_any_size(monkeypatch):
    rng = np.random.default_rng(0)
    size = np.array([1, 7, 2, 40, 3, 3])
    ptr = np.append(0, np.cumsum(size))
    group = np.concatenate([rng.permutation(50)[:n] for n in size])
    p, p0 = rng.integers(1, 10**9, len(group)), rng.integers(1, 1000, 50)[group]
    f = lambda a, b: int(a - b) ** 2 // int(b)
    want = Counter()
    for lo, hi in zip(ptr, ptr[1:], strict=False):
        for i in range(lo, hi):
            for j in range(lo, hi):
                if i != j:
                    want[int(group[i]), int(group[j])] += f(p[i], p[j]) - f(p[i], p0[j]) - f(p0[i], p[j]) + f(p0[i], p0[j])
    for pairs in (1 << 20, 100, 7, 1):
        monkeypatch.setattr(divergence, "PAIRS", pairs)
        got = Counter()
        for a, b, total in divergence.corrections(group, p, p0, ptr):
            for x, y, v in zip(a.tolist(), b.tolist(), total.tolist(), strict=True):
                got[x, y] += v
        assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_shares_are_exact_for_large_counts(spark):
    cases = [(0, 0, 1), (5 * 10**14, 6 * 10**14, 10**6), (8 * 10**15, 8 * 10**15, 1), (123456789, 987654321, 31), (0, 0, 0)]
    got = spark.createDataFrame(cases, "c long, n long, v long").select("c", "n", "v", divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p")).collect()
    for c, n, v, p in got:
        assert p == (1 + 10**9 * (c + 1) // (n + v) if n + v else None)
