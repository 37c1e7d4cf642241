"""Rewards of completions from texts, against the same steps in Python."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from tidewright.functions.rubric import rule_score
from tidewright.operators import postings, rewards


def _cosine(a, b):
    a, b = (Counter(re.findall(r"[A-Za-z0-9][A-Za-z0-9'-]*", x.lower())) for x in (a, b))
    size = sum(x * x for x in a.values()) * sum(x * x for x in b.values())
    return sum(n * b[t] for t, n in a.items()) / math.sqrt(size) if size else 0.0


def _reasoned(history, text):
    return history.strip() + (f"\n\nRecommendation reasoning:\n{text.strip()}" if text.strip() else "")


ROWS = [
    # key, group, history, completion, target id, target text, given, judged, mask
    (1, 1, "jazz records and blues", "because of blues the user seeks jazz piano", 1, "blue jazz piano", None, 0.9, [2]),
    (2, 1, "jazz records and blues", "rock", 1, "blue jazz piano", None, 0.9, [2]),
    (3, 1, "jazz records and blues", "blue jazz piano", 1, "blue jazz piano", 0.1, None, [2]),
    (4, 2, "war films", "war story war", 3, "war story", None, 0.5, []),
    (5, 2, None, None, 3, "war story", None, 0.5, None),
    (6, 2, "war films", "war story", 3, "", None, 0.9, []),
    (7, 3, "war films", "war story", 99, "gone", None, 0.9, [1, 3]),
    (8, 3, "war films", "war story", None, "war story", None, 0.9, [0]),
    (9, 3, "war films", "war story", 3, None, None, 0.2, [3, 3]),
]
SCHEMA = "k long, g long, history string, completion string, tid long, target string, given double, judged double, mask array<long>"
ITEMS = [(0, "pad war story jazz piano"), (1, "blue jazz piano"), (2, "jazz blues records"), (3, "war story"), (4, "war films and war"), (5, "piano")]


def _quality(spark, rows):
    own = spark.createDataFrame(rows, SCHEMA).select("k", rule_score(F.col("history"), F.col("completion"))["score_norm"].alias("s"))
    return {r.k: r.s for r in own.collect()}


def test_lexical_rewards_from_texts(spark):
    rules = _quality(spark, ROWS)
    out = rewards.lexical_rewards(spark.createDataFrame(ROWS, SCHEMA).repartition(3), key="k", history="history", completion="completion", target="target", given="given", judged="judged", scorer="api")
    got = {r.k: r for r in rewards.advantages(out.join(spark.createDataFrame(ROWS, SCHEMA).select("k", "g"), "k"), "g").collect()}
    assert len(got) == len(ROWS)
    for k, _, h, c, _, t, given, judged, _ in ROWS:
        h, c, t = h or "", c or "", t or ""
        base, now = given if given is not None else _cosine(h, t), _cosine(_reasoned(h, c), t)
        q = judged if judged is not None else rules[k]
        want = q * (now - base) if q >= 0.45 and t and now - base > 0 else -0.05
        r = got[k]
        assert (r.source, math.isclose(r.quality, q), math.isclose(r.baseline, base, abs_tol=1e-12), math.isclose(r.similarity, now, abs_tol=1e-12), math.isclose(r.reward, want)) == ("fallback_rules" if judged is None else "api_success", True, True, True, True), k
    of = [got[k].reward for k in (1, 2, 3)]
    mean = sum(of) / 3
    assert math.isclose(got[1].advantage, (of[0] - mean) / math.sqrt(sum((x - mean) ** 2 for x in of) / 2))


def test_ranked_rewards_with_masks(spark):
    found = postings.catalogue(spark.createDataFrame(ITEMS, "item_id long, text string"))
    out = rewards.ranked_rewards(spark.createDataFrame(ROWS, SCHEMA), found, key="k", history="history", completion="completion", target_id="tid", target="target", hidden="mask", judged="judged", scorer="api")
    got = {r.k: r for r in out.collect()}
    rules, items = _quality(spark, ROWS), dict(ITEMS)

    def ndcg(query, target, mask):
        if target not in items:
            return 0.0, len(items) + 1
        rank = 1 + sum(_cosine(query, t) > _cosine(query, items[target]) for i, t in ITEMS if i != target and i not in mask)
        return 1 / math.log2(rank + 1), rank

    assert len(got) == len(ROWS)
    for k, _, h, c, tid, t, _, judged, mask in ROWS:
        h, c, mask = h or "", c or "", {0, *(mask or [])}
        (base, _), (now, rank) = ndcg(h, tid, mask), ndcg(_reasoned(h, c), tid, mask)
        q = judged if judged is not None else rules[k]
        want = q * (now - base) if q >= 0.45 and tid is not None and t and now - base > 0 else -0.05
        assert (math.isclose(got[k].baseline_ndcg, base), got[k].cot_rank, math.isclose(got[k].reward, want)) == (True, rank, True), k


def test_dense_rewards_compute_baselines_of_others(spark):
    schema = "k long, b array<double>, r array<double>, t array<double>, told string, q double, given double, by string"
    rows = [(1, [1.0, 0.0], [0.6, 0.8], [0.0, 1.0], "x", 0.5, 0.1, "e"), (2, [1.0, 0.0], [0.6, 0.8], [0.0, 1.0], "x", 0.5, 0.9, "other"), (3, [1.0, 0.0], [0.6, 0.8], [0.0, 1.0], "x", 0.5, None, "e"), (4, [1.0, 0.0], [0.6, 0.8], [0.0, 1.0], "", 0.5, 0.1, "e"), (5, [1.0, 0.0], [float("nan"), 0.8], [0.0, 1.0], "x", 0.5, 0.1, "e")]
    out = rewards.dense_rewards(spark.createDataFrame(rows, schema), key="k", base="b", reasoned="r", target="t", told="told", quality="q", given="given", given_by="by", embedder="e")
    got = {r.k: (r.baseline, round(r.reward, 9)) for r in out.collect()}
    assert got == {1: (0.1, 0.35), 2: (0.0, 0.4), 3: (0.0, 0.4), 4: (0.1, -0.05), 5: (0.1, -0.05)}
