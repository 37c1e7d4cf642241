"""No bound on op5's features and on the documents whose identity terms are swapped."""

import numpy as np
import pyarrow as pa

from tidewright.llm import toxicity


def test_all_features_that_stand_out_are_kept():
    n = 4000
    texts = [f"plain words here {'mark' if i % 2 else 'fine'} {'qx' if i % 2 else 'zy'}{i % 1600 // 2 * 7919}w" for i in range(n)]
    sets = toxicity.feature_sets(pa.array(texts))
    model = toxicity.train(sets, np.arange(n) % 2, z=1.0)
    assert len(model.known) > 1600
    s = model.score(pa.array([texts[1], texts[2]]))
    assert s[0] > 0.5 > s[1]


def test_swaps_are_made_for_every_document():
    n, terms = 5000, 7
    row = np.repeat(np.arange(n), 2)
    term = np.tile([1, 4], n)
    gram, swaps = toxicity.swap_gram(n, terms, row, term)
    want = np.zeros((terms, terms))
    for r in range(n):
        for k in range(4):
            d = np.zeros(terms)
            d[(7 * r + 13 * k) % terms] += 1
            d[(1, 4)[k % 2]] -= 1
            want += np.outer(d, d)
    assert swaps == 4 * n and np.array_equal(gram, want)


def test_no_feature_is_lost_in_a_large_vocabulary():
    """Far more words than any fixed table has room for: all that stand out by plain counts are in the model."""
    rng = np.random.default_rng(8)
    n = 2400
    toxic = (np.arange(n) % 8 == 0).astype(np.int64)
    marks = [f"mark{i}zz" for i in range(300)]
    texts = [" ".join([f"w{x:x}" for x in rng.integers(0, 1 << 40, 500)] + [f"c{x}" for x in rng.integers(0, 3000, 60)] + (list(rng.choice(marks, 12)) if t else [])) for t in toxic]
    sets = toxicity.feature_sets(pa.array(texts))
    every, owner = np.concatenate(sets), np.repeat(np.arange(n), list(map(len, sets)))
    values, at, df = np.unique(every, return_inverse=True, return_counts=True)
    assert len(values) > 1 << 20
    hits, share = np.bincount(at, toxic[owner], minlength=len(values)), toxic.mean()
    out = (np.abs(hits - df * share) / np.sqrt(df * share * (1 - share)) >= toxicity.Z) & (np.maximum(hits, df - hits) >= 2)
    model = toxicity.train(sets, toxic, rounds=2)
    assert out.sum() > 300 and set(values[out].tolist()) <= set(model.known.tolist())
    for part in (1 << 16, 1 << 30):
        got = [np.concatenate(x) for x in zip(*toxicity.counted(sets, toxic, part), strict=True)]
        assert np.array_equal(got[0], values) and np.array_equal(got[1], hits) and np.array_equal(got[2], df)
