"""The word model of op10 against a plain one, and its growth with the text."""

import math
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa

from tidewright.llm import quality, wordmodel


def _plain(texts, trusted, order=3):
    """Log-probability of each text under an interpolated modified Kneser-Ney model, by dictionaries."""
    seq = lambda t: [""] * (order - 1) + re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()) + ["\n"]
    counts = {order: Counter(tuple(s[i - order + 1 : i + 1]) for s in map(seq, trusted) if len(s) > order for i in range(order - 1, len(s)))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    taken, total = {k: Counter() for k in counts}, {k: Counter() for k in counts}
    cut = {}
    for k, c in counts.items():
        of = Counter(c.values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] + of[2] else 0.5
        cut[k] = [0.0] + [min(max(j - (j + 1) * y * of[j + 1] / of[j] if of[j] else 0.5 * j, 0.05), j) for j in (1, 2, 3)]
        for g, n in c.items():
            total[k][g[:-1]] += n
            taken[k][g[:-1]] += cut[k][min(n, 3)]

    def p(g):
        if not g:
            return 1 / (len(counts[1]) + 1)
        k, n = len(g), counts[len(g)][g]
        if not total[k][g[:-1]]:
            return p(g[1:])
        return (n - cut[k][min(n, 3)]) / total[k][g[:-1]] + taken[k][g[:-1]] / total[k][g[:-1]] * p(g[1:])

    return [(len(s) - order, sum(math.log(p(tuple(s[i - order + 1 : i + 1]))) for i in range(order - 1, len(s)))) for s in map(seq, texts)]


def _texts(n, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 6))) for _ in range(60)]
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40))) for _ in range(n)]


def test_word_model_equals_a_plain_one(spark):
    texts = [*_texts(60), "", "-- !!", "never seen words", "one", "one"]
    rows = spark.createDataFrame([(i // 2, t, "xx") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    trusted = texts[:40]
    model = wordmodel.fit(rows.filter("doc_id < 20"))
    got = sorted(((r.doc_id, r.n_symbols, r.perplexity) for r in wordmodel.score(rows, model).collect()), key=repr)
    want = sorted(((i // 2, n, math.exp(-p / (n + 1)) if n else None) for i, (n, p) in enumerate(_plain(texts, trusted))), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:2] == b[:2] and (a[2] is None) == (b[2] is None) and (a[2] is None or math.isclose(a[2], b[2], rel_tol=1e-6))


def test_gathered_counts_grow_with_the_text(spark):
    n = []
    for size in (100, 1000):
        n.append(wordmodel.fit(spark.createDataFrame([(t,) for t in _texts(size)], "text string"))[2])
    assert n[1] > 4 * n[0]


def test_classify_tells_words_from_word_like_strings(spark):
    """The letters of each word turned around are as likely to a model of few symbols as the words in many places."""
    good = _texts(400)
    odd = [" ".join(random.Random(i).sample([w[::-1] for w in t.split()], len(t.split()))) for i, t in enumerate(good[:50]) if len(t.split()) > 9]
    docs = spark.createDataFrame([(i, t, "xx") for i, t in enumerate([*good, *odd])], "doc_id long, text string, lang string")
    got = quality.classify(docs, docs.filter(f"doc_id < {len(good)}").select("doc_id")).collect()
    assert sum(r.keep for r in got if r.doc_id < len(good)) > 0.98 * len(good)
    assert not any(r.keep for r in got if r.doc_id >= len(good))


def test_padding():
    h, row, n = wordmodel.padded(pa.array(["a b", None, "a"]), 3)
    assert n.tolist() == [2, 0, 1] and row.tolist() == [0] * 5 + [2] * 4
    assert (h[[0, 1, 5, 6]] == wordmodel.EDGE).all() and (h[[4, 8]] == wordmodel.END).all() and h[2] == h[7] != h[3]
    assert [len(wordmodel.grams(h, row, 3, k)[0]) for k in (1, 2, 3)] == [7, 7, 5]
    assert np.array_equal(wordmodel.grams(h, row, 3, 1)[0], [1, 2, 3, 4, 6, 7, 8])


def test_parts_of_the_shards_give_what_one_pass_gives(spark):
    """Each pass sends the places of its shards only; equal rows, rows without an id and texts without words stay rows."""
    texts = [*_texts(60), "", "-- !!", None, "never seen words", "one", "one"]
    rows = spark.createDataFrame([*((i, t, "xx") for i, t in enumerate(texts)), (None, "one", None), (3, texts[3], "xx"), (3, texts[3], "xx")], "doc_id long, text string, lang string").repartition(3)
    model = wordmodel.fit(rows.filter("doc_id < 40"), text_bytes=3 * wordmodel.PASS)
    one, three = (sorted(wordmodel.score(rows, model, parts=k).collect(), key=repr) for k in (1, 3))
    assert len(one) == len(three) == len(texts) + 3
    for a, b in zip(one, three, strict=True):
        assert a[:3] == b[:3] and (a[3] == b[3] or math.isclose(a[3], b[3], rel_tol=1e-6))


def test_packed_triples():
    h, row, _ = wordmodel.padded(pa.array(["a b a b a b", None, "b a", "a b a b"]), 3)
    at = wordmodel.places(row, 3, 3)
    places = wordmodel.Triples.unpacked(wordmodel._triples(h, at, row[at]).packed())
    got = sorted(zip(*(places.words[x].tolist() for x in places[1:4]), places.more.tolist(), strict=True))
    assert got == sorted(zip(h[at - 1].tolist(), h[at - 2].tolist(), h[at].tolist(), row[at].tolist(), strict=True))
    parts = [t for _, t in wordmodel._by_shard(wordmodel._triples(h, at), 6)]
    whole = wordmodel.merged([*parts, *parts])
    counts = Counter(zip(h[at - 1].tolist(), h[at - 2].tolist(), h[at].tolist(), strict=True))
    assert {k: 2 * n for k, n in counts.items()} == dict(zip(zip(*(whole.words[x].tolist() for x in whole[1:4]), strict=True), whole.more.tolist(), strict=True))
    big = np.array([0, 1 << 63, 255], np.uint64)
    assert [x.tolist() for x in wordmodel.unpacked(wordmodel.packed(big, big[:0], big[2:]))] == [big.tolist(), [], [255]]


def test_the_model_on_disk_is_smaller_than_keys_and_values(spark):
    """A row for each n-gram took eight bytes of key and eight of value, which nothing makes smaller."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = wordmodel.fit(docs)
    assert sum(Path(f.removeprefix("file://")).stat().st_size for df in (model.triples, model.singles) for f in df.inputFiles()) < 10 * model.size
