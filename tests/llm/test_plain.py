"""Sharding, language ID and toxicity against plain versions, row by row."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from tidewright.llm import language, sharding, toxicity
from tidewright.llm.text import ALNUM, words


def _rows():
    rng = random.Random(8)
    texts = [None, "", "same", "same", "same"] + ["".join(rng.choice("abc é") for _ in range(rng.randint(0, 60))) for _ in range(120)] + ["hot text"] * 80
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "x"), (3, "same")]
    rng.shuffle(rows)
    return rows


def _sharded(rows, shards):
    """(doc_id, size, crc, shard, slot): rows sorted by (crc, id, null first); shard s begins at the key whose bytes below it are nearest to s shares."""
    own = sorted(((zlib.crc32((t or "").encode()), i if i is not None else -math.inf, i, len((t or "").encode()) + 8) for i, t in rows), key=lambda r: r[:2])
    total, below, keys = sum(r[3] for r in own), 0, []
    for r in own:
        if not keys or keys[-1][0] != r[:2]:
            keys.append((r[:2], below))
        below += r[3]
    starts = []
    for s in range(1, shards):
        fewer = [k for k, b in keys if b * shards < s * total]
        more = [k for k, b in keys if b * shards >= s * total]
        ends = ([(abs(dict(keys)[fewer[-1]] * shards - s * total), fewer[-1])] if fewer else []) + [(abs((dict(keys)[more[0]] if more else total) * shards - s * total), more[0] if more else (math.inf, 0))]
        starts.append(min(ends, key=lambda x: x[0])[1])
    out, slot = [], {}
    for r in own:
        shard = sum(x <= r[:2] for x in starts)
        slot[shard] = slot.get(shard, -1) + 1
        out.append((r[2], r[3], r[0], shard, slot[shard]))
    return out


def test_shards_equal_those_of_a_sort(spark):
    rows = _rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for shards, probes, cell_rows in ((4, 8, 1 << 20), (7, 3, 20)):
        got = sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in sharding.shard(docs, shards=shards, probes=probes, cell_rows=cell_rows).collect()), key=repr)
        assert got == sorted(_sharded(rows, shards), key=repr)


def _counts(text):
    """Hashed trigrams of a text, by a loop: letters folded, all else one blank, blanks at both ends."""
    out = np.zeros(language.BINS)
    data = bytearray()
    previous = 0
    for b in text.encode():
        low = b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32
        if 0x80 <= low <= 0x9E and previous == 0xC3:
            low += 0x20
        previous = b
        if low != 32 or data and data[-1] != 32:
            data.append(low)
    data = b" " + bytes(data) + b" "
    mask = 0xFFFFFFFF
    for a, b, c in zip(data, data[1:], data[2:], strict=False):
        h = (a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) & mask
        h ^= h >> 15
        out[(h * 0x2C1B3C6D & mask) >> 20] += 1
    return out


def test_languages_equal_a_plain_nearest_centroid(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit(docs.filter("doc_id % 2 = 0"))
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(1000, "Ä"), (1001, "É é, ÉÉ"), (1002, "a"), (1003, "1 2 3"), (1004, " \n x  y ")]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, text in rows:
        tf = _counts(text or "")
        assert np.array_equal(language.counts(pa.array([text]))[0], tf), text
        v = np.log1p(tf) * model.idf
        cos = model.centroids @ (v / max(np.linalg.norm(v), 1e-12))
        best = int(cos.argmax())
        letters = any(c.isalpha() for c in text or "")
        assert got[i].lang_pred == (model.languages[model.owner[best]] if letters else "und")
        assert math.isclose(got[i].score, min(max(cos[best], 0), 1) if letters else 0, abs_tol=1e-5)
        if letters:
            least = model.least[model.owner[best]] * math.sqrt(min(tf.sum() / language.SHORT, 1))
            assert got[i].rejected == (cos[best] < least) or abs(cos[best] - least) < 1e-5


def test_ties_between_centroids_go_to_the_first_language(spark):
    model = language.fit(spark.createDataFrame([(1, "same words here", "b"), (2, "same words here", "a")], "doc_id long, text string, lang string"))
    assert language.identify(spark.createDataFrame([(1, "same words")], "doc_id long, text string"), model).first().lang_pred == "a"


def test_toxicity_scores_equal_plain_sums(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels)
    weight = dict(zip(model.known.tolist(), model.weight.tolist(), strict=True))
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(-1, None), (-2, ""), (-3, "idiots Idiot idiotic, muslim MUSLIM men"), (None, "women women")]
    got = sorted(((r.doc_id, r.score, r.predicted) for r in toxicity.classify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()), key=repr)

    def hashed(word):
        w = words(pa.array([word]), ALNUM, toxicity.HEADS)
        return int(w.hash[0]), [int(h[0]) for h in w.heads]

    known: dict = {}
    want = []
    for i, text in rows:
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        found = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low))
        known |= {w: hashed(w) for w in found - set(known)}
        own = {w: known[w] for w in found}
        heads = Counter(h for _, hs in own.values() for h in hs if h)
        features = {h for h, _ in own.values()} | set(heads) | {h ^ int(toxicity._TWICE) for h, n in heads.items() if n > 1}
        score = 1 / (1 + math.exp(-(model.base + sum(weight.get(f, 0.0) for f in features))))
        want.append((i, score, int(score >= 0.3)))
    for a, b in zip(got, sorted(want, key=repr), strict=True):
        assert a[0] == b[0] and math.isclose(a[1], b[1], rel_tol=1e-9) and (a[2] == b[2] or abs(b[1] - 0.3) < 1e-9)
    assert 0 < sum(x[2] for x in got) < len(rows) / 2
