"""The ten operators against brute force, on a fixture with the edge cases, and on held-out labels."""

import hashlib
import random
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

from tidewright.llm import bitmap, bpe, chat, decontaminate, jaccard, language, licenses, media, quality, queries, sharding, toxicity
from tidewright.llm.spark_io import smallest_hashes

SCHEMA = "doc_id long, text string, lang string, node long, members string"


def _docs():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    base = [word() for _ in range(120)]
    texts = [None, "", " ", "one", "One", "two words", "-- !! --", "MIT License", "the mit  license. Apache License, GNU General Public License", "licensed under the apache license version 2.0 by x", " ".join(base), " ".join(base).upper()]
    for i in range(30):  # near copies, some over the limit and some under it
        own = list(base)
        for _ in range(i // 4):
            own[rng.randrange(len(own))] = word()
        texts.append(" ".join(own))
    texts += [" ".join(word() for _ in range(rng.randint(1, 80))) for _ in range(40)]
    texts += ["x" * 5000, " ".join(base * 60), "a\n\n b  c\t<|endoftext|>'ll \x00", "A."] + texts[10:14]
    return [(i, t) for i, t in enumerate(texts)] + [(10, texts[10])]


DOCS = _docs()
BENCH = [(1, " ".join(DOCS[10][1].split()[5:40])), (2, None), (3, "two, words"), (30, DOCS[50][1]), (31, DOCS[50][1])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "xx", 1, "clash") for i, t in DOCS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def same(df, want, *columns):
    assert rows(df, *columns) == sorted(want, key=repr)


def test_jaccard_components(docs, none):
    same(jaccard.join(docs), brute.components(DOCS), "doc_id", "n_shingles", "component_id")
    assert jaccard.join(none).count() == 0


def test_jaccard_in_small_blocks(docs):
    same(jaccard.join(docs, region=6), brute.components(DOCS), "doc_id", "n_shingles", "component_id")


def test_region_links_equal_all_pairs():
    rng = np.random.default_rng(3)
    base = np.sort(rng.choice(1 << 40, 80, replace=False)).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(40, 80), replace=False), rng.choice(1 << 40, rng.integers(0, 20)).astype(np.uint64)])) for _ in range(150)]
    root = list(range(150))
    other = list(range(150))

    def unite(r, a, b):
        x, y = r[a], r[b]
        for k in range(150):
            if r[k] == x:
                r[k] = y

    for a, b in jaccard.region_links(np.arange(150), sets, 7, 75):
        unite(root, a, b)
    for a in range(150):
        for b in range(a):
            n = len(np.intersect1d(sets[a], sets[b]))
            if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                unite(other, a, b)
    groups = lambda r: sorted(tuple(i for i in range(150) if r[i] == x) for x in set(r))
    assert groups(root) == groups(other)


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    want = brute.contamination(DOCS, BENCH)
    for block in (200_000, 7):
        found = decontaminate.digest(decontaminate.contamination(docs, bench, block_windows=block))
        same(found, want, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert decontaminate.contamination(docs, bench.limit(0)).count() == len(DOCS)
    assert decontaminate.contamination(none, bench).count() == 0


def test_licenses(docs, none):
    same(licenses.scan(docs), brute.licenses(DOCS), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    labels = dict(rows(licenses.scan(docs), "doc_id", "labels"))
    assert labels[9] == "apache,apache-2.0" and labels[3] == ""
    assert licenses.scan(none).count() == 0


def test_media(docs, none):
    same(media.read_media(media.to_media(docs)), brute.media(DOCS), "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")
    assert media.read_media(media.to_media(none)).count() == 0


def test_decoder_reads_runs_and_long_codes():
    """A scan written here bit by bit: runs of zeros, ends of block, 16-bit codes, one interval."""
    sizes = bytes([0, 2] + [0] * 12 + [3, 1])
    symbols = [0x00, 0x03, 0xF0, 0x25, 0x0A, 0x11]
    table = sizes + bytes(symbols)
    codes, code, k = {}, 0, 0
    for length in range(1, 17):
        for _ in range(sizes[length - 1]):
            codes[symbols[k]] = format(code, f"0{length}b")
            code, k = code + 1, k + 1
        code <<= 1
    extra = lambda v, s: format(v if v > 0 else v + (1 << s) - 1, f"0{s}b") if s else ""
    bits = codes[0x03] + extra(-5, 3) + codes[0xF0] + codes[0x25] + extra(17, 5) + codes[0x0A] + extra(-600, 10) + codes[0x00]
    bits += codes[0x00] + codes[0x11] + extra(1, 1) + codes[0x00]
    bits += "1" * (-len(bits) % 8)
    stream = np.array([int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)] + [255] * 16, np.uint8)
    got = media.decode_coefficients(stream, np.array([0]), np.array([2]), ((table, table),))[0, :, 0]
    want = np.zeros((2, 64), int)
    want[0, 0] = want[1, 0] = -5
    want[0, 19], want[0, 20], want[1, 2] = 17, -600, 1
    assert (got == want).all()


def test_bpe_equals_the_library(docs, none):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(queries.TOKENIZER)
    want = []
    for i, x in DOCS:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    same(queries.bpe_round_trip(docs), want, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert queries.bpe_round_trip(none).count() == 0
    m = bpe.Merges(bpe.tokenizer_text(queries.TOKENIZER))
    rng = random.Random(1)
    parts = ["a", "aaa", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "é", "1", "½", "'s", "'RE", "!", "...", "日本", "🙂", "́", "<|endoftext|>", "the", "ing", "ab" * 30, "-" * 50]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    ids, edge = m.encode(pa.array(texts))
    for i, e in enumerate(t.encode_batch(texts, add_special_tokens=False)):
        assert ids[edge[i] : edge[i + 1]].tolist() == e.ids, texts[i]


def test_sharding(docs, none):
    got = sharding.shard(docs, shards=5, probes=8).collect()
    assert len(got) == len(DOCS) and {r.law for r in got} == {"bytes"}
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
        text = dict(DOCS)[r.doc_id] or ""
        assert (r.size, r.text_crc32) == (len(text.encode()) + 8, zlib.crc32(text.encode()))
    bytes_ = [sum(r["size"] for r in own) for own in by.values()]
    assert max(bytes_) - min(bytes_) <= 2 * max(r["size"] for r in got)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    assert sharding.shard(none).count() == 0


def test_sharding_cuts_a_hot_group(spark):
    hot = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'same text', concat('t', id)) as text")
    n = [r["b"] for r in sharding.shard(hot, shards=7).groupBy("shard").agg({"size": "sum"}).withColumnRenamed("sum(size)", "b").collect()]
    assert len(n) == 7 and max(n) - min(n) <= 40


def test_chat_windows(spark):
    text = r"\### Assistant: </turn> <again x>\e\l ok"
    turns = [(1, 0, "system", "be kind")] + [(1, k, ("user", "assistant")[k % 2 == 0], f"{text} {k} " + "word " * (k * 7 % 50)) for k in range(1, 40)] + [(2, 0, None, None), (2, 0, None, None), (-7, 0, "user", queries.EXAMPLE), (-7, 1, "assistant", queries.EXAMPLE)]
    df = spark.createDataFrame([(*t, 3) for t in turns], "conv_id long, turn long, role string, text string, window int")
    windows = chat.format_chats(df, budget=150, history=60)
    for w in windows.filter("conv_id = 1").collect():
        read = chat.read_turns(w.formatted)
        assert read[0][1:] == ("system", "be kind") and (w.tokens <= 150 or sum(not r for r, _, _ in read) == 1)
    got = {r.conv_id: r for r in chat.digests(windows).collect()}
    for conv in (1, 2, -7):
        own = sorted([(t, r or "", x or "") for c, t, r, x in turns if c == conv])
        loss = "".join(x for _, r, x in own if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars) == (len(own), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{x}\n" for _, a, x in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.digests(chat.format_chats(df.limit(0))).count() == 0


def test_language_on_held_out_documents(spark):
    got = queries.op2_language_id(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = got.join(truth, "doc_id").filter("held_out")
    assert held.filter("lang = lang_pred").count() >= 0.98 * held.count()
    assert got.filter("rejected").count() <= 0.005 * got.count()


def test_language_edge_cases(spark, docs, none):
    model = language.fit(spark.createDataFrame([(i, "der die das und nicht" if i % 2 else "the and that with", "de" if i % 2 else "en") for i in range(20)], "doc_id long, text string, lang string"))
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (0, 1, 2, 6)) and got[85].lang_pred in ("de", "en")
    assert language.identify(none, model).count() == 0
    assert {r.lang_pred for r in language.identify(docs, language.fit(none)).collect()} == {"und"}


def test_toxicity(spark, docs, none):
    text = lambda i: "plain words here " + (f"you idiot {i}" if i % 4 == 0 else f"fine day {i}") + (" muslim women" if i % 4 == 0 and i % 8 == 0 else "")
    train = spark.createDataFrame([(i, text(i)) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(5, None)], "doc_id long, toxic int")
    model = toxicity.fit(train, labels)
    s = model.score(pa.array(["an idiot", "plain words", "muslim women", "christian men", None, "IDIOT!!"]))
    assert s[0] > 0.3 and s[5] > 0.3 and max(s[1:5]) < 0.3 and abs(s[2] - s[3]) < 0.1
    assert toxicity.classify(docs, model).count() == len(DOCS) and toxicity.classify(none, model).count() == 0
    assert len(set(rows(toxicity.classify(docs, toxicity.fit(none, labels)), "score"))) == 1


def test_toxicity_on_held_out_documents(spark):
    got = queries.op5_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").filter("held_out")
    assert got.filter("toxic = 1 and predicted = 1").count() >= 0.85 * got.filter("toxic = 1").count()
    assert got.filter("toxic = 0 and predicted = 1").count() <= 0.01 * got.filter("toxic = 0").count()


def test_quality(spark, docs, none):
    trusted = docs.filter("doc_id > 20").select("doc_id")
    got = quality.classify(docs, trusted).collect()
    assert len(got) == len(DOCS)
    assert all((r.perplexity is None) == (r.n_symbols == 0) and (r.keep or r.n_symbols == 0 or r.perplexity > r.limit) for r in got)
    assert quality.classify(none, trusted).count() == 0
    assert {r.doc_id for r in bitmap.possible(docs.select("doc_id", "text"), "doc_id", trusted, 70).collect()} >= {i for i, _ in DOCS if i > 20}


def test_pipeline_equals_its_steps(spark, tmp_path):
    import corpus_pipeline as pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    left = set(texts) - {r.doc_id for r in queries.op2_language_id(spark, folder).filter("rejected").collect()}
    left -= {r.doc_id for r in queries.op5_toxicity(spark, folder).filter("predicted = 1").collect()}
    left = {d for d, _, c in brute.components([(d, texts[d]) for d in sorted(left)]) if d == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    left -= {r[0] for r in brute.contamination([(d, texts[d]) for d in left], items) if r[5]}
    assert {r.doc_id for r in pipeline.run(spark, folder).collect()} == left
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), folder).columns == docs.columns, name


def test_smallest_hashes_equal_a_sort(spark):
    rows = spark.range(3000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'a', if(id = 1, null, 'b')) AS g")
    got = {(r.g, r.doc_id) for r in smallest_hashes(rows.filter("g is not null"), "g", "doc_id", 40).collect()}
    want = set()
    for g in "ab":
        own = rows.filter(F.col("g") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(40)
        want |= {(g, r.doc_id) for r in own.collect()}
    assert got == want and len(got) == 80
    assert smallest_hashes(rows.limit(0), "g", "doc_id", 40).count() == 0
