"""Edge cases of the operators that the shared fixture doesn't hold: null ids and items, hot groups, long words and turns."""

import random
import sys
from collections import defaultdict
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

from tidewright.llm import bpe, chat, decontaminate, jaccard, language, licenses, media, quality, queries, sharding, toxicity

WORDS = [f"w{i}" for i in range(400)]


def _near(rng, base, n):
    own = list(base)
    for _ in range(n):
        own[rng.randrange(len(own))] = rng.choice(WORDS)
    return " ".join(own)


@pytest.mark.parametrize("region", [2048, 64, 12])
def test_jaccard_of_a_hot_group_of_near_copies(spark, region):
    rng = random.Random(region)
    base = [rng.choice(WORDS) for _ in range(90)]
    texts = [_near(rng, base, rng.randint(0, 5)) for _ in range(150)] + [" ".join(rng.choice(WORDS) for _ in range(60)) for _ in range(40)]
    passage = " ".join(base[:30])
    texts += [passage + " " + " ".join(rng.choice(WORDS) for _ in range(40)) for _ in range(60)]
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), region=region).collect()}
    assert got == set(brute.components(docs))


def test_jaccard_links_through_rows_without_an_id(spark):
    rng = random.Random(1)
    base = [rng.choice(WORDS) for _ in range(100)]
    a, b = list(base), list(base)
    a[10], b[80] = "x", "y"
    a[30], b[60] = "p", "q"
    rows = [(1, " ".join(a)), (None, " ".join(base)), (3, " ".join(b)), (None, "all alone here"), (None, " ".join(base)), (5, None), (None, "")]
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    linked = jaccard.join(spark.createDataFrame([(i if d is None else d, t) for i, (d, t) in zip([2, 2, 2, 4, 2, 5, 6], rows, strict=True)], "doc_id long, text string")).filter("doc_id in (1, 2, 3)").select("component_id").distinct().collect()
    assert [r.component_id for r in linked] == [1]
    assert got == sorted([(1, 1), (None, 1), (3, 1), (None, None), (None, 1), (5, 5), (None, None)], key=repr)


def test_decontamination_with_items_without_id_and_small_blocks(spark):
    rng = random.Random(2)
    items = [(i if i % 4 else None, " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 40)))) for i in range(20)]
    docs = [(i, " ".join(rng.choice(WORDS) for _ in range(20)) + " " + items[i % 20][1] + " tail") for i in range(60)] + [(None, items[1][1])]
    want = {(r[0], r[1], r[2]): (r[3], r[4], r[5]) for r in brute.contamination(docs, [(-1 if i is None else i, t) for i, t in items])}
    other = {r[0]: r for r in brute.contamination(docs, [x for x in items if x[0] is not None])}
    for block in (200_000, 25):
        found = decontaminate.digest(decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_windows=block))
        rows = found.collect()
        assert {(r.doc_id, r.n_words, r.n_hit) for r in rows} == set(want)
        assert all((r.n_items, r.items_sha256) == tuple(other[r.doc_id][3:5]) for r in rows)


def test_license_words_that_are_scattered_give_no_label(spark):
    words = "licensed under the apache license version 2 0".split()
    scattered = " filler ".join(" ".join(words[i : i + 2]) for i in range(len(words) - 1))
    backwards = " ".join(" ".join(words[i : i + 2]) for i in range(len(words) - 2, -1, -1))
    close = "Licensed, under the new Apache License (Version 2.0)"
    rows = [(0, scattered), (1, backwards), (2, close), (3, " ".join(words)), (None, " ".join(words) + " x " * 50 + " ".join(words))]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].labels for i in (0, 1, 2, 3, None)] == ["apache", "apache", "apache,apache-2.0", "apache,apache-2.0", "apache,apache-2.0"]
    assert got[None].n_base == 2 and got[3].score == 1.0
    assert licenses.in_order([(0, 0b101), (2, 0b010)]) == 2 and licenses.in_order([(0, 0b111)]) == 3


def test_license_templates_have_a_longest_length(spark, monkeypatch):
    monkeypatch.setitem(licenses.TEMPLATES, "long", [" ".join(WORDS[:70])])
    with pytest.raises(ValueError):
        licenses.templates(spark)


@pytest.mark.parametrize("system", [["word " * 60] * 100, ["word " * 20_000], ["be kind"]])
def test_chat_output_stays_in_proportion_to_long_system_turns(spark, system):
    rng = random.Random(4)
    turns = [("system", t) for t in system] + [(("user", "assistant")[k % 2], "word " * rng.randint(1, 600)) for k in range(200)]
    df = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    out = chat.format_chats(df, budget=512, history=96).orderBy("window").collect()
    fresh = []
    for w in out:
        read = chat.read_turns(w.formatted)
        own = [(r, t) for again, r, t in read if not again]
        assert w.tokens <= 512 or len(own) == len(read) == 1
        assert w.tokens == sum(int(chat.estimated(pa.array([t]))[0]) + chat.MARKS for _, _, t in read)
        fresh += own
    assert fresh == turns
    assert sum(len(w.formatted) for w in out) <= 4 * sum(len(t) + 40 for _, t in turns)


def test_chat_counts_tokens_with_the_tokenizer(spark):
    count = bpe.counter(spark, bpe.tokenizer_text(queries.TOKENIZER))
    assert count(pa.array(["hello world", "", "日本"])).tolist() == [2, 0, len(bpe.Merges(bpe.tokenizer_text(queries.TOKENIZER)).encode(pa.array(["日本"]))[0])]
    df = spark.createDataFrame([(1, k, "assistant", "hello world " * (k + 1)) for k in range(20)], "conv_id long, turn long, role string, text string")
    for w in chat.format_chats(df, budget=60, history=10, count=count).collect():
        read = chat.read_turns(w.formatted)
        assert w.tokens == int(count(pa.array([t for *_, t in read])).sum()) + chat.MARKS * len(read)


def test_long_words_equal_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(queries.TOKENIZER)
    m = bpe.Merges(bpe.tokenizer_text(queries.TOKENIZER))
    rng = random.Random(3)
    for _ in range(200):
        letters = rng.choice(["ab", "aaaab", "abcdefghijklmnopqrstuvwxyz", "-", "éèaß", "日本語漢字", " ", "\n", "=-"])
        x = rng.choice(["", " ", "a "]) + "".join(rng.choice(letters) for _ in range(rng.choice([41, 50, 100, 3000]))) + rng.choice([" ", "", ".", "<|endoftext|>"])
        assert m.encode(pa.array([x]))[0].tolist() == t.encode(x, add_special_tokens=False).ids, repr(x[:60])


def test_other_tokenizer_files_are_refused():
    text = bpe.tokenizer_text(queries.TOKENIZER)
    with pytest.raises(ValueError):
        bpe.Merges(text.replace('"add_prefix_space":false', '"add_prefix_space":true').replace('"add_prefix_space": false', '"add_prefix_space": true'))


def test_sharding_divides_large_cells(spark):
    rows = spark.range(6000).selectExpr("id as doc_id", "if(id % 2 = 0, 'same text', concat('t', id)) as text")
    keyed = sharding.sizes(rows)
    cut, tried, n = sharding.splitters(keyed, 5, 8, 50)
    assert n.sum() == 6000 and n.max() <= 50
    by = defaultdict(list)
    for r in sharding.shard(rows, shards=5, probes=8, cell_rows=50).collect():
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and sum(map(len, by.values())) == 6000


def test_models_take_one_text_of_a_repeated_id(spark):
    rows = spark.createDataFrame([(7, "the and that with") for _ in range(50)] + [(8, "der die das und nicht")], "doc_id long, text string").withColumn("lang", F.when(F.col("doc_id") == 7, "en").otherwise("de"))
    model = language.fit(rows)
    assert model.languages == ["de", "en"] and len(model.centroids) == 2
    labels = spark.createDataFrame([(7, 1), (7, 1), (8, 0)], "doc_id long, toxic int")
    assert 0 < toxicity.fit(rows, labels).score(pa.array(["nothing known"]))[0] < 1


def test_bpe_round_trip_is_decode_of_encode(spark):
    docs = spark.createDataFrame([(1, "hello world <|endoftext|> é"), (None, None), (1, "")], "doc_id long, text string")
    text = bpe.tokenizer_text(queries.TOKENIZER)
    rows = lambda df: sorted(((r.doc_id, bytes(r.ids), r.decoded) for r in df.collect()), key=repr)
    assert rows(bpe.round_trip(docs, text)) == rows(bpe.decode(bpe.encode(docs, text), text)) and rows(bpe.round_trip(docs, text))[0][2] in ("", "hello world <|endoftext|> é")


def _operators(spark):
    """The operators that give one row for each document row."""
    taught = spark.createDataFrame([(i, f"das ist ein kleiner text {i}" if i % 2 else f"this is a small text {i}", "de" if i % 2 else "en") for i in range(20)], "doc_id long, text string, lang string")
    model = language.fit(taught)
    items = spark.createDataFrame([(1, "mit license words")], "item_id long, text string")
    return {
        "bpe": queries.bpe_round_trip,
        "language": lambda docs: language.identify(docs, model),
        "licenses": licenses.scan,
        "media": lambda docs: media.read_media(media.to_media(docs)),
        "decontaminate": lambda docs: decontaminate.digest(decontaminate.contamination(docs, items)),
        "quality": lambda docs: quality.classify(docs, taught.select("doc_id")),
    }


def test_empty_tables_and_rows_without_an_id(spark):
    rows = [(None, "mit license words", "en"), (None, "mit license words", "en"), (None, None, None), (3, "", "en"), (3, "one", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    for name, run in _operators(spark).items():
        assert sorted((r.doc_id for r in run(docs).collect()), key=str) == [3, 3, None, None, None], name
        assert run(docs.limit(0)).count() == 0, name


def test_ids_are_whole_numbers(spark):
    digits = spark.createDataFrame([("7", "mit license")], "doc_id string, text string")
    assert [(r.doc_id, r.n_base) for r in licenses.scan(digits).collect()] == [(7, 1)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        licenses.scan(digits.withColumn("doc_id", F.lit("x1"))).collect()
