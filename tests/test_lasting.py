"""What lasts across runs: the memo, the resumable stage, the shared rate; and lines that stay where they are read."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.functions import providers, text
from tidewright.operators import datasets
from tidewright.sources import jsonl
from tidewright.sources import memo as memo_module
from tidewright.sources.memo import Memo
from tidewright.streaming import resumable


def _store(spark, tmp_path, **how):
    return Memo(spark, f"file://{tmp_path}/store", "key", "value long", **how)


def _asked(spark, store, keys):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    compute = lambda rows: rows.select("key").mapInArrow(count, "key string").select("key", F.length("key").cast("long").alias("value"))
    out = store.values(spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, i long"), compute)
    return sorted((r.i, r.key, r.value) for r in out.collect()), seen.value


def test_the_second_run_asks_for_the_difference(spark, tmp_path):
    rows, asked = _asked(spark, _store(spark, tmp_path), ["a", "bb", "a", None])
    assert rows == [(0, "a", 1), (1, "bb", 2), (2, "a", 1), (3, None, None)] and asked == 2
    rows, asked = _asked(spark, _store(spark, tmp_path), ["bb", "ccc", "a", "ccc"])
    assert [r[2] for r in rows] == [2, 3, 1, 3] and asked == 1
    rows, asked = _asked(spark, _store(spark, tmp_path), ["a", "ccc"])
    assert asked == 0 and _store(spark, tmp_path).version()[0] == 2


def test_a_lost_run_leaves_nothing_half_done(spark, tmp_path):
    store = _store(spark, tmp_path)
    _asked(spark, store, ["a"])

    def broken(rows):
        return rows.select("key", F.raise_error(F.lit("lost")).cast("long").alias("value"))

    with pytest.raises(Exception, match="lost"):
        store.values(spark.createDataFrame([("b",)], "key string"), broken)
    (tmp_path / "store" / "parts" / "orphan").mkdir()
    assert store.version()[0] == 1 and [r.key for r in _store(spark, tmp_path).read().collect()] == ["a"]
    assert _asked(spark, store, ["b", "a"])[1] == 1


def test_two_runs_at_once_keep_both_parts(spark, tmp_path):
    one, other = _store(spark, tmp_path), _store(spark, tmp_path)
    rows = lambda k: spark.createDataFrame([(k, 5)], "key string, value long")
    publish = Memo._publish

    def late(self, parts_of):  # another run publishes between reading the version and taking the next one
        Memo._publish = publish
        other.add(rows("other"))
        publish(self, parts_of)

    Memo._publish = late
    try:
        one.add(rows("one"))
    finally:
        Memo._publish = publish
    assert sorted(r.key for r in one.read().collect()) == ["one", "other"] and one.version()[0] == 2


def test_many_parts_become_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(memo_module, "PARTS", 3)
    store = _store(spark, tmp_path, buckets=2)
    for i in range(5):
        store.add(spark.createDataFrame([(f"k{i}", i), ("same", 9)], "key string, value long"))
    assert len(store.version()[1]) <= 3
    assert sorted({(r.key, r.value) for r in store.read().collect()}) == sorted([(f"k{i}", i) for i in range(5)] + [("same", 9)])


def test_a_stopped_stage_goes_on(spark, tmp_path):
    source, out, runs = tmp_path / "in", str(tmp_path / "out"), []
    source.mkdir()
    put = lambda k: (source / f"{k}.json").write_text("\n".join(json.dumps({"i": 10 * k + j}) for j in range(10)))
    for k in range(4):
        put(k)

    def made(batch):
        runs.append(1)
        if len(runs) == 3:
            raise RuntimeError("half way")
        return batch.withColumn("twice", F.col("i") * 2)

    run = lambda: resumable.run_stage(spark, str(source), "i long", made, out)
    with pytest.raises(Exception, match="half way"):
        run()
    assert resumable.stage_rows(spark, out).count() == 20
    run()
    assert sorted(r.twice for r in resumable.stage_rows(spark, out).collect()) == [2 * i for i in range(40)] and len(runs) == 5
    put(4)
    run()
    run()
    assert sorted(r.i for r in resumable.stage_rows(spark, out).collect()) == list(range(50)) and len(runs) == 6


def test_a_rate_is_shared_by_slots(spark):
    clock, waits = [0.0], []
    wait = lambda s: (waits.append(s), clock.__setitem__(0, clock[0] + s))
    call = providers.paced(lambda rows: rows, 2.0, lambda: clock[0], wait)
    for _ in range(4):
        call([1])
    clock[0] += 10
    call([1])
    assert waits == [0.5, 0.5, 0.5]  # a pause earns no burst, and costs no wait
    rows = spark.range(12).withColumn("t", F.lit("x"))
    made = providers.provide(rows, lambda: lambda r: [x["t"] for x in r], ["t"], "out", "string", batch=1, rate=1000.0, slots=3)
    assert made.rdd.getNumPartitions() == 3 and made.filter("out = 'x' and error is null").count() == 12
    with pytest.raises(ValueError, match="slots"):
        providers.provide(rows, lambda: lambda r: r, ["t"], "out", "string", rate=1.0)


def test_lines_are_numbered_without_a_shuffle(spark, tmp_path):
    for f in "ab":
        (tmp_path / f"{f}.txt").write_text("\n".join(f"{f}{i}" for i in range(1, 2001)) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = jsonl.numbered_lines(spark, str(tmp_path))
        assert "Exchange hashpartitioning" not in rows._jdf.queryExecution().executedPlan().toString()
        got = rows.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 4000 and all(r.value[1:] == str(r.line_no) and r.file.endswith(f"{r.value[0]}.txt") for r in got)


def test_conversations_fall_back_to_the_rows_own_answer(spark):
    rows = [(1, "<think>t</think><answer>a</answer>", "given"), (2, "plain", "given"), (3, "", "given"), (4, None, None)]
    df = spark.createDataFrame(rows, "example_id long, cot string, source_answer string").withColumns({"cot_rank": F.lit(3), "other": F.lit("x")})
    out = datasets.conversation_rows(df, "cot", F.lit("p"), "s")
    assert out.columns == [*datasets.CONVERSATION_COLUMNS, "cot_rank", "messages"]
    got = {r.example_id: r.messages[2].content for r in out.collect()}
    form = lambda t, a: f"<think>\n{t}\n</think>\n<answer>\n{a}\n</answer>"
    assert got == {1: form("t", "a"), 2: form("plain", "plain"), 3: form("", "given"), 4: form("", text.DEFAULT_ANSWER)}


def test_vectors_come_in_batches(spark):
    def model():
        return lambda texts: np.array([[len(t), t.count("a"), 0.5] for t in texts])

    rows = spark.createDataFrame([(i, None if i == 3 else "ba" * i) for i in range(10)], "i long, t string").coalesce(2)
    got = {r.i: r.v for r in providers.embed(rows, model, "t", "v", batch=3).collect()}
    assert got == {i: [0.0, 0.0, 0.5] if i == 3 else [2.0 * i, float(i), 0.5] for i in range(10)}


def test_pairs_as_examples_carry_their_texts(spark):
    rows = spark.createDataFrame([(7, "u", None, "q1", "p1", "Books"), (9, None, 4, "q2", "p2", None), (8, "w", None, "q3", None, "Books")], "k long, user_id string, interaction_id long, query string, positive string, category string")
    got = {r.user_history: (r.example_id, r.target_item_text, r.target_rating, r.dataset) for r in datasets.pair_examples(rows, dataset="d", position="k").collect()}
    assert got == {"q1": ("Books:train:0:u", "p1", 0.0, "d"), "q2": ("CDs_and_Vinyl:train:4:", "p2", 0.0, "d"), "q3": ("Books:train:1:w", "", 0.0, "d")}


def test_rewards_by_name(spark):
    row = spark.createDataFrame([(0.9, 0.1, 0.4)], "q double, b double, n double")
    c = F.col
    made = providers.REWARDS["gated_ndcg"](c("q"), c("b"), c("n"), F.lit(1), F.lit("t")), providers.REWARDS["gated_lexical"](c("q"), F.lit(None).cast("double"), c("b"), c("n"), F.lit(""))
    assert [round(x, 6) for x in row.select(*made).first()] == [0.27, -0.05]


def test_files_of_a_stage_grow_with_the_input(spark, tmp_path, monkeypatch):
    from tidewright.plans import training

    spark.createDataFrame([(k, f"text {k}") for k in range(400)], "doc_id long, text string").repartition(12).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(training, "scratch", lambda _, name: f"{tmp_path}/{name}")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        rows = training.resumed_stage(spark, str(tmp_path)).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(rows) == len({r.doc_id for r in rows}) == 400
    assert len(list((tmp_path / "tasks").glob("*.json"))) > 4
