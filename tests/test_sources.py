"""JSON lines in file order, dead letters, lookups, sinks, the movie folder and provider boundaries."""

import json

import pytest
from pyspark.sql import functions as F

from tidewright.functions import providers as P
from tidewright.sources import jsonl as J
from tidewright.sources import movies as M
from tidewright.sources import sinks as K

ROW = "item_id string, text string"


def lines(path, *rows):
    path.write_text("\n".join(rows) + "\n", encoding="utf-8")
    return str(path)


def test_limits_count_physical_lines(spark, tmp_path):
    p = lines(tmp_path / "a.jsonl", '{"item_id": "1", "text": "é"}', "", "  ", '{"item_id": "2"}', '{"item_id": "3"}')
    assert [(r.item_id, r.n) for r in J.read_jsonl(spark, p, ROW, position="n").orderBy("n").collect()] == [("1", 1), ("2", 4), ("3", 5)]
    assert {r.item_id for r in J.read_jsonl(spark, p, ROW, limit=4).collect()} == {"1", "2"}
    assert J.read_jsonl(spark, p, ROW).count() == 3


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    p = lines(tmp_path / "b.jsonl", *(json.dumps({"item_id": str(k), "text": "x" * (k % 50)}) for k in range(1, 3001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = J.read_jsonl(spark, p, ROW, position="n").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 3000 and all(int(r.item_id) == r.n for r in got)


def test_malformed_lines_fail_or_become_dead_letters(spark, tmp_path):
    p = lines(tmp_path / "c.jsonl", '{"item_id": "1", "text": "a"}', "{nope", '{"item_id": "2", "text": " "}')
    with pytest.raises(Exception, match="(?i)malformed"):
        J.read_jsonl(spark, p, ROW).collect()
    good, bad = J.read_jsonl_tolerant(spark, p, ROW, required=["text"])
    assert [(r.item_id, r.line_no) for r in good.collect()] == [("1", 1)]
    assert sorted((r.line_no, r.reason) for r in bad.collect()) == [(2, "malformed"), (3, "blank text")]


def test_lookups_take_the_last_row(spark):
    rows = spark.createDataFrame([("1", "a", 1), ("1", "b", 2), ("x", "c", 3), (None, "d", 4), ("2", " e  f ", 5)], "item_id string, summary string, line_no long")
    assert {r.item_id: r.summary for r in J.item_map(rows).collect()} == {1: "b", 2: " e  f "}
    assert {r.item_id: r.summary for r in J.summary_map(rows).collect()} == {1: "b", 2: "e f"}
    assert {r.item_id: r.summary for r in J.reasoning_map(rows, key="item_id", text="summary").collect()} == {"1": "b", "x": "c", "2": " e  f "}
    ids = spark.createDataFrame([(k,) for k in (9, 4, 70000, 5)], "item_id long")
    assert {r.item_id: r.position for r in J.item_index(ids).collect()} == {4: 0, 5: 1, 9: 2, 70000: 3}


def test_splits_categories_and_predictions(spark, tmp_path):
    for c in "ab":
        for s in J.SPLITS:
            spark.range(2).write.parquet(str(tmp_path / c / f"{s}.parquet"))
    both = J.read_categories(spark, str(tmp_path), "ab")
    assert both.count() == 12 and both.select("split", "category").distinct().count() == 6
    p, q = lines(tmp_path / "p.jsonl", '{"item_id": "1", "text": "late"}'), lines(tmp_path / "q.jsonl", '{"item_id": "1", "text": "first"}', '{"item_id": "1", "text": "second"}')
    assert [r.text for r in J.read_predictions(spark, [q, p], ROW, key="item_id").collect()] == ["first"]


def test_env_lines():
    assert J.parse_env("A=1\n# B=2\nnothing\nC = 'x y' z\nD=\"open\nA=3\nE=", {"A": "0"}) == {"A": "0", "C": "x y", "D": "open", "E": ""}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "é", None), ("b", 2, None, "late"), ("a", 1, "again", None)], "k string, i int, text string, error string").withColumn("w", F.monotonically_increasing_id())
    out = str(tmp_path / "out")
    assert K.write_jsonl(rows, out) == 3 and K.append_jsonl(rows, out) == 3
    stored = spark.read.text(out).collect()
    assert len(stored) == 6 and any("é" in r.value for r in stored) and all('"error":' in r.value for r in stored)
    assert K.write_with_failures(rows, str(tmp_path / "f")) == (2, 1)
    assert K.write_two_ways(rows, F.col("text") == "é", str(tmp_path / "y"), str(tmp_path / "n")) == (1, 2)
    order = spark.createDataFrame([("b", 1)], "k string, pos int")
    assert [(r.k, r.text) for r in K.checkpoint_rows(rows, order, key="k", index="i", position="pos", written="w").collect()] == [("b", None), ("a", "é")]
    assert K.write_ordered(rows, order, str(tmp_path / "o"), key="k", position="pos") == 1
    K.write_report(rows.agg(F.count("*").alias("n")), str(tmp_path / "r"))
    assert [r.value for r in spark.read.text(str(tmp_path / "r")).collect()] == ['{"n":3}']
    svg = K.svg_histogram([(0.0, 1.0, 2), (1.0, 2.0, 4)], "a < b")
    assert svg.count("<rect") == 2 and "a &lt; b" in svg


def test_movie_examples(spark, tmp_path):
    for d in ("knowledge", "proc_data"):
        (tmp_path / d).mkdir()
    put = lambda name, value: (tmp_path / name).write_text(json.dumps(value), encoding="utf-8")
    put("knowledge/user.klg", {"7": {"prompt": f"Hello.  {M.MARKER} old", "ans": "likes"}, "8": {"prompt": "x", "ans": ""}})
    put("knowledge/item.klg", {"r3": {"ans": " a war film "}})
    put("proc_data/datamaps.json", {"user2id": {"7": "1", "8": "2"}, "itemid2title": {"1": "One (1999)", "3": "Three"}, "id2item": {"3": "r3"}})
    put("proc_data/sequential_data.json", {"1": [[1, 2, 3, 4], [5, 1, 4, 2]], "2": [[1, 2], [1, 1]]})
    put("proc_data/train_test_split.json", {"train": [7, 8], "test": []})
    got = M.movie_examples(M.read_movies(spark, str(tmp_path)), min_history=2).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.user_id, r.target_item_raw_id, r.target_item_text, r.target_rating, r.history_item_count) == ("7", "r3", "Three a war film", 4, 2)
    assert r.user_history == f"Hello. {M.MARKER} One (1999), 5 stars; item-2, 1 stars."
    assert M.movie_examples(M.read_movies(spark, str(tmp_path)), split="test", min_history=2).count() == 0
    low = M.movie_examples(M.read_movies(spark, str(tmp_path)), split="all", min_history=1, allow_low=True).collect()
    assert {x.user_id: (x.target_rating, x.user_history[:4]) for x in low} == {"7": (4, "Hell"), "8": (1, "This")}


def test_providers_turn_failures_into_rows(spark):
    def shouting():
        def call(rows):
            if any(r["t"] == "bad" for r in rows):
                raise ValueError("no")
            return [None if r["t"] is None else r["t"].upper() for r in rows]

        return call

    rows = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "a"), (4, None)], "i int, t string").coalesce(1)
    for how in (P.provide, P.provide_once):
        got = {r.i: (r.out, r.error) for r in how(rows, shouting, ["t"], "out", "string").collect()}
        assert got == {1: ("A", None), 2: (None, "ValueError: no"), 3: ("A", None), 4: (None, None)}


def test_judges_fall_back_to_rules(spark):
    dims = {d: k + 1 for k, d in enumerate(P.R.DIMENSIONS)}
    prose = "; ".join(f"{d}: {n}" for d, n in dims.items())
    rows = spark.createDataFrame([(1, json.dumps(dims)), (2, f"Well: {json.dumps(dims)} done"), (3, prose), (4, "nothing")], "i int, p string")
    fall = P.R.rule_score(F.lit(""), F.lit("some text"))
    got = {r.i: r.s for r in rows.select("i", P.judged_score(F.col("p"), fall).alias("s")).collect()}
    assert [got[k].mode for k in (1, 2, 3, 4)] == ["json", "json", "prose", "rules"] and [got[k].total for k in (1, 2, 3)] == [15] * 3
    wrapped = json.dumps({"choices": [{"message": {"content": "", "reasoning_content": "deep"}}]})
    one = spark.range(1).select(P.envelope_text(F.lit(wrapped)).alias("e"), P.gated_gain(F.lit(0.8), F.lit(0.5), least=0.6, penalty=-1.0).alias("g"), P.gated_gain(F.lit(0.2), F.lit(0.5), least=0.6, penalty=-1.0).alias("l"), P.judged_score(P.judge_payload(F.lit(""), F.lit("some text"))).alias("j")).first()
    assert (one.e, one.g, one.l, one.j.mode) == ("deep", 0.4, -1.0, "json")
