"""Small literal cases: ties, masks, fallbacks, coercions, tags."""

import pytest
from pyspark.sql import functions as F

from tidewright.functions import rubric as R
from tidewright.functions import text as T
from tidewright.operators import core, ranking, selection
from tidewright.streaming import events as S


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(("given", "want"), [("0.8", 4), ("1.0", 1), ("2.5", 2), ("4", 4), ("9", 5), ("x", None), ("Infinity", None)])
def test_dimension_coercion(spark, given, want):
    assert one(spark, R.dimension(F.col("a")), a=given) == want


def test_tags_and_answers(spark):
    text = "<Thinking> so it goes </thinking>\n<recommendation>a jazz record </recommendation>"
    b = one(spark, T.blocks(F.col("a")), a=text)
    assert (b.think, b.answer, b.has_tags) == ("so it goes", "a jazz record", True)
    assert one(spark, T.answer_of(F.col("a")), a=text) == "a jazz record"
    assert one(spark, T.answer_of(F.col("a")), a="Final answer: rock") == "rock"
    assert one(spark, T.blocks(F.col("a")), a=" plain ").answer == "plain"


def test_truncation_leaves_room_for_its_marker(spark):
    cut = one(spark, T.compact(F.col("a"), 30), a="word " * 20)
    assert cut.endswith(" [TRUNCATED]") and len(cut) <= 27


def test_rule_score_counts_named_titles(spark):
    history = "The Long Road (1999), 5 stars; Dull Days (2001), 1 stars"
    text = "<think>The Long Road suggests drama, unlike Dull Days</think><answer>war story</answer>"
    s = one(spark, R.rule_score(F.col("h"), F.col("t")), h=history, t=text)
    assert s.preference_grounding == 3 and s.has_tags and s.total == sum(s[d] for d in R.DIMENSIONS)


def test_strict_and_total_ranks_differ_on_ties(spark):
    items = spark.createDataFrame([(0, "pad"), (1, "red ring"), (2, "red ring"), (3, "blue bolt"), (4, "red bolt")], "item_id long, text string")
    q = spark.createDataFrame([(7, "red ring", 1), (8, "none", 3)], "user_id long, text string, target long")
    strict = ranking.lexical_ranks(q, items, "user_id", "target")
    rows = {r.user_id: r for r in ranking.total_ranks(strict, q, items, "user_id", "target").collect()}
    assert (rows[7].rank_strict, rows[7].rank_total) == (1, 2)
    assert (rows[8].rank_strict, rows[8].rank_total) == (1, 2)
    masked = spark.createDataFrame([(7, 4)], "user_id long, item_id long")
    q4 = spark.createDataFrame([(7, "red bolt", 3)], "user_id long, text string, target long")
    assert ranking.lexical_ranks(q4, items, "user_id", "target", masked).first().rank_strict == 1
    assert ranking.lexical_ranks(q4, items, "user_id", "target").first().rank_strict == 2


def test_metrics_of_nothing_are_zero(spark):
    r = ranking.metrics(spark.createDataFrame([], "rank_strict long"), "rank_strict", (10,)).first()
    assert (r.n, r.hr_10, r.ndcg_10) == (0, 0.0, 0.0)


def test_fallback_keeps_one_row_of_a_failing_group(spark):
    rows = spark.createDataFrame([(1, "a", 20.0, 0.5), (2, "a", 20.0, 0.5), (3, "b", 5.0, -1.0), (4, "b", 6.0, -1.0)], "pos long, g string, rubric double, gain double")
    got = {r.pos: (r.selected, r.fallback_selected, r.selection_rank) for r in selection.top_k(rows, "g", 1, 10, 0, "pos", True).collect()}
    assert got == {1: (True, False, 1), 2: (False, False, 2), 3: (False, False, 2), 4: (True, True, 1)}
    assert not any(r.selected for r in selection.top_k(rows, "g", 0, 10, 0, "pos", True).collect())


def test_histogram_of_a_constant_holds_all(spark):
    rows = spark.createDataFrame([(2.0,)] * 5, "v double")
    assert sum(r.n for r in selection.histogram(rows, "v", 4).collect()) == 5


def test_last_wins_and_anti_joins_keep_nulls(spark):
    rows = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), (None, 3, 1)], "k string, v long, pos long")
    assert {r.k: r.v for r in core.last_wins(rows, ["k"], "pos").collect()} == {"a": 2, None: 3}
    assert [r.k for r in core.without(rows, (rows.filter("k = 'a'"), ["k"])).collect()] == [None]


def test_streaming_windows_equal_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 3, "x", 1.0 * i) for i in range(50)], "s long, user_id long, event_type string, value double").withColumn("ts", F.timestamp_seconds(F.col("s") * 600))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = S.tumbling(stream, "1 hour").writeStream.outputMode("complete").format("memory").queryName("tumbled").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("tumbled").collect())) == sorted(map(tuple, S.tumbling(rows, "1 hour").collect()))
