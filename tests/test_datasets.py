"""Literal cases of items, histories, answers, judging, selection, ranks, sinks and stages."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.functions import answers, convert, items, prompts, providers, rewards
from tidewright.functions import text as T
from tidewright.operators import core, datasets, ranking, selection, stages
from tidewright.sources import sinks


def one(spark, column, schema="a string", **values):
    df = spark.createDataFrame([tuple(values.values())], schema) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


ITEM = "title string, main_category string, store string, categories array<string>, features array<string>, description array<string>, details string, average_rating double, rating_number long"


def _item(spark, **values):
    names = [x.split()[0] for x in ITEM.split(", ")]
    return spark.createDataFrame([tuple(values.get(n) for n in names)], ITEM).select(F.struct(*names).alias("item"))


def test_item_texts_of_gaps(spark):
    bare = _item(spark, title=" \xa0", details="[1]", average_rating=0.0)
    assert bare.select(items.item_text(F.col("item"), F.lit("given"), 0)).first()[0] == "given"
    assert bare.select(items.item_text(F.when(F.lit(False), F.col("item")), F.lit(" a  b "), 0)).first()[0] == "a b"
    assert bare.select(items.details_text(F.col("item"))).first()[0] == bare.select(items.stats_text(F.col("item"))).first()[0] == bare.select(items.metadata(F.col("item"), 0)).first()[0] == ""
    full = _item(spark, title="T", store="x FORMAT: y", details=json.dumps({"Label": "", "Manufacturer": "M", "Format": "LP", "Artist": "A"}), average_rating=0.0, rating_number=3)
    assert full.select(items.details_text(F.col("item"))).first()[0] == "Artist=A; Label=M"
    assert full.select(items.stats_text(F.col("item"))).first()[0] == "avg_rating=0.0, rating_count=3"


def test_histories_of_uneven_lists(spark):
    df = spark.createDataFrame([(["a", "b", "", "d"], [1.0, None, None])], "t array<string>, r array<double>")
    plain = df.select(items.history_text(F.lit("Books_And_Art"), F.col("t"), F.col("r"), 0)).first()[0]
    assert plain == "This user's Amazon Books and Art interaction history over time is listed below. a (1 stars); b."
    numbered = df.select(items.history_text(F.lit("B"), F.col("t"), F.col("r"), 3, F.array(F.lit(""), F.lit("m")))).first()[0].split("\n")
    assert numbered[1:] == ["1. b (1 stars)", "2. [missing title]; m", "3. d"]
    empty = spark.createDataFrame([([], [])], "t array<string>, r array<double>").select(items.history_text(F.lit("B"), F.col("t"), F.col("r"), 5)).first()[0]
    assert empty.endswith("listed below. .")


@pytest.mark.parametrize(("x", "want"), [(5.0, "5"), (4.5, "4.5"), (1 / 3, "0.333333"), (1e6, "1e+06"), (123456.7, "123457"), (0.0, "0"), (-2.25, "-2.25"), (0.00012, "0.00012"), (0.00001, "1e-05")])
def test_numbers_have_six_digits(spark, x, want):
    assert want == f"{x:g}" and one(spark, T.number(F.col("a")), "a double", a=x) == want


def test_numbers_round_halves_by_their_exact_value(spark):
    some = [1016385.0, 1016375.0, -1016385.0, 100000.5, 100001.5, 1.000005, 1.000015, 0.0001234565, 999999.5, 3.0000005e-4, 1234565e9, 4.5, 1234565e-18]
    rows = spark.createDataFrame([(x,) for x in [*some, None]], "x double").select("x", T.number(F.col("x")).alias("t")).collect()
    assert [(r.x, r.t) for r in rows] == [(x, f"{x:g}") for x in some] + [(None, None)]


def test_ratings_that_do_not_fit_raise(spark):
    df = spark.createDataFrame([("x (4 stars) y (2.5 Star)",)], "a string")
    assert df.select(items.ratings_in(F.col("a"))).first()[0] == [4.0, 2.5]
    assert df.select(items.checked_ratings(F.lit(None).cast("array<double>"), F.lit("none"), F.lit(2))).first()[0] == [None, None]
    with pytest.raises(Exception, match="ratings don't fit"):
        df.select(items.checked_ratings(F.lit(None).cast("array<double>"), F.col("a"), F.lit(3))).collect()
    with pytest.raises(Exception, match="don't fit titles"):
        datasets.eligible(spark.createDataFrame([(["a"], [1.0, 2.0], 5.0)], "t array<string>, r array<double>, x double"), "t", "r", "x", least_history=1, least_rating=1).collect()


@pytest.mark.parametrize(
    ("raw", "answer", "recommendation"),
    [
        ("<reasoning>r</reasoning>Answer: x", "x", "x"), ("<answer>a</answer> <answer>b", "b", "b"), ("<think>a</think><answer>b</answer>c", "b", "bc"),
        ("<hidden_reasoning>q</ hidden_reasoning>\nfinal: y ```z```", "y", "y"), ("<answer>Final: kept</answer>", "Final: kept", "kept"), ("", "", ""), (None, "", ""),
    ],
)
def test_answers(spark, raw, answer, recommendation):
    assert one(spark, T.answer_of(F.col("a")), a=raw) == answer
    assert one(spark, answers.recommendation_of(F.col("a")), a=raw) == recommendation


def test_generated_falls_back(spark):
    assert one(spark, answers.generated(F.col("a")), a="<think>t</think>").asDict() == {"think": "t", "answer": "t", "cot": "t"}
    assert one(spark, answers.generated(F.col("a")), a="<answer>x</answer>").cot == "<answer>\nx\n</answer>"


def test_summaries_that_think_aloud_are_empty(spark):
    for raw, want in (('"A jazz  record"', "A jazz record"), ("Let's see", ""), ("x provided fields", ""), ("one two three four", "one two three"), ("", "")):
        assert one(spark, answers.summary_of(F.col("a"), 3), a=raw) == want


def test_envelopes_prefer_json_in_either_field(spark):
    dims = ["preference_grounding", "taste_specificity", "transitional_reasoning", "discriminative_framing", "conciseness"]
    prose = "; ".join(f"{d}: 2" for d in dims)
    wrap = lambda a, b: json.dumps({"choices": [{"message": {"content": a, "reasoning_content": b}}]})
    both = one(spark, providers.envelope_score(F.col("a")), a=wrap(prose, json.dumps({**dict.fromkeys(dims, 4), "comment": "c" * 600})))
    assert (both.total, both.mode, len(both.comment)) == (20, "json", 500)
    assert one(spark, providers.envelope_score(F.col("a")), a=wrap("nothing", prose)).total == 10
    assert one(spark, providers.envelope_score(F.col("a")), a="not json") is None
    assert one(spark, providers.envelope_score(F.col("a")), a=wrap(json.dumps(dict.fromkeys(dims[:4], 4)), "")) is None


def test_odd_gains_are_never_selected(spark):
    rows = spark.createDataFrame([(1, 1, 20.0, float("nan")), (1, 2, 20.0, 0.5), (2, 3, 20.0, None), (2, 4, 5.0, float("inf"))], "g long, i long, rubric double, gain double")
    got = {r.i: (r.selected, r.fallback_selected) for r in selection.top_k(rows, "g", 2, 15, 0.1, "i", True).collect()}
    assert got == {1: (False, False), 2: (True, False), 3: (True, True), 4: (False, False)}
    assert [r.i for r in selection.top_share(rows, 1.0, 0, 0, "i").collect()] == [2]
    assert [r.i for r in selection.final_gain(rows, "gain", 0).collect()] == [2]
    assert selection.top_k(rows, "g", 0, 15, 0.1, "i", True).filter("selected").count() == 0


def test_rewards_at_the_gate(spark):
    at = lambda q, g, known=True: one(spark, rewards.gated(F.col("q"), F.col("g"), F.lit(known)), "q double, g double", q=q, g=g)
    assert at(0.45, 0.5) == 0.225 and at(0.449, 0.5) == at(0.5, 0.0) == at(0.5, 0.5, False) == at(None, 0.5) == -0.05
    assert at(0.5, float("nan")) == -0.05 and at(0.5, float("inf")) == float("inf")
    assert one(spark, providers.gated_gain(F.col("q"), F.col("g"), least=0.45, penalty=-0.05), "q double, g double", q=0.5, g=float("nan")) == -0.05
    with pytest.raises(NotImplementedError):
        rewards.quality("clf", F.lit(""), F.lit(""))
    with pytest.raises(ValueError, match="unknown scorer"):
        rewards.quality("x", F.lit(""), F.lit(""))
    assert one(spark, rewards.quality("rules", F.lit(""), F.lit("x"))["source"]) == "rules"


def test_missing_targets_rank_after_all_items(spark):
    catalogue = spark.createDataFrame([(1, "a b"), (2, "a"), (3, "c")], "item_id long, text string")
    q = spark.createDataFrame([(1, "a", 2), (2, "a", 9), (3, "", 3)], "user long, text string, target long")
    got = {r.user: r for r in ranking.lexical_ranks(q, catalogue, "user", "target", total=True).collect()}
    assert (got[1].rank_strict, got[2].rank_strict, got[2].sim, got[2].known, got[3].rank_strict) == (1, 4, 0.0, False, 1)
    assert got[3].rank_total == 1


@pytest.mark.parametrize("block", [2, 100])
def test_dense_search_equals_sorting(spark, block):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 4)).round(2)
    labels = rng.integers(0, 3, 60)
    df = spark.createDataFrame([(i, x.tolist(), int(c)) for i, (x, c) in enumerate(zip(v, labels, strict=True))], "item_id long, v array<double>, label long").repartition(3)
    q = df.filter("item_id < 5").select(F.col("item_id").alias("k"), "v", F.col("label").alias("own"), (F.col("item_id") + 50).alias("target"))
    s = (v[:5] @ v.T).round(6)
    got = {(r.k, r.rn): r.item_id for r in ranking.dense_top(q, df, "k", 7, block=block).collect()}
    for k in range(5):
        assert [got[k, n] for n in range(1, 8)] == sorted((i for i in range(60) if i != k), key=lambda i: (-s[k, i], i))[:7]
    for r in ranking.dense_ranks(q, df, "k", "target", block=block).collect():
        assert r["rank"] == 1 + (s[r.k] > s[r.k, r.target]).sum()
    for r in ranking.contrastive_loss(q, df, "k", "own", "label", 0.5, block=block).collect():
        others = [i for i in range(60) if i != r.k]
        best = max(s[r.k, i] for i in others if labels[i] == labels[r.k])
        assert math.isclose(r.loss, math.log(sum(math.exp((s[r.k, i] - best) / 0.5) for i in others)), rel_tol=1e-9)
    assert ranking.dense_top(q.limit(0), df, "k", 3).count() == 0


def test_places_and_thirds_equal_sorting(spark):
    rows = spark.range(0, 30_000, 7).selectExpr("id * id as item_id", "id % 3 as c").repartition(5)
    keys = sorted(r.item_id for r in rows.collect())
    got = {r.item_id: r.place for r in ranking.numbered(rows, "item_id", "place").collect()}
    assert [got[k] for k in keys] == list(range(len(keys)))
    own = sorted((r.c, r.item_id, r.cohort) for r in ranking.thirds(rows, "c", "item_id").collect())
    sizes = [len(keys) // 3 + (i < len(keys) % 3) for i in range(3)]
    assert [x[2] for x in own] == [i + 1 for i, n in enumerate(sizes) for _ in range(n)]


def test_exclusion_by_history_only_without_keys(spark):
    schema = "example_id string, user_id long, interaction_id long, user_history string"
    rows = spark.createDataFrame([("a", 1, 1, "h one"), (None, 2, 2, "h  two"), ("", 3, None, "h two")], schema)
    told = spark.createDataFrame([("", None, 5, "x <Historical Interactions> h two </Historical Interactions>")], schema)
    assert [r.user_id for r in datasets.excluded(rows, told).collect()] == [1]
    keyed = spark.createDataFrame([("a", None, None, "h two"), ("zz", 3, None, "")], schema)
    assert sorted(r.user_id for r in datasets.excluded(rows, keyed).collect()) == [2, 3]


def test_conversions(spark):
    assert one(spark, convert.int_set_in_text(F.col("a")), a='["3", 1, "x", 3]') == [1, 3]
    assert one(spark, convert.int_set_in_text(F.col("a")), a="[4 and -2") == [-2, 4]
    assert one(spark, convert.int_set_of_one(F.col("a")), a="x") == []
    with pytest.raises(Exception, match="different lengths"):
        spark.range(1).select(convert.dot(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))).collect()
    assert convert.numbers_in("0.5,, 1", float) == [0.5, 1.0]
    assert one(spark, T.last_words(F.col("a"), 2), a="a b  c") == "b c"
    assert one(spark, T.file_safe(F.col("a"), "/r"), a="/r/a/b c:d") == "a__b_c_d"


def test_prompts_have_the_target_only_where_it_is_shown(spark):
    shown = one(spark, prompts.judge_messages(F.lit("h"), F.lit("r"), prompts.target_block(F.lit("t"), F.lit("x"))))
    hidden = one(spark, prompts.judge_messages(F.lit("h"), F.lit("r"), prompts.target_block(F.lit("t"), F.lit("x"), False)))
    assert "Target title: t\nTarget item text: x" in shown[1].content and "Held-out positive" not in hidden[1].content
    assert one(spark, prompts.maker_messages(F.lit(" h "), F.lit("Video_Games")))[1].content.count("video game") == 2


def test_failures_and_halves_come_from_one_run(spark, tmp_path):
    runs = spark.sparkContext.accumulator(0)

    def maker():
        def call(rows):
            runs.add(len(rows))
            return ["x" for _ in rows]

        return call

    df = providers.provide(spark.range(10).withColumn("t", F.lit("a")), maker, ["t"], "out", "string")
    assert sinks.write_two_ways(df, F.col("id") < 4, str(tmp_path / "a"), str(tmp_path / "b")) == (4, 6) and runs.value == 10
    assert sinks.write_with_failures(df.withColumn("error", F.when(F.col("id") == 1, "bad")), str(tmp_path / "c")) == (9, 1) and runs.value == 20
    assert not (tmp_path / "a.all").exists() and not (tmp_path / "c.all").exists()
    with pytest.raises(ValueError, match="3 rows"):
        sinks.reconciled([spark.range(2), spark.range(1)], 4)


def test_stages_run_where_their_output_is_missing(spark, tmp_path):
    there = tmp_path / "there"
    assert stages.stage_enabled(spark, "AUTO", str(there)) and stages.stage_enabled(spark, "auto") and stages.stage_enabled(spark, "Yes", str(there))
    there.write_text("x")
    assert not stages.stage_enabled(spark, "auto", str(there)) and not stages.stage_enabled(spark, "0") and stages.required(spark, str(there))
    with pytest.raises(FileNotFoundError):
        stages.required(spark, str(tmp_path / "no"))
    with pytest.raises(ValueError, match="no rows"):
        stages.not_empty(spark.range(0), "x")
    assert stages.completions_url("http://a/v1/") == stages.completions_url("http://a/v1/chat/completions") == "http://a/v1/chat/completions"


def test_shards_of_blank_keys(spark):
    assert one(spark, core.in_shard(F.col("a"), 1, 0), a="") and not one(spark, core.in_shard(F.col("a"), 4, 0), a="")


def test_lists_that_do_not_fit_raise_whatever_is_read(spark):
    rows = spark.createDataFrame([(1, ["a", "b"], [1.0, 2.0], 5.0), (2, ["a"], [], 1.0), (3, ["a", "b"], [1.0], 5.0)], "k long, t array<string>, r array<double>, own double")
    kept = lambda df: datasets.eligible(df, "t", "r", "own", least_history=1, least_rating=4)
    assert [r.k for r in kept(rows.filter("k < 3")).collect()] == [1]
    for read in (lambda df: df.select("k").collect(), lambda df: df.count()):
        with pytest.raises(Exception, match="ratings don't fit titles"):
            read(kept(rows))


def test_texts_beside_rows_are_never_broadcast(spark):
    rows = spark.createDataFrame([(1, [3, 2, 9]), (2, [])], "k long, ids array<long>")
    made = spark.range(5).select(F.col("id").alias("item_id"), F.repeat(F.col("id").cast("string"), 3).alias("text"))
    found = datasets.beside(rows, "k", "ids", made, ["text"])
    assert [(r.k, r.text) for r in found.collect()] == [(1, ["333", "222", None])]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
