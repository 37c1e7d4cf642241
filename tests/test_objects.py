"""Files that are one JSON object: read by blocks of any size, written by tasks."""

import json
import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from tidewright.operators.core import last_wins
from tidewright.sources import jsonl
from tidewright.sources import objects as O


@contextmanager
def _blocks(spark, size):
    name, cost = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    old = spark.conf.get(name), spark.conf.get(cost)
    spark.conf.set(name, size)
    spark.conf.set(cost, 1)
    try:
        yield
    finally:
        spark.conf.set(name, old[0])
        spark.conf.set(cost, old[1])


def _awkward(n, seed=3):
    """Keys and values with every sign of the syntax, escapes, long texts and empty ones."""
    rng = random.Random(seed)
    parts = ['"', "\\", "\\\\", ",", "{", "}", "[", "]", ":", "é", "\n", " ", "word", "\\\"", '",', "😀"]
    text = lambda: "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 3, 20, 400])))
    return {f"{i}{text()[:9]}": [text() for _ in range(rng.randint(0, 4))] for i in range(n)}


@pytest.mark.parametrize("size", [97, 1_000, 1 << 27])
@pytest.mark.parametrize("indent", [None, 2])
def test_members_at_any_block_size(spark, tmp_path, size, indent):
    want = _awkward(30)
    path = tmp_path / "whole.json"
    path.write_text(json.dumps(want, ensure_ascii=indent is None, indent=indent), encoding="utf-8")
    with _blocks(spark, size):
        found = O.json_members(spark, str(path), "array<string>")
        got = {r.key: r.value for r in found.collect()}
        if size == 1_000:
            assert found.rdd.getNumPartitions() >= 8
    assert got == want


@pytest.mark.parametrize("size", [61, 1 << 27])
def test_nested_members(spark, tmp_path, size):
    want = {"a": _awkward(20, 1), "n": 5, 'odd "key", {': _awkward(9, 2), "none": {}, "listed": [1, [2]], "b": _awkward(5, 4)}
    path = tmp_path / "nested.json"
    path.write_text(json.dumps(want), encoding="utf-8")
    names = ["a", 'odd "key", {', "none", "b"]
    with _blocks(spark, size):
        got = O.json_members(spark, str(path), "array<string>", nested=True, parents=names).collect()
        listed = O.json_members(spark, str(path), "string", nested=True, parents=["listed"], arrays=True).orderBy("place").collect()
    found = {n: {r.key: r.value for r in got if r.parent == n} for n in names}
    assert found == {n: want[n] for n in names}
    assert [(r.parent, r.value) for r in listed] == [("listed", "1"), ("listed", "[2]")]


def test_last_of_a_key_counts_and_broken_files_fail(spark, tmp_path):
    path = tmp_path / "twice.json"
    path.write_text('{"k": "a", "m": null, "k": "b"}\n')
    got = last_wins(O.json_members(spark, str(path), "string"), ["key"], "place").collect()
    assert {r.key: r.value for r in got} == {"k": "b", "m": None}
    again = tmp_path / "again.json"
    again.write_text('{"p": {"x": "1", "y": "1"}, "p": {"x": "2"}}')
    assert [(r.key, r.value) for r in O.json_members(spark, str(again), "string", nested=True).collect()] == [("x", "2")]
    for k, text in enumerate(('{"k": "a", "m": [1, 2', '{"k": "a', '{"k": "a"}}')):
        bad = tmp_path / f"bad{k}.json"
        bad.write_text(text)
        with pytest.raises(ValueError, match="not whole"):
            O.json_members(spark, str(bad), "string")
    bad = tmp_path / "value.json"
    bad.write_text('{"k": nonsense, "m": "a"}')
    with pytest.raises(Exception, match="MALFORMED|[Mm]alformed"):
        O.json_members(spark, str(bad), "string").collect()
    for text in ("{}", " ", ""):
        (tmp_path / "empty.json").write_text(text)
        assert O.json_members(spark, str(tmp_path / "empty.json"), "string").count() == 0


def test_objects_written_by_tasks(spark, tmp_path):
    want = _awkward(80, 7)
    rows = spark.createDataFrame(list(want.items()), "k string, v array<string>").repartition(5)
    own = rows.select(O.member(F.col("k"), F.col("v")).alias("member"), F.when(F.length("k") % 2 == 0, "even").otherwise('odd "]').alias("parent"))
    O.write_objects(own.drop("parent"), str(tmp_path / "flat"))
    O.write_objects(own, str(tmp_path / "nested"), nested=True)
    O.write_objects(rows.select(F.to_json(F.array("k")).alias("member"), F.lit("all").alias("parent")), str(tmp_path / "lists"), nested=True, arrays=True)
    files = [json.loads(p.read_text(encoding="utf-8")) for p in (tmp_path / "flat").glob("part-*")]
    assert len(files) == 5 and {k: v for f in files for k, v in f.items()} == want
    with _blocks(spark, 512):
        flat = O.json_members(spark, str(tmp_path / "flat"), "array<string>").collect()
        nested = O.json_members(spark, str(tmp_path / "nested"), "array<string>", nested=True).collect()
        lists = O.json_members(spark, str(tmp_path / "lists"), "array<string>", nested=True, arrays=True).collect()
    assert {r.key: r.value for r in flat} == want and len(flat) == 80
    assert {(r.parent, r.key) for r in nested} == {("even" if len(k) % 2 == 0 else 'odd "]', k) for k in want} and len(nested) == 80
    assert sorted(r.value[0] for r in lists) == sorted(want)


def test_other_blocks_than_before_fail(spark, tmp_path):
    """Numbers and beginnings learnt of some blocks aren't used for others; the session keeps its blocks when cores come and go."""
    (tmp_path / "a.json").write_text(json.dumps(_awkward(30)))
    (tmp_path / "a.txt").write_text("".join(f"line {i}\n" for i in range(500)))
    with _blocks(spark, 1 << 20):
        members, lines = O.json_members(spark, str(tmp_path / "a.json"), "array<string>"), jsonl.numbered_lines(spark, str(tmp_path / "a.txt"))
        assert spark.conf.get("spark.sql.files.minPartitionNum") is not None
        assert members.count() == 30 and [r.line_no for r in lines.orderBy("line_no").collect()] == list(range(1, 501))
    with _blocks(spark, 211):
        for late in (members, lines.select("line_no"), lines.select("place")):
            with pytest.raises(Exception, match="other blocks"):
                late.collect()
