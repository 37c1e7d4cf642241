"""The pipeline's stages by row: repeated ids, one id on two texts, nulls, clashing names, empty tables."""

import corpus_pipeline as pipeline


def test_near_duplicates_by_row(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(1, text(1)), (1, text(1)), (2, text(1)), (2, text(2)), (None, text(1)), (None, text(3)), (None, text(3)), (4, text(4)), (5, ""), (5, ""), (6, None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, source string").repartition(3)
    got = pipeline.distinct_texts(spark, docs, "")
    assert got.columns == docs.columns
    found = sorted(((r.doc_id, r.text) for r in got.collect()), key=repr)
    assert found == sorted([(1, text(1)), (2, text(2)), (None, text(3)), (4, text(4)), (5, ""), (6, None)], key=repr)


FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_rows_and_columns_of_any_name(spark):
    """Nulls in any column, repeated rows, empty and long texts; column names that the stages use themselves."""
    good = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("lang = 'en' and n_chars > 500").orderBy("doc_id").first().text[:500] + " "
    rows = [(i, good + f"number {i} " + " ".join(f"w{i}x{k}" for k in range(30)), None if i % 2 else "en", None, i) for i in range(6)]
    rows += [rows[0], (None, rows[1][1] + " more", None, None, None), (7, None, None, None, 7), (8, "", "en", "s", 8), (9, good * 500, None, "s", None)]
    names = ["doc_id", "text", "lang", "source", "n_chars", "key", "n", "row", "group", "node", "part", "doc", "n_words", "starts", "items", "score", "_key", "rejected", "uid", "a.b", "c`d", "e f"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c.replace('`', '``')}` string" for c in names[5:])
    docs = spark.createDataFrame([(*r, *["clash"] * (len(names) - 5)) for r in rows], schema).repartition(2)
    every = sorted(((r.doc_id, r.text, r.n_chars) for r in docs.collect()), key=repr)
    left = {name: sorted(((r.doc_id, r.text, r.n_chars) for r in stage(spark, docs, FOLDER).collect()), key=repr) for name, stage in pipeline.STAGES[:-1]}
    assert left["language_id"] == [x for x in every if x[1]]
    assert left["toxicity"] == left["decontamination"] == every
    assert left["near_duplicates"] == sorted([x for x in set(every) if x[0] is not None], key=repr)  # the null id is a near copy of row 1
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).columns == names, name
    assert sorted(((r.doc_id, r.n_tokens == 0) for r in pipeline.encoded(spark, docs, FOLDER).collect()), key=repr) == sorted([(i, not t) for i, t, _ in every], key=repr)


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0, name
