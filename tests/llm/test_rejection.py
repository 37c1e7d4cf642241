"""Rejection by distance in op2: gibberish, unlearned scripts and junk among the training rows."""

import base64
import random

import pyarrow as pa

from tidewright.llm import language


def _junk(rng):
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    yield " ".join(letters(rng.randint(2, 12)) for _ in range(100))
    yield base64.b64encode(rng.randbytes(600)).decode()
    yield rng.randbytes(600).hex()
    yield "Η γρήγορη καφέ αλεπού πηδάει πάνω από το τεμπέλικο σκυλί και κοιμάται. " * 10
    yield "Быстрая коричневая лиса прыгает через ленивую собаку и потом спит. " * 10


def test_gibberish_and_unlearned_scripts_are_rejected_beside_a_junk_row(spark):
    folder = "/root/testdata/sf0.1/documents.parquet"
    docs = spark.read.parquet(folder).filter("doc_id % 5 = 1").select("doc_id", "text", "lang")
    rng = random.Random(9)
    junk = [(-1 - i, t, lang) for i, (t, lang) in enumerate((rng.randbytes(300).hex(), x.lang) for x in docs.select("lang").distinct().collect() if x.lang)]
    model = language.fit(docs.unionByName(spark.createDataFrame(junk, "doc_id long, text string, lang string")), per_language=10_000, clusters=4)
    rejected = language._judged(model, pa.array(list(_junk(rng))))[2]
    assert rejected.all(), rejected.tolist()
    held = spark.read.parquet(folder).filter("doc_id % 5 = 2").select("doc_id", "text")
    got = language.identify(held, model)
    assert got.filter("rejected").count() <= 0.005 * got.count()
