"""What Python workers keep between the steps of a query, and how many sets of them a query starts."""

import gc
import tracemalloc

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import SparkSession

from tidewright.llm import bpe, jaccard


def test_tokenizer_tables_go_when_the_worker_does_other_work(spark):
    docs = spark.createDataFrame([(i, f"some text number {i}") for i in range(8)], "doc_id long, text string").repartition(4).cache()
    text = bpe.tokenizer_text(public_tokenizers.path("byte_bpe_50k.json"))
    assert bpe.round_trip(docs, text).filter("decoded is not null").count() == 8

    def held(batches):
        n = sum(isinstance(x, bpe.Vocabulary) for x in gc.get_objects())
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([n] * batch.num_rows, pa.int32())], ["n"])

    assert [r.n for r in docs.mapInArrow(held, "n int").collect()] == [0] * 8


def test_near_duplicates_start_one_set_of_workers(spark, monkeypatch):
    """Rows that the driver makes are read by Python workers of their own kind, which stay beside the others."""
    rows = [(i, " ".join(f"w{k}" for k in range(40)) + f" w{i}") for i in range(12)] + [(20, "other words that stand alone here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(SparkSession, "createDataFrame", None)
    for region in (4, 2048):
        assert {r.doc_id: r.component_id for r in jaccard.join(docs, region=region).collect()} == {i: 0 if i < 20 else i for i, _ in rows}


def test_counters_of_a_slice_make_no_further_table():
    """One table of 32-bit counters; counting a slice into it needs memory for the slice only."""
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "key": [1, 2], "text": ["a b c d e f", "a b c d e f"]})
    list(jaccard._measure(5)([batch]))
    tracemalloc.start()
    out = list(jaccard._measure(5)(iter([batch])))[0]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.column("n_shingles").to_pylist() == [2, 2]
    assert most < 1.5 * np.dtype(np.uint32).itemsize * jaccard.COUNTERS
