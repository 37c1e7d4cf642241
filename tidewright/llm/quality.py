"""Quality classifier: interpolated modified Kneser-Ney model on trusted text, and perplexity limits.

The model is of words (see `wordmodel`): its counts grow with the trusted text, are sharded by middle word,
and every document's n-grams meet them there; n_symbols is the number of words.

One trusted document in `held_out` (by a hash of its id) is kept out of the counts. Limits are
quantiles of the perplexity of those by language, so they are not of text that the model has seen; a
document is kept if its perplexity is at most its language's limit (times `slack`), or the limit over
all of them where its language has none.

Texts meet the marks of trusted documents in a join. Marks grow with the documents and aren't
broadcast; a bitmap of bounded size, made from their ids, first leaves most other texts out at the scan.

Edge cases: null text and text without words have no symbols, perplexity null, and is not kept; without trusted
text the model is uniform and everything with words is kept; null languages are one language (`und`);
repeated rows and rows without an id are each scored; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm import wordmodel
from tidewright.llm.bitmap import possible
from tidewright.llm.spark_io import id_remainder, kept

QUANTILE, SLACK, HELD_OUT = 0.995, 1.05, 5


def classify(docs: DataFrame, trusted_ids: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE, slack: float = SLACK, held_out: int = HELD_OUT) -> DataFrame:
    """One row per document row: doc_id, lang, n_symbols, perplexity, limit, keep.

    trusted_ids: ids of the documents whose text is trusted.
    """
    held = id_remainder("doc_id", held_out) == 0
    marks = kept(trusted_ids.select(F.col(id_col).cast("long").alias("doc_id")).filter("doc_id is not null").distinct().withColumn("held", held), "marks")
    learnt, limiting = marks.filter("not held").select("doc_id"), marks.filter("held").select("doc_id", F.lit(True).alias("limiting"))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    model = wordmodel.fit(possible(source.select("doc_id", "text"), "doc_id", learnt, learnt.count()).join(learnt.hint("merge"), "doc_id", "left_semi"), text_bytes=size)
    scored = kept(wordmodel.score(source, model).join(limiting, "doc_id", "left"), "scored")
    own = scored.filter("limiting and perplexity is not null")
    at = lambda: F.percentile_approx("perplexity", quantile, 10_000)
    limits = kept(own.groupBy("lang").agg(at().alias("own")), "limits")
    return (
        scored.join(limits, "lang", "left")
        .join(F.broadcast(own.agg(at().alias("all"))))
        .withColumn("limit", F.coalesce("own", "all", F.lit(float("inf"))) * slack)
        .select("doc_id", "lang", "n_symbols", "perplexity", "limit", F.coalesce(F.col("perplexity") <= F.col("limit"), F.lit(False)).alias("keep"))
    )
