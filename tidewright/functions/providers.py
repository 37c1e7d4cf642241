"""Boundaries to outside models: text makers, judges and embedders as batched, partition-wise functions.

A provider is made once per partition from a picklable factory and called with lists. A failed call
is tried again; what fails at last becomes a row with an error instead of a failed job.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.functions import rewards
from tidewright.functions import rubric as R
from tidewright.functions.convert import above_zero
from tidewright.functions.text import first_truthy, strip

#: Makes a function from a list of inputs to a list of outputs of the same length.
Factory = Callable[[], Callable[[Sequence[dict]], Sequence]]


def _attempt(call: Callable, rows: list[dict], retries: int, pause: float) -> tuple[list, str | None]:
    problem = None
    for k in range(retries + 1):
        try:
            out = list(call(rows))
            if len(out) != len(rows):
                raise ValueError(f"{len(out)} results for {len(rows)} inputs")
            return out, None
        except Exception as e:  # noqa: BLE001  (a provider may raise anything; the error becomes a column)
            problem = f"{type(e).__name__}: {e}"
            if k < retries and pause:
                time.sleep(pause * 2**k)
    return [None] * len(rows), problem


def paced(call: Callable, rate: float, now: Callable[[], float] = time.monotonic, wait: Callable[[float], None] = time.sleep) -> Callable:
    """The call, begun at most `rate` times a second: each waits until its turn."""
    turn = [now()]

    def run(rows: list[dict]) -> Sequence:
        if (left := turn[0] - now()) > 0:
            wait(left)
        turn[0] = max(turn[0], now()) + 1 / rate
        return call(rows)

    return run


def provide(df: DataFrame, factory: Factory, inputs: list[str], output: str, kind: str, *, batch: int = 32, retries: int = 2, pause: float = 0.0, rate: float = 0.0, slots: int = 0) -> DataFrame:
    """Adds the output column and `error` (null where the call went well).

    rate: calls a second of the whole stage (0: as fast as they go), shared by `slots` tasks: rows are dealt
    to so many partitions, and each keeps to its share, retries included.

    A batch that fails is tried row by row, so one bad row doesn't take others with it.
    """
    schema = T.StructType([*df.schema.fields, *T.StructType.fromDDL(f"{output} {kind}, error string").fields])

    if rate > 0 and slots < 1:
        raise ValueError("a rate needs the number of slots that share it")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = paced(factory(), rate / slots) if rate > 0 else factory()
        for frame in frames:
            given = frame[inputs].astype(object)
            rows = iter(given.where(given.notna(), None).to_dict("records"))
            found, errors = [], []
            while part := list(islice(rows, batch)):
                out, problem = _attempt(call, part, retries if len(part) == 1 else 0, pause)
                if problem is not None and len(part) > 1:
                    single = [_attempt(call, [r], retries, pause) for r in part]
                    found += [o[0] for o, _ in single]
                    errors += [e for _, e in single]
                else:
                    found += out
                    errors += [problem] * len(part)
            yield frame.assign(**{output: pd.Series(found, index=frame.index, dtype=object), "error": pd.Series(errors, index=frame.index, dtype=object)})

    return (df.repartition(slots) if rate > 0 else df).mapInPandas(run, schema)


def embed(df: DataFrame, factory: Callable[[], Callable[[list[str]], np.ndarray]], text: str, output: str, *, batch: int = 64) -> DataFrame:
    """Adds the vectors (array<float>) of a column of texts, null ones as empty.

    The model is made once for each task and called with lists of texts; its matrix goes to Spark as one
    Arrow column, without a Python object for each number.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(output, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = factory()
        for whole in batches:
            for lo in range(0, whole.num_rows, batch):
                part = whole.slice(lo, batch)
                found = np.ascontiguousarray(call([x or "" for x in part.column(text).to_pylist()]), np.float32)
                if len(found) != part.num_rows:
                    raise ValueError(f"{len(found)} vectors for {part.num_rows} texts")
                at = np.arange(part.num_rows + 1, dtype=np.int32) * found.shape[1]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(at, found.reshape(-1))], [*part.schema.names, output])

    return df.mapInArrow(run, schema)


def provide_once(df: DataFrame, factory: Factory, inputs: list[str], output: str, kind: str, **how) -> DataFrame:
    """As provide, but equal inputs are asked about once and share the answer; nulls equal nulls."""
    asked = provide(df.select(*inputs).distinct(), factory, inputs, output, kind, **how)
    names = [f"_in{k}" for k in range(len(inputs))]
    asked = asked.select(*[F.col(c).alias(n) for c, n in zip(inputs, names, strict=True)], output, "error")
    same = None
    for c, n in zip(inputs, names, strict=True):
        one = F.col(c).eqNullSafe(F.col(n))
        same = one if same is None else same & one
    return df.join(asked, same, "left").drop(*names)


def judge_payload(history: Column, reasoning: Column) -> Column:
    """The stand-in for a judge: the rule score as the JSON object that a judge would send."""
    return R.let(R.rule_score(history, reasoning), lambda s: F.to_json(F.struct(*[s[d].alias(d) for d in R.DIMENSIONS], F.lit("rules").alias("comment"))))


def envelope_text(envelope: Column) -> Column:
    """The text of a chat completion: the message's content, else its reasoning content. (For scores see envelope_score.)"""
    at = "$.choices[0].message."
    return first_truthy(F.get_json_object(envelope, at + "content"), F.get_json_object(envelope, at + "reasoning_content"))


def mock_envelope(payload: Column) -> Column:
    """A judge's payload as the message of a chat completion."""
    message = F.struct(F.lit("assistant").alias("role"), payload.alias("content"), F.lit("").alias("reasoning_content"))
    choice = F.struct(F.lit(0).alias("index"), message.alias("message"), F.lit("stop").alias("finish_reason"))
    return F.to_json(F.struct(F.lit("mock").alias("id"), F.array(choice).alias("choices")))


def _struct(dims: list[Column], comment: Column, mode: str) -> Column:
    total = sum(dims, F.lit(0)).cast("int")
    return F.struct(*[d.cast("int").alias(n) for d, n in zip(dims, R.DIMENSIONS, strict=True)], total.alias("total"), (total / F.lit(25.0)).alias("score_norm"), F.left(comment, F.lit(500)).alias("comment"), F.lit(mode).alias("mode"))


def _whole(dims: list[Column], comment: Column, mode: str) -> Column:
    """The score if all five dimensions are there. Each is worked out once: the expressions are long."""
    return R.let(
        F.struct(*[c.alias(d) for c, d in zip(dims, R.DIMENSIONS, strict=True)]),
        lambda s: F.when(reduce(lambda a, b: a & b, [s[d].isNotNull() for d in R.DIMENSIONS]), _struct([s[d] for d in R.DIMENSIONS], comment, mode)),
    )


def json_score(text: Column) -> Column:
    """A score given as a JSON object; null unless all dimensions are there."""
    return R.let(R.judged(text), lambda obj: _whole([R.judged_dimension(obj, d) for d in R.DIMENSIONS], F.coalesce(F.try_variant_get(obj, "$.comment", "string"), F.lit("")), "json"))


def prose_score(text: Column) -> Column:
    """A score given in prose; the comment is what stands after the dimensions' names, line by line."""
    lines = [F.nullif(F.regexp_extract(text, rf"(?i){d}[^\n\r]{{0,500}}", 0), F.lit("")) for d in R.DIMENSIONS]
    said = F.nullif(F.concat_ws(" | ", *[F.nullif(strip(x), F.lit("")) for x in lines]), F.lit(""))
    return _whole([R.free_text_dimension(text, d) for d in R.DIMENSIONS], F.coalesce(F.left(said, F.lit(500)), F.lit("scores extracted from free-text judge response")), "prose")


def judged_score(payload: Column, fallback: Column | None = None) -> Column:
    """Struct of the five dimensions, total, score_norm, comment and mode.

    The payload as JSON, else as prose; all five dimensions must be found. Otherwise the fallback (a
    struct with the dimensions) with mode `rules`; null if there is none.
    """
    found = [json_score(payload), prose_score(payload)]
    if fallback is not None:
        found.append(R.let(fallback, lambda s: _struct([s[d] for d in R.DIMENSIONS], F.lit(""), "rules")))
    return F.coalesce(*found)


def envelope_score(envelope: Column) -> Column:
    """The score in a chat completion: JSON in the content or else in the reasoning content, then prose in the one or the other."""
    at = "$.choices[0].message."
    texts = F.array(*[F.coalesce(F.get_json_object(envelope, at + f), F.lit("")) for f in ("content", "reasoning_content")])
    return R.let(texts, lambda t: F.coalesce(json_score(t[0]), json_score(t[1]), prose_score(t[0]), prose_score(t[1])))


def stored_score(total: Column, norm: Column) -> Column:
    """Struct of total and score_norm (from the total where it is missing); null without a numeric total."""
    own = total.try_cast("double")
    return F.when(own.isNotNull() & ~F.isnan(own), F.struct(own.alias("total"), F.coalesce(norm.try_cast("double"), own / 25.0).alias("score_norm")))


def format_reward(has_tags: Column, think: Column, answer: Column) -> Column:
    return F.when(has_tags & (think != "") & (answer != ""), 1.0).otherwise(0.0)


def gated_gain(quality: Column, gain: Column, *, least: float, penalty: float) -> Column:
    """quality x gain where the quality suffices and the gain is positive, else the penalty."""
    return F.when((quality >= least) & above_zero(gain), quality * gain).otherwise(F.lit(penalty))


def weighted(parts: dict[str, tuple[Column, float]]) -> Column:
    """Sum of named rewards by their weights; a null reward counts as 0."""
    return sum((F.coalesce(c, F.lit(0.0)) * w for c, w in parts.values()), F.lit(0.0))


#: Rewards by name: column expressions, applied to batches of an outside trainer or to whole tables.
REWARDS: dict[str, Callable[..., Column]] = {
    "format": format_reward, "gated_gain": gated_gain, "total": weighted, "quality": rewards.quality, "gated_ndcg": rewards.ndcg_reward, "gated_dense": rewards.dense_reward, "gated_lexical": rewards.lexical_reward,
}
