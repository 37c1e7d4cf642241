"""Conversions of loosely typed values: sets of whole numbers, lists in text, vectors, cache keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_set(values: Column) -> Column:
    """The whole numbers of an array, ascending and distinct; what isn't one is left out, null is empty."""
    numbers = F.transform(F.coalesce(values.cast("array<string>"), F.array().cast("array<string>")), lambda x: x.try_cast("long"))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda x: x.isNotNull())))


def int_set_of_one(value: Column) -> Column:
    """The set of a single value; empty if it is no whole number."""
    return int_set(F.array(value.cast("string")))


def int_set_in_text(text: Column) -> Column:
    """The whole numbers in a text: those of a JSON list, else all runs of digits with their signs."""
    own = F.trim(F.coalesce(text, F.lit("")))
    listed = F.from_json(own, "array<string>")
    return int_set(F.when(own.startswith("[") & listed.isNotNull(), listed).otherwise(F.regexp_extract_all(own, F.lit(r"-?\d+"), F.lit(0))))


def numbers_in(text: str, kind: type = int) -> list:
    """The numbers of a comma-separated list, blanks left out."""
    return [kind(x) for x in text.split(",") if x.strip()]


def cycled(values: list[float], index: Column) -> Column:
    """The value at a place that runs round the list, such as a candidate's temperature."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def dot(a: Column, b: Column) -> Column:
    """The product of two vectors; different lengths raise."""
    own = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)
    return F.when(F.size(a) == F.size(b), own).otherwise(F.raise_error(F.lit("vectors of different lengths")).cast("double"))


def unit(v: Column) -> Column:
    """The vector at length one; zeros stay."""
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: x / F.greatest(size, F.lit(1e-12)))


def prefix(v: Column, size: int) -> Column:
    """The first numbers of a vector (all, for size 0), at length one."""
    return unit(F.slice(v, 1, size) if size > 0 else v)


def masked_mean(rows: Column, mask: Column) -> Column:
    """The mean of those vectors of an array whose mask is 1, at length one; zeros if there are none."""
    kept = F.filter(F.arrays_zip(rows.alias("v"), mask.alias("m")), lambda x: x["m"] == 1)
    zero = F.transform(rows[0], lambda x: F.lit(0.0))
    total = F.aggregate(F.transform(kept, lambda x: x["v"]), zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return unit(F.transform(total, lambda x: x / F.greatest(F.size(kept), F.lit(1))))


def cache_key(**parts: Column) -> Column:
    """md5 of the parts as a JSON object with its keys in order; the same for the same parts."""
    return F.md5(F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)]), {"ignoreNullFields": "false"}))


def above_zero(x: Column) -> Column:
    """Whether a number is above 0; undefined ones aren't (Spark orders NaN after all others)."""
    return (x > 0) & ~F.isnan(x.cast("double"))
