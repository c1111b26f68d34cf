"""Probability and score arithmetic as Column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def softmax_over(value: Column, *group: str) -> Column:
    """Softmax of a column within a group, shifted by the group's maximum."""
    w = Window.partitionBy(*group)
    e = F.exp(value - F.max(value).over(w))
    return e / F.sum(e).over(w)


def softmax_array(values: Column) -> Column:
    """Softmax of an array: null stays null, empty stays empty, null members count as negative infinity."""
    e = F.transform(values, lambda v: F.coalesce(F.exp(v - F.array_max(values)), F.lit(0.0)))
    total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return F.transform(e, lambda v: F.when(total > 0, v / total).otherwise(1.0 / F.size(values)))


def softmax_map(values: Column) -> Column:
    """Softmax of a map's values, keys and their order kept."""
    top = F.array_max(F.map_values(values))
    total = F.aggregate(F.map_values(values), F.lit(0.0), lambda a, v: a + F.exp(v - top))
    return F.transform_values(values, lambda _, v: F.exp(v - top) / total)


def noisy_or(p: Column) -> Column:
    """Aggregate 1 - prod(1 - p): 1 where any p reaches 1, null members ignored, 0 without members."""
    return F.when(F.max(p) >= 1, 1.0).otherwise(F.coalesce(-F.expm1(F.sum(F.when(p < 1, F.log1p(-p)))), F.lit(0.0)))


def checked_probability(p: Column, slack: float = 1e-12) -> Column:
    """A probability clamped to [0, 1]; raises beyond the slack or where it is not a number."""
    bad = F.isnan(p) | (p < -slack) | (p > 1 + slack)
    return F.when(~bad, F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))).otherwise(F.when(bad, F.raise_error(F.concat(F.lit("not a probability: "), p.cast("string"))).cast("double")))


def bipolar(positive: Column, negative: Column, neutral: Column, low: float = 0.0, high: float = 0.40) -> Column:
    """0..100 around 50, drawn back to 50 where the neutral reading prevails."""
    raw = 100 * positive / (positive + negative + F.lit(1e-9))
    gate = F.least(F.greatest((F.greatest(positive, negative) - neutral - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    return 50 + gate * (raw - 50)


def ocean_weight(high: Column, medium: Column) -> Column:
    return 100 * high + 50 * medium


def mention_weight(high: Column, medium: Column) -> Column:
    return high + 0.5 * medium


def skewed(x: Column) -> Column:
    """Pushes scores away from 50 along a sine, within 0..100."""
    return F.least(F.greatest(50 + 50 * F.sin(F.pi() / 2 * (x - 50) / 50), F.lit(0.0)), F.lit(100.0))


@F.pandas_udf(T.DoubleType())
def round_half_even(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Rounds a double as its binary value stands (ties cannot occur but for exact binary halves)."""
    for x, n in parts:
        yield pd.Series([round(a, int(b)) if a == a else None for a, b in zip(x, n)], dtype="float64")


def confidence(m: Column) -> Column:
    """The largest probability of a map; 0 without entries."""
    return F.coalesce(F.array_max(F.map_values(m)), F.lit(0.0))


def margin(m: Column) -> Column:
    """Lead of the largest probability over the next; 1 for a single entry, 0 without entries."""
    s = F.sort_array(F.map_values(m), False)
    return F.when(F.size(s) == 0, 0.0).when(F.size(s) == 1, 1.0).otherwise(F.get(s, 0) - F.get(s, 1))


def first_best_key(m: Column) -> Column:
    """The key of the largest value; the first written wins a tie. Null without entries."""
    e = F.map_entries(m)
    return F.aggregate(e, F.struct(F.lit(None).cast("string").alias("key"), F.lit(float("-inf")).alias("value")), lambda a, x: F.when(x["value"] > a["value"], F.struct(x["key"].alias("key"), x["value"].alias("value"))).otherwise(a))["key"]


def cluster_seed(base: int, cluster: Column) -> Column:
    """First 16 hex digits of SHA-256("base:cluster"), as text of the unsigned number."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{base}:"), cluster.cast("string")), 256), 1, 16), 16, 10)
