"""Lexical matching of two keys: equal, contained as words, or alike by matching blocks."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.text import jaccard, tokens_of

MATCH = "struct<matched:boolean,score:double,method:string>"


@F.pandas_udf(T.DoubleType())
def block_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Twice the matching characters over all characters, by longest matching blocks (not an edit distance)."""
    for left, right in pairs:
        yield pd.Series([SequenceMatcher(None, a, b).ratio() if a is not None and b is not None else 0.0 for a, b in zip(left, right)], dtype="float64")


def word_match(a: Column, b: Column) -> Column:
    """struct(matched, score, method) of the two ways that need no character comparison."""
    ta, tb = tokens_of(a), tokens_of(b)
    contained = (F.size(F.array_except(ta, tb)) == 0) | (F.size(F.array_except(tb, ta)) == 0)

    def out(matched: bool, score: Column, method: str) -> Column:
        return F.struct(F.lit(matched).alias("matched"), score.cast("double").alias("score"), F.lit(method).alias("method"))

    return (
        F.when((a == "") | (b == ""), out(False, F.lit(0.0), "none"))
        .when(a == b, out(True, F.lit(1.0), "exact"))
        .when(contained & (F.size(ta) > 0) & (F.size(tb) > 0), out(True, jaccard(F.array_distinct(ta), F.array_distinct(tb)), "token_subset"))
        .otherwise(out(False, F.lit(0.0), "none"))
    )


def ratio_reachable(a: Column, b: Column, threshold: float) -> Column:
    """Whether lengths alone allow a ratio of ``threshold``: prunes pairs before the Python step."""
    return 2.0 * F.least(F.length(a), F.length(b)) >= threshold * (F.length(a) + F.length(b))


def with_lexical_match(df, a: str, b: str, threshold: float = 0.86, min_chars: int = 5, name: str = "match"):
    """``df`` with a match struct of columns ``a`` and ``b``; only pairs that words do not settle reach Python."""
    words = word_match(F.col(a), F.col(b))
    worth = ~words["matched"] & (F.least(F.length(a), F.length(b)) >= min_chars) & ratio_reachable(F.col(a), F.col(b), threshold)
    step = df.withColumn("_w", words).withColumn("_r", block_ratio(F.when(worth, F.col(a)), F.when(worth, F.col(b))))
    fuzzy = F.struct(F.lit(True).alias("matched"), F.col("_r").alias("score"), F.lit("fuzzy").alias("method"))
    return step.withColumn(name, F.when(F.col("_r") >= threshold, fuzzy).otherwise(F.col("_w"))).drop("_w", "_r")
