"""The registered queries, each with the SQL that checks it where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIGITS = 6


def rounded(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query with its doubles rounded, as sums of doubles depend on the order of addition."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = query(spark, folder)
        return df.select(*(F.round(c, DIGITS).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


def rounded_sql(sql: str, *columns: str) -> str:
    """The same for SQL."""
    return f"SELECT * REPLACE ({', '.join(f'round({c}, {DIGITS}) AS {c}' for c in columns)}) FROM ({sql}) AS q"
