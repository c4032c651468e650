"""One or a few rows of each key, in a stated order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_of_each(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key. ``order`` should end with a unique column.

    A rank limit over a window: Spark keeps at most n rows a key and task
    before the shuffle, so a hot key sends little.
    """
    return ranked(df, keys, order, "_rank").where(F.col("_rank") <= n).drop("_rank")


def best_of_each(df: DataFrame, keys: Sequence[str], order: Column, columns: Sequence[str]) -> DataFrame:
    """The columns of the row with the largest ``order`` of each key, as a pre-aggregated maximum; no sort."""
    best = F.max_by(F.struct(*columns), order).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*")


def without_repeats(df: DataFrame, columns: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The earliest of the rows that agree in ``columns``; nulls agree with nulls."""
    return top_of_each(df, list(columns), order)
