"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import Rounds, dropped, scratch, stored

__all__ = ["SPACE", "WORD", "Rounds", "dropped", "fresh", "let", "salted_join", "scratch", "stored", "table", "words"]

#: The white space that separates words: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once a row.

    A column used inside a higher-order function is computed anew for each
    element if Catalyst inlines it; a lambda variable never is.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", share: int = 1000, parts: int = 64) -> DataFrame:
    """Inner or left join on ``key``, of which ``right`` has each value once.

    Keys that hold over a ``share``-th of the left rows, fewer than ``share``
    by their definition, are dealt out over ``parts`` tasks each.
    """
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = left.count()
    hot = [r[0] for r in counts.where(F.col("n") > max(total // share, 10_000)).collect() if r[0] is not None]
    if not hot:
        return left.join(right, key, how)
    salt = fresh(left, "_salt")
    hard = F.col(key).isin(hot)
    l = left.withColumn(salt, F.when(hard, F.floor(F.rand(7) * parts).cast("int")).otherwise(0))
    r = right.withColumn(salt, F.explode(F.when(hard, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))))
    return l.join(r, [key, salt], how).drop(salt)
