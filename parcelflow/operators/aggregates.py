"""Aggregates that SQL has no single function for."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_if(when: Column) -> Column:
    return F.coalesce(F.sum(when.cast("long")), F.lit(0).cast("long"))


def exact_sum(x: Column) -> Column:
    """Sum of money values to the cent, the same in any order of rows."""
    return F.sum(x.cast("decimal(18,2)")).cast("double")


def mean(x: Column, digits: int = 2) -> Column:
    return F.round(exact_sum(x) / F.count(x), digits)


def weighted_mean(x: Column, w: Column) -> Column:
    """Null values count on neither side."""
    return F.try_divide(F.sum(F.when(x.isNotNull(), x * w)), F.sum(F.when(x.isNotNull(), w)))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(F.try_divide(100.0 * part, whole), digits)


def first_by(x: Column, *order: Column) -> Column:
    """``x`` of the row with the largest ``order``; end it with a unique column."""
    return F.max_by(x, F.struct(*order))


def modes(df: DataFrame, keys: Sequence[str], columns: Sequence[str], seen: str) -> DataFrame:
    """The commonest value of each of several columns by key; of equally common ones the one last seen, then the greatest.

    Nulls don't count. Each (key, value) is counted before the second
    shuffle, so one hot key sends as many rows as it has values. The columns
    go through one explode, not one job each, so share a type (text).
    """
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("what"), F.col(c).cast("string").alias("value")) for c in columns))).alias("v")
    counted = df.select(*keys, F.col(seen).alias("_seen"), each).where("v.value is not null").groupBy(*keys, F.col("v.what").alias("what"), F.col("v.value").alias("value")).agg(F.count(F.lit(1)).alias("n"), F.max("_seen").alias("last"))
    best = lambda c: F.max_by(F.when(F.col("what") == c, F.col("value")), F.when(F.col("what") == c, F.struct("n", "last", "value"))).alias(c)
    return counted.groupBy(*keys).agg(*map(best, columns))


def best_ranked(x: Column, label: Column, ranks: Sequence[str], *tie: Column) -> Column:
    """``x`` of the row whose label comes first in ``ranks``; unknown labels come last."""
    rank = reduce(lambda out, i: F.when(label == ranks[i], F.lit(i)).otherwise(out), reversed(range(len(ranks))), F.lit(len(ranks)))
    return F.min_by(x, F.struct(rank, *tie))


def price_bands(prices: DataFrame, price_col: str, ceiling: float, most: int, depth: int = 8) -> DataFrame:
    """(low, high, total): [0, ceiling) halved until a band has at most ``most`` rows, or ``depth`` times.

    One count over the finest bands; the coarser ones are sums of those, so
    nothing but 2^depth rows is halved. Prices outside count at the ends.
    """
    finest = 1 << depth
    width = ceiling / finest
    n = prices.where(F.col(price_col).isNotNull()).select(F.least(F.lit(finest - 1), F.greatest(F.lit(0), F.floor(F.col(price_col) / width))).cast("long").alias("band")).groupBy("band").agg(F.count(F.lit(1)).alias("n"))
    bands = prices.sparkSession.range(finest).withColumnRenamed("id", "band").join(n, "band", "left")
    each = bands.select("band", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("d")).withColumn("size", F.pow(F.lit(2), depth - F.col("d")).cast("long")).withColumn("at", F.floor(F.col("band") / F.col("size")))
    whole = each.groupBy("d", "size", "at").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.collect_list("band").alias("bands"))
    small = whole.where((F.col("total") <= most) | (F.col("d") == depth)).select(F.explode("bands").alias("band"), "d", "size", "at", "total")
    leaf = small.groupBy("band").agg(F.min_by(F.struct("size", "at", "total"), "d").alias("b")).select("b.*").distinct()
    return leaf.select((F.col("at") * F.col("size") * width).alias("low"), ((F.col("at") + 1) * F.col("size") * width).alias("high"), "total")
