"""New versions of tables from changed rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OVERWRITE, NEW_ELSE_OLD, OLD_ELSE_NEW, GREATEST = "overwrite", "new_else_old", "old_else_new", "greatest"


def _merged(policy: str, old: Column, new: Column) -> Column:
    return {OVERWRITE: new, NEW_ELSE_OLD: F.coalesce(new, old), OLD_ELSE_NEW: F.coalesce(old, new), GREATEST: F.greatest(old, new)}[policy]


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], policies: Mapping[str, str] | None = None, when: Column | None = None, action: str | None = None) -> DataFrame:
    """``target`` after an upsert of ``source``, which has each key once.

    A column's policy says which value stays (overwrite by default). Rows
    that fail ``when``, over the target's columns, stay as they are. With
    ``action`` a column of that name says insert, update or keep. The join is
    a full outer one on the key: each side is shuffled once, nothing is sorted twice.
    """
    policies = policies or {}
    values = [c for c in target.columns if c not in keys]
    s = source.select(*keys, F.struct(*values, F.lit(True).alias("_is")).alias("_new"))
    t = target.select(*keys, F.struct(*values, F.lit(True).alias("_is"), (when if when is not None else F.lit(True)).alias("_may")).alias("_old"))
    both = t.join(s, list(keys), "full")
    old, new = F.col("_old"), F.col("_new")
    has, came = old["_is"].isNotNull(), new["_is"].isNotNull()
    changes = came & (~has | F.coalesce(old["_may"], F.lit(False)))
    value = lambda c: F.when(changes & has, _merged(policies.get(c, OVERWRITE), old[c], new[c])).when(changes, new[c]).otherwise(old[c]).alias(c)
    out = [*keys, *map(value, values)]
    if action:
        out.append(F.when(changes & ~has, "insert").when(changes, "update").otherwise("keep").alias(action))
    return both.select(*out)


def insert_new(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``target`` and the rows of ``source`` whose key it has not."""
    return target.unionByName(source.join(target, list(keys), "left_anti").select(*target.columns))


def differing(target: DataFrame, source: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows of ``source`` whose key is new or that differ in a column, nulls compared as values."""
    t = target.select(*keys, F.struct(*columns).alias("_old"), F.lit(True).alias("_is"))
    return source.join(t, list(keys), "left").where(F.col("_is").isNull() | ~F.col("_old").eqNullSafe(F.struct(*columns))).select(*source.columns)


def replace_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Writes ``df`` over the partitions that it has rows of; the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def replace_children(children: DataFrame, fresh: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """``children`` without those of the upserted ``parents``, and the ``fresh`` rows in their place."""
    return children.join(parents.select(key), key, "left_anti").unionByName(fresh.join(parents.select(key), key, "left_semi"))


def with_change_list(target: DataFrame, source: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows of ``source`` that are new or differ, with ``changes``: names of the columns that differ, all of them for a new key."""
    old = target.select(*keys, F.struct(*columns).alias("_old"))
    names = F.array_compact(F.array(*(F.when(F.col("_old").isNull() | ~F.col(f"_old.{c}").eqNullSafe(F.col(c)), F.lit(c)) for c in columns)))
    return source.join(old, list(keys), "left").withColumn("changes", names).drop("_old").where(F.size("changes") > 0)


def refresh(views: Mapping[str, DataFrame], folder: str) -> DataFrame:
    """Writes each view under ``folder``; (view, ok, detail) for each, a failed one leaves the others to be written."""
    if not views:
        raise ValueError("no views")
    told = []
    for name, view in views.items():
        try:
            view.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")
            told.append((name, True, None))
        except Exception as e:  # the report says what failed, as a refresh of many views goes on
            told.append((name, False, str(e).splitlines()[0][:500]))
    spark: SparkSession = next(iter(views.values())).sparkSession
    return spark.createDataFrame(told, "view string, ok boolean, detail string")
