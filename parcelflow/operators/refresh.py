"""Summaries that follow inserts and deletes without reading what did not change."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import stored

#: Folders that keys are dealt over; a change reads and writes those of its keys alone.
FOLDERS = 64


class Summary:
    """Aggregates of a table by key, kept in a folder as counts of values, which may fall as well as rise.

    ``sums`` are totalled (whole numbers, such as cents, so that what comes
    off leaves no trace); of ``values`` the number of each different value
    is kept, which gives distinct counts, least and greatest ones after deletes
    too. Keys are dealt over ``folders`` parts by hash. ``refresh`` merges
    changes: it reads the parts of changed keys and replaces just these.
    A key without rows goes. Keys, values and sums may be null: a null value counts for nothing.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], sums: Sequence[str], values: Sequence[str], folders: int = FOLDERS):
        self.spark, self.path, self.keys, self.sums, self.values, self.folders = spark, path, list(keys), list(sums), list(values), folders

    def _folder(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.folders)).cast("int").alias("folder")

    def _partial(self, rows: DataFrame, sign: int) -> DataFrame:
        """Changes of the counts: one row for each key (what is null) and for each value of it."""
        total = [F.struct(F.lit(None).cast("string").alias("what"), F.lit(None).cast("string").alias("value"), *(F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(f"sum_{c}") for c in self.sums))]
        each = [F.struct(F.lit(c).alias("what"), F.col(c).cast("string").alias("value"), *(F.lit(0).cast("long").alias(f"sum_{s}") for s in self.sums)) for c in self.values]
        long = rows.select(*self.keys, F.explode(F.array(*total, *each)).alias("x")).select(*self.keys, "x.*").where("what is null or value is not null")
        return long.groupBy(*self.keys, "what", "value").agg((sign * F.count(F.lit(1))).alias("n"), *((sign * F.sum(f"sum_{c}")).alias(f"sum_{c}") for c in self.sums))

    def _write(self, counts: DataFrame, mode: str) -> None:
        counts.withColumn("folder", self._folder()).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("folder").parquet(self.path)

    def build(self, rows: DataFrame) -> None:
        self._write(self._partial(rows, 1), "overwrite")

    def refresh(self, inserted: DataFrame, deleted: DataFrame) -> None:
        """Merges rows that came and rows that went (an update is both)."""
        changes = stored(self._partial(inserted, 1).unionByName(self._partial(deleted, -1)).withColumn("folder", self._folder()), "changes")
        # At most ``folders`` numbers: partitions that the scan below is cut down to.
        touched = [r[0] for r in changes.select("folder").distinct().collect()]
        if not touched:
            return
        before = self._counts().where(F.col("folder").isin(touched))
        sums = [F.sum(c).alias(c) for c in ("n", *(f"sum_{c}" for c in self.sums))]
        merged = before.unionByName(changes).groupBy("folder", *self.keys, "what", "value").agg(*sums).where("n <> 0").drop("folder")
        now = stored(merged, "merged")
        # A folder that has nothing left is not written, and would keep its old rows: it gets a row of no key that counts nothing.
        emptied = set(touched) - {r[0] for r in now.select(self._folder()).distinct().collect()}
        self._write(now, "overwrite")
        if emptied:
            none = self.spark.createDataFrame([(i,) for i in sorted(emptied)], "folder int").select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in now.schema if f.name != "n"), F.lit(0).cast("long").alias("n"), "folder")
            none.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("folder").parquet(self.path)

    def _counts(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def read(self) -> DataFrame:
        """Keys, n, each ``sum_``, and of each value column its number of different ones, least and greatest (as text)."""
        of = lambda c, f: f(F.when(F.col("what") == c, F.col("value")))
        aggs = [F.sum(F.when(F.col("what").isNull(), F.col("n"))).alias("n"), *(F.sum(f"sum_{c}").alias(f"sum_{c}") for c in self.sums)]
        for c in self.values:
            aggs += [of(c, F.count).alias(f"different_{c}"), of(c, F.min).alias(f"least_{c}"), of(c, F.max).alias(f"greatest_{c}")]
        return self._counts().where("n <> 0").groupBy(*self.keys).agg(*aggs)
