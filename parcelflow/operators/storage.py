"""Tables in the folder that the driver and all executors share: they survive lost executors and cut the lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where it is unset a session on one machine (tests) gets a temporary
    folder; one on a cluster gets an error, as no other folder is known to be
    shared.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/parcelflow-{name}-{uuid.uuid4().hex}"
    _MADE[path] = spark
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes what was written to a scratch path."""
    _MADE.pop(path, None)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Rounds:
    """The tables of an iteration, of which only the last one is kept."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.last = spark, name, None

    def put(self, df: DataFrame) -> DataFrame:
        """``df`` as the table of this round; the one before goes once it is written."""
        path = scratch(self.spark, self.name)
        df.write.parquet(path)
        if self.last:
            dropped(self.spark, self.last)
        self.last = path
        return self.spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clear() -> None:
    for path, spark in list(_MADE.items()):
        if spark.sparkContext._jsc is not None:
            try:
                dropped(spark, path)
            except Exception:  # the session's machine may be gone at this point; the folder then outlives it
                return
