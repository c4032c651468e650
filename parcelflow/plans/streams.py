"""The change streams over the table of events, run, stopped and run on from their checkpoints; their twins are those of the batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.storage import scratch
from ..sources.domain import changes
from ..streaming import changes as S
from .matching import SQL as BATCH
from .registry import book

QUERIES, SQL, query = book()


def _halves(spark, rows, ts, make):
    """What a stream over the earlier and then, after a restart, over the later half of ``rows`` gives."""
    source, out, check = (scratch(spark, f"stream-{x}") for x in ("in", "out", "check"))
    half = rows.agg(F.timestamp_micros(F.avg(F.unix_micros(ts)).cast("long")).alias("half"))
    timed = rows.crossJoin(F.broadcast(half))
    for part in (timed.where(F.col(ts) < F.col("half")), timed.where(F.col(ts) >= F.col("half"))):
        part.drop("half").write.mode("append").parquet(source)
        S.run_to(make(spark.readStream.schema(rows.schema).parquet(source)), out, check)
    return spark.read.parquet(out)


@query("STM-01_stream_of_kinds", BATCH["WIN-04_STM-01_change_kinds"])
def stream_of_kinds(spark, sf_dir):
    """The kind of each version as it arrives, from the state of its listing."""
    v = changes(spark, sf_dir).withColumns({"ts": F.col("ts").cast("timestamp"), "agency": F.when(F.col("agency") != "error", F.col("agency")), "is_active": F.col("k") % 7 > 0})
    return _halves(spark, v, "ts", lambda s: S.change_stream(s, ["k"])).select("event_id", "kind")


@query("STM-11_stream_of_bursts", BATCH["STM-11_debounced"])
def stream_of_bursts(spark, sf_dir):
    """Bursts of changes as their timers go off, with a day of the table as a minute; a change far ahead, of no listing, lets the last ones go."""
    c = changes(spark, sf_dir).select("listing_id", "event_id", F.timestamp_micros(F.expr("unix_micros(cast(ts as timestamp)) div 1440")).alias("moment"))
    ahead = c.agg(F.lit(-1).cast("long").alias("listing_id"), F.lit(-1).cast("long").alias("event_id"), (F.max("moment") + F.expr("interval 1 hour")).alias("moment"))
    got = _halves(spark, c.union(ahead.where("moment is not null")), "moment", lambda s: S.burst_stream(s, "listing_id", "moment", "event_id", late="10 minutes"))
    return got.where("key >= 0").select(F.col("key").alias("listing_id"), "sent_at", "n", "last")
