"""An outbox table of dirty keys: marking, claiming and settling, each as a new version of the table.

Columns: the key, dirty_at, attempts, next_try_at, last_error. A key is in it
once, however often it changed: what goes out is its last state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .changes import backoff_seconds

#: Seconds that a key has to be quiet before it goes out, and after which it goes out anyway. (Fixed values.)
QUIET_S, SWEEP_S = 2, 60


def _later(at: Column, seconds: Column) -> Column:
    return F.timestamp_seconds(F.unix_micros(at) / 1_000_000 + seconds)


def bursts(changes: DataFrame, key: str, at: str, last: Column, quiet_s: int = QUIET_S, sweep_s: int = SWEEP_S) -> DataFrame:
    """(key, sent_at, n, last): what goes out when, if changes of a key less than ``quiet_s`` apart go out once, with the last state.

    A burst goes out when it has been quiet, or at the next of the sweeps
    that come each ``sweep_s`` seconds; what follows a sweep is a burst of
    its own. Of changes at one time the largest ``last`` counts. A session
    window over the key within its sweep: one shuffle, on any number of keys.
    """
    moment = F.col(at).cast("timestamp")
    micros = F.unix_micros(moment)
    sweep = F.timestamp_micros(((F.floor(micros / (sweep_s * 1_000_000)) + 1) * sweep_s * 1_000_000).cast("long"))
    rows = changes.where(F.col(at).isNotNull()).select(key, moment.alias("_at"), sweep.alias("_sweep"), last.alias("_last"))
    each = rows.groupBy(key, "_sweep", F.session_window("_at", f"{quiet_s} seconds").alias("_w")).agg(F.count(F.lit(1)).alias("n"), F.max_by("_last", F.struct("_at", "_last")).alias("last"))
    return each.select(key, F.least("_sweep", F.col("_w.end")).alias("sent_at"), "n", "last")


def marked(outbox: DataFrame, dirty: DataFrame, key: str) -> DataFrame:
    """``outbox`` with the keys of ``dirty`` (key, at), each due at once at its last time: a new change ends an earlier wait and its errors."""
    new = dirty.groupBy(key).agg(F.max("at").alias("_at"))
    both = outbox.join(new, key, "full")
    fresh = F.col("_at").isNotNull()
    return both.select(
        key,
        F.coalesce("_at", "dirty_at").alias("dirty_at"),
        F.when(fresh, 0).otherwise(F.col("attempts")).cast("int").alias("attempts"),
        F.coalesce("_at", "next_try_at").alias("next_try_at"),
        F.when(fresh, F.lit(None).cast("string")).otherwise(F.col("last_error")).alias("last_error"),
    )


def claimed(outbox: DataFrame, now: Column, most: int | None = None, first_dirty: Column | None = None, key: str = "listing_id") -> DataFrame:
    """The keys whose turn it is: due, and quiet for two seconds or, by ``first_dirty``, waiting for a minute; oldest first, ``most`` at most."""
    quiet = _later(F.col("dirty_at"), F.lit(QUIET_S)) <= now
    if first_dirty is not None:
        quiet = quiet | (_later(first_dirty, F.lit(SWEEP_S)) <= now)
    due = outbox.where((F.col("next_try_at") <= now) & quiet)
    return due if most is None else due.orderBy("next_try_at", "dirty_at", key).limit(most)


def settled(outbox: DataFrame, results: DataFrame, key: str, now: Column) -> DataFrame:
    """``outbox`` after ``results`` (key, sent_at, error): what went out leaves, unless it became dirty again after ``sent_at``; what failed waits longer each time."""
    r = results.select(key, "sent_at", F.col("error").alias("_error"), F.lit(True).alias("_is"))
    both = outbox.join(r, key, "left")
    tried = F.coalesce(F.col("_is"), F.lit(False)) & (F.col("dirty_at") <= F.col("sent_at"))
    failed = tried & F.col("_error").isNotNull()
    attempts = F.col("attempts") + F.when(failed, 1).otherwise(0)
    return both.where(~tried | failed).select(
        key,
        "dirty_at",
        attempts.cast("int").alias("attempts"),
        F.when(failed, _later(now, backoff_seconds(attempts))).otherwise(F.col("next_try_at")).alias("next_try_at"),
        F.when(failed, F.col("_error")).otherwise(F.col("last_error")).alias("last_error"),
    )
