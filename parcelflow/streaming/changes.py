"""Change detection and an outbox over streams of listing versions."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.latest import best_of_each
from ..operators.outbox import QUIET_S, SWEEP_S

VERSION = "listing_id long, event_id long, ts timestamp, price double, agency string"


KINDS = "listing_id long, event_id long, kind string"


class _Kinds(StatefulProcessor):
    """The last version of a listing, and the kinds of those that come after it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at long, agency string, price double, active boolean, details string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        # A listing has few versions a batch: plain values cost far less than frames of a few rows.
        new = sorted((r for b in rows for r in zip(*(b[c].tolist() for c in self.COLUMNS), strict=True)), key=lambda r: r[:2])
        kept = self.last.get()
        before, kinds = kept and kept[1:], []
        for at, _, *now in new:
            if kept and at < kept[0]:
                kinds.append("late")
                continue
            now = [None if v is None or v != v else v for v in now]
            kinds.append(self._kind(before, now))
            before, last = now, at
        if any(k != "late" for k in kinds):
            agency, price, active, details = before
            self.last.update((int(last), agency, price and float(price), bool(active), details))
        yield pd.DataFrame({"listing_id": key[0], "event_id": [r[1] for r in new], "kind": pd.Series(kinds, dtype=object)})

    COLUMNS = ("at", "event_id", "agency", "price", "active", "details")

    @staticmethod
    def _kind(before: Sequence | None, now: Sequence) -> str | None:
        if before is None:
            return "new"
        differs = [a is not None and b is not None and a != b for a, b in zip(before, now, strict=True)]
        if before[2] is not None and not before[2] and now[2]:
            return "reactivated"
        return "agency_change" if differs[0] else "price_change" if differs[1] else "updated" if before[3] != now[3] else None

    def close(self) -> None:
        pass


def change_stream(versions: DataFrame, details: Sequence[str] = ()) -> DataFrame:
    """(listing_id, event_id, kind) of each version that arrives, against the last one of its listing: the kinds that the batch knows.

    The state of a listing is its last version. Versions in
    one batch are taken by time; one older than the state gets the kind
    ``late`` and moves nothing. Without a column is_active nothing is
    reactivated; ``details`` are compared as one JSON text.
    """
    keeps_state(versions.sparkSession)
    active = "coalesce(is_active, true)" if "is_active" in versions.columns else "true"
    rows = versions.selectExpr("listing_id", "event_id", "unix_micros(ts) at", "cast(price as double) price", "agency", f"{active} active", f"to_json(struct({', '.join(details)})) details" if details else "cast(null as string) details")
    return rows.groupBy("listing_id").transformWithStateInPandas(_Kinds(), KINDS, "Append", "None")


BURSTS = "key long, sent_at timestamp, n long, last long"


class _Bursts(StatefulProcessor):
    """Open bursts of a key, and a timer for when the next of them goes out: a key with many open bursts is called once for all that are due."""

    def __init__(self, quiet_s: int, sweep_s: int):
        self.quiet, self.sweep = quiet_s * 1_000_000, sweep_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "bursts string")

    def _sent(self, burst: list[int]) -> int:
        return min((burst[0] // self.sweep + 1) * self.sweep, burst[1] + self.quiet)

    def _timer(self, burst: list[int]) -> int:
        return -(-self._sent(burst) // 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        held = json.loads(self.open.get()[0]) if self.open.exists() else []
        # A burst: its first and last moment, its number, and the moment and value of its last state.
        merged: list[list[int]] = []
        for b in sorted(held + [[at, at, 1, at, last] for at, last in zip(new["at"].tolist(), new["last"].tolist(), strict=True)]):
            if merged and b[0] // self.sweep == merged[-1][0] // self.sweep and b[0] - merged[-1][1] <= self.quiet:
                a = merged[-1]
                merged[-1] = [a[0], max(a[1], b[1]), a[2] + b[2], *max(a[3:], b[3:])]
            else:
                merged.append(b)
        before, now = min(map(self._timer, held), default=None), min(map(self._timer, merged))
        if before != now:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(now)
        self.open.update((json.dumps(merged),))
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        held = json.loads(self.open.get()[0]) if self.open.exists() else []
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        due = [b for b in held if self._timer(b) <= now]
        rest = [b for b in held if self._timer(b) > now]
        if rest:
            self.open.update((json.dumps(rest),))
            self.handle.registerTimer(min(map(self._timer, rest)))
        else:
            self.open.clear()
        if due:
            yield pd.DataFrame({"key": key[0], "sent_at": pd.to_datetime([self._sent(b) for b in due], unit="us"), "n": [b[2] for b in due], "last": [b[4] for b in due]})

    def close(self) -> None:
        pass


def burst_stream(changes: DataFrame, key: str, at: str, last: str, quiet_s: int = QUIET_S, sweep_s: int = SWEEP_S, late: str = "0 seconds") -> DataFrame:
    """(key, sent_at, n, last) of each burst once the stream's time has passed the moment when it goes out; the bursts of ``outbox.bursts``.

    Changes of a key less than ``quiet_s`` apart go out once, or at the next
    sweep. A key has a timer for its next burst; state and timers outlive a restart.
    Changes may come in any order as far as ``late``; later ones are left out.
    """
    keeps_state(changes.sparkSession)
    rows = changes.where(F.col(at).isNotNull()).withWatermark(at, late).select(F.col(key).cast("long").alias("key"), F.col(at), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.col(last).cast("long").alias("last"))
    return rows.groupBy("key").transformWithStateInPandas(_Bursts(quiet_s, sweep_s), BURSTS, "Append", "EventTime")


def keeps_state(spark: SparkSession) -> None:
    """Timers and state of one's own ask for the state store on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_to(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over all that is there, into Parquet files at ``path``; the next call goes on from its checkpoint."""
    rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def windowed_counts(versions: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Versions by window and agency; those later than ``late`` are left out. (The engine's own addition.)"""
    return versions.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "agency").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "agency", "n")


def outbox(versions: DataFrame, deliver: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True):
    """Starts a query that hands the latest row of each dirty listing of a batch to ``deliver``.

    ``deliver`` may get a batch again after a failure and should be idempotent by batch id.
    """
    columns = [c for c in versions.columns if c != "listing_id"]
    each = lambda df, batch: deliver(best_of_each(df, ["listing_id"], F.struct("ts", "event_id"), columns), batch)
    writer = versions.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="2 seconds")).start()


def version_stream(spark: SparkSession, path: str, files_at_once: int = 1) -> DataFrame:
    return spark.readStream.schema(VERSION).option("maxFilesPerTrigger", files_at_once).parquet(path)
