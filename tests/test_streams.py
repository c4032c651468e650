"""Streams with state and timers against the batch over the same rows, with restarts in between."""

import datetime
import random

from pyspark.sql import functions as F

from parcelflow.operators import changes as CH
from parcelflow.operators import outbox
from parcelflow.streaming import changes as S

T0 = datetime.datetime(2024, 1, 1)


def fed(spark, make, schema, parts, folder):
    """A stream over files that come part by part, run and stopped after each."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        S.run_to(make(spark.readStream.schema(schema).parquet(f"{folder}/in")), f"{folder}/out", f"{folder}/check")
    return spark.read.parquet(f"{folder}/out")


def test_kinds_of_a_stream(spark, tmp_path):
    rng = random.Random(1)
    schema = "listing_id long, event_id long, ts timestamp, price double, agency string, is_active boolean, rooms int, notes string"
    rows = [(rng.randrange(12), i, T0 + datetime.timedelta(seconds=i), rng.choice((None, 1.0, 2.0)), rng.choice((None, "a", "b")), rng.choice((None, True, False)), rng.choice((1, 1, None)), rng.choice(("x", "x", "y"))) for i in range(300)]
    got = fed(spark, lambda v: S.change_stream(v, ["rooms", "notes"]), schema, [rows[:80], rows[80:81], rows[81:220], rows[220:]], tmp_path)
    want = CH.with_change_kind(spark.createDataFrame(rows, schema), "listing_id", ["ts", "event_id"], ["rooms", "notes"]).select("listing_id", "event_id", "kind")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
    assert got.count() == 300 and {r["kind"] for r in got.select("kind").distinct().collect()} == {"new", "reactivated", "agency_change", "price_change", "updated", None}


def test_late_versions_move_nothing(spark, tmp_path):
    at = lambda s: T0 + datetime.timedelta(seconds=s)
    rows = [(1, 1, at(10), 1.0, "a")], [(1, 2, at(5), 9.0, "z"), (1, 3, at(11), 2.0, "a")]
    got = fed(spark, S.change_stream, S.VERSION, rows, tmp_path)
    assert {(r["event_id"], r["kind"]) for r in got.collect()} == {(1, "new"), (2, "late"), (3, "price_change")}


def test_bursts_of_a_stream(spark, tmp_path):
    rng = random.Random(2)
    schema = "listing_id long, event_id long, ts timestamp"
    moments = sorted(rng.choice((rng.uniform(0, 400), 50 + rng.uniform(0, 15), 118 + rng.uniform(0, 4))) for _ in range(250))
    rows = [(rng.randrange(5), i, T0 + datetime.timedelta(microseconds=int(s * 1e6))) for i, s in enumerate(moments)]
    # Out of order within a part; a change far ahead moves the stream's time past all that is open.
    parts = [rows[:90], rows[90:91], rows[91:160], rows[160:], [(99, 10**6, T0 + datetime.timedelta(hours=1))]]
    for p in parts:
        rng.shuffle(p)
    got = fed(spark, lambda v: S.burst_stream(v, "listing_id", "ts", "event_id"), schema, parts, tmp_path)
    want = outbox.bursts(spark.createDataFrame(rows, schema), "listing_id", "ts", F.col("event_id"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert want.where("n > 3").count() > 3


def test_a_key_is_called_once_for_all_its_due_bursts():
    import json
    from types import SimpleNamespace

    import pandas as pd

    timers, kept = set(), []
    state = SimpleNamespace(exists=lambda: bool(kept), get=lambda: kept[-1], update=kept.append, clear=kept.clear)
    handle = SimpleNamespace(getValueState=lambda *a: state, registerTimer=timers.add, deleteTimer=timers.discard)
    bursts = S._Bursts(2, 60)
    bursts.init(handle)
    list(bursts.handleInputRows((1,), iter([pd.DataFrame({"at": [i * 10_000_000 for i in range(100)], "last": range(100)})]), None))
    assert len(json.loads(kept[-1][0])) == 100 and timers == {2000}
    # The stream's time is past the first ninety: they go out together, and a timer stands for the next.
    due = list(bursts.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 895_000), SimpleNamespace(getExpiryTimeInMs=lambda: 2000)))
    assert [len(d) for d in due] == [90] and timers == {2000, 902_000} and len(json.loads(kept[-1][0])) == 10


def test_kinds_of_many_small_batches_take_little_time():
    """A listing's few versions cost no frames of their own, and kinds are those of the versions in order of time."""
    import time

    import pandas as pd

    from parcelflow.streaming import changes

    class State:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    frame = lambda *rows: pd.DataFrame(rows, columns=["at", "event_id", "agency", "price", "active", "details"])
    p = changes._Kinds()
    p.last = State()
    got = next(p.handleInputRows((7,), iter([frame((20, 2, "a", 1.0, False, "x"), (10, 1, None, float("nan"), True, None)), frame((30, 3, "a", 2.0, True, "x"))]), None))
    assert got.values.tolist() == [[7, 1, "new"], [7, 2, "updated"], [7, 3, "reactivated"]]
    got = next(p.handleInputRows((7,), iter([frame((40, 5, "b", 3.0, True, "x"), (25, 4, "c", 9.0, True, "x"), (50, 6, "b", 4.0, True, "y"), (60, 7, "b", 4.0, True, None), (70, 8, "b", 4.0, True, None))]), None))
    assert got["kind"].tolist() == ["late", "agency_change", "price_change", "updated", None]
    got = next(p.handleInputRows((7,), iter([frame((1, 9, "z", 1.0, False, None))]), None))
    assert got["kind"].tolist() == ["late"] and p.last.value == (70, "b", 4.0, True, None)
    one = frame(*((i, i, "a", float(i % 3), True, str(i)) for i in range(30)))
    began = time.process_time()
    for _ in range(500):
        p.last = State()
        list(p.handleInputRows((1,), iter([one]), None))
    assert time.process_time() - began < 1.0
