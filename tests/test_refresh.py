"""Incremental summaries against a full refresh."""

import random

from pyspark.sql import functions as F

from parcelflow.operators.refresh import Summary

SCHEMA = "id int, zone string, kind string, cents long, unit string"


def full(rows):
    out = {}
    for _, z, k, c, u in rows:
        n = out.setdefault((z, k), [0, 0, []])
        n[0] += 1
        n[1] += c or 0
        n[2] += [u] if u is not None else []
    return sorted(((*k, n, s, len(set(u)), min(u, default=None), max(u, default=None)) for k, (n, s, u) in out.items()), key=repr)


def test_refresh_equals_a_full_one(spark, tmp_path):
    rng = random.Random(9)
    row = lambda i: (i, rng.choice("abcdefgh") if rng.random() < 0.95 else None, rng.choice(("x", "y")), rng.choice((None, i * 7)), rng.choice((None, *(f"u{j}" for j in range(9)))))
    rows = {i: row(i) for i in range(300)}
    s = Summary(spark, str(tmp_path / "summary"), ["zone", "kind"], ["cents"], ["unit"], folders=16)
    df = lambda r: spark.createDataFrame(list(r), SCHEMA)
    got = lambda: sorted((tuple(r) for r in s.read().collect()), key=repr)
    s.build(df(rows.values()))
    assert got() == full(rows.values())
    for step in range(4):
        gone = [rows.pop(i) for i in rng.sample(sorted(rows), 60)]
        if step == 1:
            # A whole zone goes, and with it some folders.
            gone += [rows.pop(i) for i in [i for i, r in rows.items() if r[1] == "a"]]
        changed = [(old, (old[0], old[1], old[2], 5, "u8")) for old in (rows[i] for i in rng.sample(sorted(rows), 20))]
        new = [row(1000 * (step + 1) + i) for i in range(30)]
        rows |= {r[0]: r for r in new} | {r[0]: r for _, r in changed}
        s.refresh(df(new + [b for _, b in changed]), df(gone + [a for a, _ in changed]))
        assert got() == full(rows.values())
    s.refresh(df([]), df(rows.values()))
    assert got() == []
    s.refresh(df([]), df([]))


def test_refresh_reads_changed_folders_alone(spark, tmp_path):
    s = Summary(spark, str(tmp_path / "summary"), ["zone"], [], ["unit"], folders=32)
    rows = spark.range(1000).select(F.col("id").cast("string").alias("zone"), F.lit("u").alias("unit"))
    s.build(rows)
    times = lambda: {p.name: max(f.stat().st_mtime_ns for f in p.glob("*.parquet")) for p in (tmp_path / "summary").glob("folder=*")}
    before = times()
    s.refresh(rows.limit(0), rows.where("zone = '17'"))
    after = times()
    assert sum(before[k] != after[k] for k in before) == 1 and s.read().count() == 999
