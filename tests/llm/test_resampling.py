"""Importance resampling against plain Python, and on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

from parcelflow.llm import resampling
from tests.llm.test_llm import LONG, ODD, none, odd  # noqa: F401


def brute(docs, target, longest, n_buckets, least, percent, seed):
    def runs(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return w, [zlib.crc32(" ".join(w[i : i + n]).encode()) % n_buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(runs(x)[1])
    for x in target:
        t.update(runs(x)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + n_buckets) / ((s[b] + 1) * (t.total() + n_buckets)))) for b in range(n_buckets)]
    rows = []
    for i, x in docs:
        w, f = runs(x)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], -1 if r[0] is None else r[0]))
    drawn = {id(r): k for k, r in enumerate(able[: percent * len(able) // 100], 1)}
    return sorted(((*r, drawn.get(id(r))) for r in rows), key=repr)


def test_resampling_against_brute_force(spark):
    docs = [(i, " ".join(f"W{(i * k * k) % (17 + i % 5)} é{k % 7}" for k in range(i % 40))) for i in range(300)]
    docs += [(1, "one, two"), (1, "one, two"), (None, "a1 " * 25), (301, None), (302, "\0 \n"), (303, LONG), *[(400 + i, docs[39][1]) for i in range(200)]]
    target = ["W1 W2 é3 " * 9, None, "", "one two"]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    to = spark.createDataFrame([(x,) for x in target], "text string")
    for longest, n_buckets in ((1, 10_000), (3, 64)):
        got = resampling.resample(df, to, longest=longest, n_buckets=n_buckets, percent=37)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, target, longest, n_buckets, 20, 37, 2024)


def test_resampling_of_odd_rows(odd, none):  # noqa: F811
    got = resampling.resample(odd, odd.select("text"), percent=100).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["n_features"] for i in (1, 2, 3)] == [0, 0, 0] and by[1]["weight"] == 0 and by[1]["rank"] is None
    assert by[7]["n_words"] == 120_000 and by[7]["rank"] == 1 and by[None]["n_words"] == 4
    assert resampling.resample(none, odd.select("text")).count() == 0
    assert resampling.resample(odd, none.select("text")).count() == len(ODD)
    renamed = odd.withColumnRenamed("doc_id", "place").withColumnRenamed("text", "rank_")
    assert resampling.resample(renamed, renamed, id_col="place", text_col="rank_").columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]


def test_drawn_rows_lean_to_the_target(spark):
    rows = [(i, ("alpha beta " if i % 10 == 0 else "gamma delta ") * 15) for i in range(1000)]
    got = resampling.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("alpha beta " * 100,)], "text string"))
    drawn = [r["doc_id"] for r in got.where("rank is not null").collect()]
    assert len(drawn) == 100 and all(i % 10 == 0 for i in drawn)
