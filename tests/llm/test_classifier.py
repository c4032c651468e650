"""The quality classifier: scores recomputed pair by pair, pairs that matter, held-out accuracy, and odd rows."""

import math
import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from parcelflow.llm import classifier
from tests.llm.test_llm import LONG, ODD, none, odd  # noqa: F401


def brute_score(model, text, meta):
    """All features of a text by name, and each pair of them by itself."""
    words = Counter(zlib.crc32(w.encode()) % model.n_words for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ") if w)
    raw = {b: 1 + math.log(n) for b, n in words.items()}
    norm = math.sqrt(sum(x * x for x in raw.values()))
    x = {b: v / norm for b, v in raw.items()}
    scale = 1 / math.sqrt(model.cuts.size)
    stats = classifier.structure((text or "").encode(), Counter((text or "").encode().lower().split())) + [math.nan if meta is None else math.log1p(meta)]
    wide = model.cuts.shape[1] + 1
    for i, s in enumerate(stats):
        for k, cut in enumerate([*model.cuts[i], None]):
            if math.isnan(s) if cut is None else s >= cut:
                x[model.n_words + i * wide + k] = scale
    x[len(model.weights) - 1] = scale
    odds = model.bias + sum(model.weights[i] * v for i, v in x.items())
    odds += sum(float(model.factors[i] @ model.factors[j]) * x[i] * x[j] for i, j in combinations(x, 2))
    return 1 / (1 + math.exp(-odds))


def test_scores_pair_by_pair(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(("One", "two", "ünï", "x1,", "###", "end.\n")) for _ in range(rng.randint(0, 30))), rng.choice((None, i, 5 * i))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    labels = docs.selectExpr("doc_id", "int(text like '%###%') as quality")
    model = classifier.fit(docs, labels, steps=5, n_words=32)
    assert np.abs(model.weights).max() > 0.01
    got = {r["doc_id"]: r["score"] for r in classifier.score(docs, model).collect()}
    for i, text, n in rows:
        assert abs(got[i] - brute_score(model, text, n)) < 1e-9


def test_gradient(spark):
    """The gradient against differences of the loss."""
    reader = classifier.Reader(16)
    read = [(*reader.read(t)[:2], classifier._measures(reader.read(t)[2], [1.0])) for t in ("a b c", "", "b ! c d")]
    model = classifier.Model.blank(16, np.tile([0.2, 1.0], (classifier.N_STATS + 1, 1)), 3)
    y, w = np.array([1, 0, 1]), np.array([0.5, 0.2, 0.3])
    loss = lambda: float(-(w * np.where(y == 1, np.log(p := model.score(read)), np.log(1 - p))).sum())
    g, size = model.gradient(read, y, w), len(model.weights)
    for i in (*range(0, 16, 3), 20, size - 1):
        for f in range(3):
            model.factors[i, f] += 1e-5
            up = loss()
            model.factors[i, f] -= 2e-5
            down = loss()
            model.factors[i, f] += 1e-5
            assert abs((up - down) / 2e-5 - g[1 + size * (f + 1) + i]) < 1e-6


def test_pairs_of_features_matter(spark):
    """Good texts have exactly one of two words, which no sum over single features tells."""
    rows = [(i, "alpha " * (i & 1) + "beta " * (i >> 1 & 1) + f"word{i % 7}", 20) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    labels = docs.select("doc_id", (F.col("doc_id") % 4).isin(1, 2).cast("int").alias("quality"))
    model = classifier.fit(docs, labels, steps=80)
    hit = lambda m: sum((r["score"] >= 0.5) == (r["doc_id"] % 4 in (1, 2)) for r in classifier.score(docs, m).collect())
    assert hit(model) == 400
    model.factors[:] = 0
    assert hit(model) < 320


def test_quality_on_the_other_rows(spark):
    d = "/root/testdata/sf0.1"
    got = classifier.op12_quality_classifier(spark, d)
    rows = got.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert len(rows) > 900 and got.count() == spark.read.parquet(f"{d}/documents.parquet").count()
    rank = rows["score"].rank()
    n1, n0 = (rows["quality"] == 1).sum(), (rows["quality"] == 0).sum()
    assert (rank[rows["quality"] == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.995
    assert rows[rows["quality"] == 1]["predicted"].mean() > 0.98 and rows[rows["quality"] == 0]["predicted"].mean() < 0.05


def test_classifier_of_odd_rows(spark, odd, none):  # noqa: F811
    labels = spark.createDataFrame([(7, 1), (7, 1), (4, 0), (4, None), (None, 1), (99, 1), (1, 0)], "doc_id long, quality int")
    for meta in ((), ("rank",)):
        model = classifier.fit(odd, labels, meta_cols=meta, steps=3)
        got = classifier.score(odd, model, meta_cols=meta)
        assert got.count() == len(ODD) and got.where("score between 0 and 1").count() == len(ODD)
    assert classifier.score(none, model, meta_cols=("rank",)).count() == 0
    blank = classifier.fit(none, labels, meta_cols=())
    assert {r["score"] for r in classifier.score(odd, blank, meta_cols=()).collect()} == {0.5}
    only = classifier.fit(odd, labels.where("quality = 1"), meta_cols=())
    assert {round(r["score"], 3) for r in classifier.score(odd, only, meta_cols=()).collect()} == {0.667}


def test_copies_have_one_vote(spark):
    rows = [(i, f"good words are here {i}.", 25) for i in range(50)] + [(100 + i, f"bad ### $$$ {i}", 15) for i in range(50)] + [(1000 + i, "bad ### of thousands $$$", 15) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    labels = docs.select("doc_id", (F.col("doc_id") < 50).cast("int").alias("quality"))
    got = classifier.score(docs, classifier.fit(docs, labels)).selectExpr("sum(int((score >= 0.5) = (doc_id < 50))) as n").first()["n"]
    assert got == len(rows)
