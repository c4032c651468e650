"""Hard negatives against plain Python, over blocks, ties, hot labels, huge numbers and odd rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelflow.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, anchor, low=50, high=95):
    v = [(i, lab, [math.floor(256 * x) for x in e]) for i, e, lab in rows if i is not None and lab is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, lab, a in v:
        if not anchor(i):
            continue
        s = [(-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=False)))), j, other) for j, other, b in v]
        for p, j, _ in sorted(x for x in s if x[2] == lab and x[1] != i)[:5]:
            able = sorted(x for x in s if x[2] != lab and low * -p <= 100 * -x[0] <= high * -p)[:3]
            out += [(i, j, k, n, -p, -q) for k, (q, n, _) in enumerate(able, 1)]
    return sorted(out)


def mined(spark, rows, step=3, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return sorted(tuple(r) for r in negatives.hard_negatives(df, F.col("vec_id") % step == 0, **more).collect())


@pytest.mark.parametrize("block", [65_536, 20])
def test_negatives_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "_ANCHORS", 7)
    rng = random.Random(block)
    rows = [(i, [rng.choice((-0.01, 0.0, 0.5, 0.25, rng.gauss(0, 1))) for _ in range(6)], rng.choice((0, 0, 0, 1, 2))) for i in range(150)]
    rows += [(200 + i, [0.5, 0.25, 0.0, 0.5, 0.5, 0.1], 0) for i in range(60)] + [rows[3], rows[3], (900, [0.5], 1), (903, [], 1), (906, [0.5] * 9, 2)]
    rows += [(None, [1.0] * 6, 1), (300, None, 1), (303, [1.0] * 6, None), (306, [1.0, None], 0), (309, [math.nan] * 6, 0), (312, [math.inf] * 6, 0)]
    got = mined(spark, rows, block=block)
    assert got == brute(rows, lambda i: i % 3 == 0) and len(got) > 300


def test_products_beyond_float64(spark):
    rows = [(i, [float(2**30 + i) / 256, (2.0**26 - i) / 256, -3.0 + i], i % 2) for i in range(30)] + [(50, [1e200, 1.0, 1.0], 0), (51, [1e200, -1e200, 0.0], 1)]
    assert mined(spark, rows, low=1, high=100) == brute(rows, lambda i: i % 3 == 0, 1, 100)
    a = np.array([[2.0**52, 1.0], [3.0, 2.0**40]])
    assert negatives.products(a, a).tolist() == [[2**63 - 1, 3 * 2**52 + 2**40], [3 * 2**52 + 2**40, 2**63 - 1]]
    assert negatives.products(a, a[:0]).shape == (2, 0)


def test_negatives_of_few_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 0)]) == mined(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == []
    assert mined(spark, [(0, [1.0], 0), (1, [1.0], 0), (2, [0.75], 1)]) == [(0, 1, 1, 2, 65536, 49152)]


def test_names_that_clash(spark):
    df = spark.createDataFrame([(0, [1.0], 0, 5), (1, [1.0], 0, 5), (2, [0.75], 1, 5)], "place long, vector array<float>, anchor int, label int")
    got = negatives.hard_negatives(df, F.col("place") == 0, id_col="place", vector_col="vector", label="anchor")
    assert [tuple(r) for r in got.collect()] == [(0, 1, 1, 2, 65536, 49152)]
