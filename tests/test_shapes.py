"""Shapes of several rings, and borders that stay shared."""

import math
import random
import time
from collections import Counter

from pyspark.sql import functions as F

from parcelflow.functions import geo
from parcelflow.operators import edges, spatial, topology
from parcelflow.plans import queries, shapes
from parcelflow.sources import packages

RINGS = "rings array<array<struct<lat: double, lon: double>>>"


def wiggly(rng, a, b, n):
    """Corners between two lattice corners, none on the line."""
    return [(a[0] + (b[0] - a[0]) * i / (n + 1) + rng.gauss(0, 1e-4), a[1] + (b[1] - a[1]) * i / (n + 1) + rng.gauss(0, 1e-4)) for i in range(1, n + 1)]


def lattice(seed, size):
    """A lattice of shapes with bent borders; one has an islet that another shape is."""
    rng = random.Random(seed)
    border = {}

    def line(a, b):
        key = (min(a, b), max(a, b))
        if key not in border:
            border[key] = wiggly(rng, *key, rng.randint(0, 12))
        return [a, *(border[key] if a < b else border[key][::-1])]

    shapes = []
    for i in range(size):
        for j in range(size):
            c = [(i, j), (i, j + 1), (i + 1, j + 1), (i + 1, j)]
            c = c if (i + j) % 2 else c[::-1]
            ring = [p for k in range(4) for p in line(c[k], c[(k + 1) % 4])]
            turn = rng.randrange(len(ring))
            shapes.append((i * size + j, [ring[turn:] + ring[:turn]]))
    islet = [(0.5 + 0.2 * math.cos(t / 9 * math.pi), 0.5 + 0.2 * math.sin(t / 9 * math.pi)) for t in range(18)]
    shapes[0][1].append([*islet, islet[0]])
    shapes.append((999, [islet[7:] + islet[:7]]))
    return [(k, [[tuple(map(float, p)) for p in r] for r in rings]) for k, rings in shapes]


def sides(ring):
    return {frozenset((a, b)) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)}


def test_neighbours_keep_one_border(spark):
    shapes = lattice(5, 5)
    df = spark.createDataFrame(shapes, f"id int, {RINGS}").repartition(4)
    for metres in (0.0, 8.0, 100_000.0):
        got = {r["id"]: [[tuple(p) for p in ring] for ring in r["rings"]] for r in topology.simplified_together(df, "id", metres).collect()}
        assert got.keys() == {k for k, _ in shapes}
        count = {}
        for k, rings in got.items():
            assert all(len(r) >= 3 and len(set(r)) == len(r) for r in rings)
            for r in rings:
                for s in sides(r):
                    count[s] = count.get(s, 0) + 1
        # Each side inside the lattice is of two shapes; one at its rim is of one, and lies there.
        rim = lambda p: any(x < 0.001 or x > 4.999 for x in p)
        assert all(n == 2 or n == 1 and all(rim(p) for p in s) for s, n in count.items())
        before = sum(len(r) for _, rings in shapes for r in rings)
        after = sum(len(r) for rings in got.values() for r in rings)
        assert after == before - 1 if metres == 0 else after < before
    # At the widest only junctions stay, and three corners of rings that have none.
    assert len(got[999][0]) == 3 and len(got[12][0]) == 4


def test_dropped_corners_lie_near():
    import numpy as np

    rng = random.Random(1)
    for _ in range(50):
        n = rng.randint(2, 60)
        lat = np.cumsum([rng.gauss(0, 1e-4) for _ in range(n)])
        lon = np.arange(n) * 1e-4
        keep = np.flatnonzero(topology.kept_corners(lat, lon, 15.0, 0))
        assert keep[0] == 0 and keep[-1] == n - 1
        k = math.cos(math.radians(lat.mean()))
        x, y = np.radians(lon) * k * 6_371_000, np.radians(lat) * 6_371_000
        for a, b in zip(keep, keep[1:]):
            for i in range(a + 1, b):
                t = max(0, min(1, ((x[i] - x[a]) * (x[b] - x[a]) + (y[i] - y[a]) * (y[b] - y[a])) / ((x[b] - x[a]) ** 2 + (y[b] - y[a]) ** 2)))
                assert math.hypot(x[a] + t * (x[b] - x[a]) - x[i], y[a] + t * (y[b] - y[a]) - y[i]) <= 15.0001


def test_odd_shapes(spark):
    rows = [(1, None), (2, []), (3, [[(0.0, 0.0), (1.0, 1.0)]]), (4, [[]]), (5, [[(0.0, 0.0), (0.0, 1.0), (1.0, 0.0), (0.0, 0.0)], []])]
    got = {r["id"]: r["rings"] for r in topology.simplified_together(spark.createDataFrame(rows, f"id int, {RINGS}"), "id", 1.0).collect()}
    assert got[1] is None and got[2] == [] and len(got[3][0]) == 2 and [len(r) for r in got[4]] == [0] and [len(r) for r in got[5]] == [3, 0]
    assert topology.simplified_together(spark.createDataFrame([], f"id int, {RINGS}"), "id", 1.0).count() == 0


def test_parts_through_well_known_binary(spark):
    square = lambda s, w, h: [(s, w), (s, w + h), (s + h, w + h), (s + h, w), (s, w)]
    parts = [[square(0.0, 0.0, 4.0), square(1.0, 1.0, 2.0)], [square(9.0, 9.0, 1.0)]]
    df = spark.createDataFrame([(1, parts), (2, None), (3, [])], "k int, parts array<array<array<struct<lat: double, lon: double>>>>")
    got = {r["k"]: r for r in df.withColumn("b", packages.wkb_multipolygon(F.col("parts"))).select("k", packages.wkb_parts(F.col("b")).alias("p"), packages.wkb_rings(F.col("b")).alias("r")).collect()}
    assert [[[tuple(c) for c in r] for r in p] for p in got[1]["p"]] == parts and got[2]["p"] is None and got[3]["p"] == []
    assert [[tuple(c) for c in r] for r in got[1]["r"]] == [parts[0][0], parts[1][0]]


def test_lattice_of_many_rows_keeps_its_bends(spark, tmp_path):
    # The rows around the seam of two strips, and some far beyond where a plain lattice would leave the equator.
    keys = [*range(29_940, 30_060), *range(60_000, 60_040), *range(900_000, 900_060)]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    got = {r["p_partkey"]: (r["corners"], r["rows"]) for r in queries()["GEO-09_shared_borders"](spark, str(tmp_path)).collect()}
    for k in keys:
        x, y = k % 20, k // 20
        s, n, w, e = ((x * 7 + y * 13) % 5 * 2, (x * 7 + (y + 1) * 13) % 5 * 2, (x * 11 + y * 3) % 5 * 2, ((x + 1) * 11 + y * 3) % 5 * 2)
        rows = 4 * y + 2 + (s > 5) * (y + s / 2000) + (n > 5) * (y + 1 + n / 2000) + (w > 5) * (y + 0.5) + (e > 5) * (y + 0.5)
        assert got[k] == (4 + sum(v > 5 for v in (s, n, w, e)), round(rows, 6)), k


def test_squares_that_just_miss_do_not_meet(spark, tmp_path):
    # Vector 8261 of the check's table, whose rounded place would meet, and a square that just meets where its rounded place would not.
    rows = [(1, 0, [-0.12972035, -0.1500013]), (2, 0, [0.1, 0.1499996]), (3, 0, [0.16, 0.0]), (4, 0, [0.0, 0.0])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["vec_id"]: r["meets"] for r in queries()["GEO-07_08_polygons"](spark, str(tmp_path)).collect()}
    assert got == {1: False, 2: True, 3: False, 4: True}


def test_a_ring_is_made_once_however_many_corners(spark):
    ring = F.array(*(F.struct((F.col("id") + x).cast("double").alias("lat"), (F.col("id") * 0.71625 + y).alias("lon")) for x, y in ((0, 0), (0, 1), (1, 1), (1, 0))))
    plan = spark.range(1).select(geo.simplified(ring, 3.0).alias("r"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("0.71625") == 4


def rough(rng, lat, lon, r, n):
    """A ring of n corners around a place."""
    return [(lat + r * rng.uniform(0.3, 1) * math.sin(2 * math.pi * i / n), lon + r * rng.uniform(0.3, 1) * math.cos(2 * math.pi * i / n)) for i in range(n)]


def test_points_meet_shapes_in_leaves_and_blocks(spark, monkeypatch):
    """Slanted and upright edges, holes, parts, points on borders and too many in one place, over leaves, blocks and batches of any size: the rows of all pairs held against all rings."""
    rng = random.Random(6)
    shapes = [(f"s{i}", [rough(rng, rng.uniform(-0.02, 0.02), rng.uniform(-0.02, 0.02), 10 ** rng.uniform(-3, -1.5), rng.randint(3, 9)) for _ in range(rng.randint(1, 3))]) for i in range(40)]
    square = [(0.0, 0.0), (0.0, 0.01), (0.01, 0.01), (0.01, 0.0)]
    shapes += [("box", [square]), ("frame", [[(-1.0, -1.0), (-1.0, 1.0), (1.0, 1.0), (1.0, -1.0)], square]), ("none", None), ("empty", []), ("hollow", [[], square, None]), ("line", [[(0.0, 0.0), (0.0, 0.01)]]), ("globe", [[(-80.0, -170.0), (-80.0, 170.0), (80.0, 170.0), (80.0, -170.0)]]), ("twice", [square]), ("twice", [square])]
    pts = [(i, rng.gauss(0, 0.01), rng.gauss(0, 0.01)) for i in range(300)] + [(1000 + i, 0.004, 0.003) for i in range(50)]
    pts += [(2000, 0.0, 0.0), (2001, 0.01, 0.005), (2002, 0.005, 0.01), (2003, 0.0, 0.005), (2004, 50.0, 100.0), (2005, None, 0.0), (2006, 0.0, float("nan"))]
    points, parcels = spark.createDataFrame(pts, "i long, lat double, lon double"), spark.createDataFrame(shapes, f"p string, {RINGS}")
    kept = parcels.withColumn("rings", F.filter("rings", lambda r: F.size(r) > 0)).crossJoin(points.where("not isnan(lon)")).where(geo.in_rings(F.col("lat"), F.col("lon"), F.col("rings")))
    want = sorted(tuple(r) for r in kept.select("i", "p").collect())
    monkeypatch.setattr(spatial, "PARCELS_EACH", 9)
    monkeypatch.setattr(spatial, "UNITS_EACH", 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for most in (12, 10**9):
            got = sorted(tuple(r) for r in spatial.in_parcels(points, parcels, "i", "p", most=most).collect())
            assert got == want and len(got) > 2000
            numbers = {r["p"]: r["points"] for r in spatial.count_in_parcels(points, parcels, "i", "p", most=most).collect()}
            assert numbers == Counter(p for _, p in want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert spatial.in_parcels(points.limit(0), parcels, "i", "p").count() == spatial.count_in_parcels(points, parcels.limit(0), "i", "p").count() == 0


def test_no_edge_is_asked_row_by_row(spark):
    points = spark.range(10).selectExpr("id as i", "0.001 * id as lat", "0.001 * id as lon")
    parcels = spark.createDataFrame([(1, [[(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0)]])], f"p int, {RINGS}")
    plan = spatial.in_parcels(points, parcels, "i", "p")._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan


def test_a_task_asks_many_pairs_at_once():
    """Five million pairs of points and shapes take a task well under a second; row by row they took some 25."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    n, k = 1000, 5000
    south, west = rng.random((2, k)) - 0.5
    corners = np.stack([south, south + 0.4, west, west, south + 0.4, south, west + 0.4, west + 0.4], axis=1)
    shapes = pa.RecordBatch.from_arrays([pa.array([0] * k), pa.array([0] * k), pa.nulls(k, pa.int64()), *(pa.nulls(k, pa.float64()) for _ in "xy"), pa.array(range(k)), pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype="i4") * 8), pa.array(corners.ravel()))], list("abcdefg"))
    lat, lon = rng.random((2, n))
    points = pa.RecordBatch.from_arrays([pa.array([0] * n), pa.array([0] * n), pa.array(range(n)), pa.array(lat), pa.array(lon), pa.nulls(n, pa.int64()), pa.nulls(n, shapes.schema.field("g").type)], list("abcdefg"))
    began = time.process_time()
    held = sum(len(b.column(1).values) for b in edges.held(iter([points, shapes]), True))
    assert time.process_time() - began < 5
    inside = lambda x, low: (low[:, None] < x) & (x < low[:, None] + 0.4)
    assert held == (inside(lat, south) & inside(lon, west)).sum()


def test_parts_are_dealt_out_before_they_are_shapes(spark, sf_dir):
    """The file of all parts is read by one task or a few; shapes, and their well-known binary, are made by as many as shuffles have."""
    assert shapes._parcels(spark, sf_dir).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_points_of_parts_are_counted_without_pairs(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(spatial, "in_parcels", None)
    rows = queries()["SRC-07_GEO-04_shapes_of_parts"](spark, sf_dir)
    assert rows.count() == spark.read.parquet(f"{sf_dir}/part.parquet").count() and rows.agg(F.sum("points")).first()[0] > 0
