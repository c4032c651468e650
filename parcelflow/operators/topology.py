"""Simplification of neighbouring shapes by the arcs that they share."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_M
from .storage import stored


def kept_corners(lat: np.ndarray, lon: np.ndarray, metres: float, least: int) -> np.ndarray:
    """Which corners of an open line stay: the ends, and what lies over ``metres`` from the line between the corners kept around it.

    Of the others the farthest ones stay until there are ``least`` between the ends, as far as there are any.
    """
    n = len(lat)
    keep = np.zeros(n, dtype=bool)
    keep[[0, n - 1]] = True
    k = math.cos(math.radians(float(lat.mean())))
    x, y = np.radians(lon) * k * EARTH_M, np.radians(lat) * EARTH_M
    spans, spare = [(0, n - 1)], []
    while spans or spare:
        if spans:
            a, b = spans.pop()
            forced = False
        elif keep.sum() - 2 < least:
            _, a, b = spare.pop(max(range(len(spare)), key=lambda i: spare[i][0]))
            forced = True
        else:
            break
        if b - a < 2:
            continue
        dx, dy = x[b] - x[a], y[b] - y[a]
        px, py = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
        length = dx * dx + dy * dy
        t = np.clip((px * dx + py * dy) / length, 0, 1) if length else np.zeros(b - a - 1)
        far = np.hypot(px - t * dx, py - t * dy)
        i = int(far.argmax())
        if forced or far[i] > metres:
            keep[a + 1 + i] = True
            spans += [(a, a + 1 + i), (a + 1 + i, b)]
        else:
            spare.append((float(far[i]), a, b))
    return keep


def _open(ring: Column) -> Column:
    """A ring whose first corner is not said again at its end."""
    n = F.size(ring)
    return F.when((n > 1) & (F.element_at(ring, 1) == F.element_at(ring, -1)), F.slice(ring, F.lit(1), n - 1)).otherwise(ring)


def simplified_together(shapes: DataFrame, id_col: str, metres: float, rings_col: str = "rings") -> DataFrame:
    """``shapes`` (ids are unique) with simpler ``rings_col``; neighbours keep one and the same border.

    Rings are cut at the corners where borders part, which are those that
    have other neighbours in one ring than in another. Each of the arcs between
    them is simplified once, whichever shapes it is of, and keeps its ends, so no gap and no
    overlap opens; a corner that is dropped lies within ``metres`` of its
    arc's new line. Rings keep three corners. Arcs may come to cross others: their number of corners is not enough to
    rule that out. Rings come without their first corner again at the end; those
    of under three corners, and null shapes, stay as they are. Corners are shared if their coordinates are equal.

    A shape is one row's value; corners, arcs and shapes are dealt out by hashes.
    """
    one = shapes.select(F.col(id_col).alias("id"), F.posexplode(rings_col).alias("ring_no", "ring")).withColumn("ring", _open(F.col("ring")))
    rings = stored(one.where(F.size("ring") >= 3), "rings")
    n = F.size("ring")
    corner = lambda i: F.get("ring", F.pmod(i, n))
    around = rings.select("id", "ring_no", F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("i"), corner(i).alias("p"), F.least(corner(i - 1), corner(i + 1)).alias("a"), F.greatest(corner(i - 1), corner(i + 1)).alias("b")))).alias("x")).select("id", "ring_no", "x.*")
    sides = F.struct("a", "b")
    parting = stored(around.groupBy("p").agg(F.min(sides).alias("low"), F.max(sides).alias("high")).where("low <> high").select("p"), "junctions")
    cuts = around.select("id", "ring_no", "i", "p").join(parting, "p").groupBy("id", "ring_no").agg(F.array_sort(F.collect_list("i")).alias("cuts"))
    # A ring that parts from no other begins at its least corner, so that a hole and what fills it are cut alike.
    least = (F.array_position("ring", F.array_min("ring")) - 1).cast("int")
    cut = rings.join(cuts, ["id", "ring_no"], "left").withColumn("cuts", F.coalesce("cuts", F.array(least)))
    turned = cut.withColumn("first", F.get("cuts", F.lit(0))).withColumn("ring", F.concat(F.slice("ring", F.col("first") + 1, n), F.slice("ring", F.lit(1), F.col("first") + 1)))
    ends = turned.withColumn("cuts", F.concat(F.transform("cuts", lambda c: c - F.col("first")), F.array(F.size("ring") - 1)))
    n_arcs = F.size("cuts") - 1
    arc = lambda k: F.slice("ring", F.get("cuts", k) + 1, F.get("cuts", k + 1) - F.get("cuts", k) + 1)
    arcs = ends.select("id", "ring_no", n_arcs.alias("n_arcs"), F.posexplode(F.transform(F.sequence(F.lit(0), n_arcs - 1), arc)).alias("k", "arc"))
    back = F.reverse("arc")
    arcs = stored(arcs.withColumn("turned", F.col("arc") > back).withColumn("arc", F.least("arc", back)), "arcs")
    once = arcs.groupBy("arc").agg(F.min("n_arcs").alias("n_arcs"))

    def simplify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for lat, lon, few in zip(b["lat"], b["lon"], b["n_arcs"], strict=True):
                lat, lon = np.asarray(lat, dtype=float), np.asarray(lon, dtype=float)
                # A ring of one arc needs two corners beside its end, one of two arcs needs one in each.
                keep = kept_corners(lat, lon, metres, max(0, 3 - few))
                out.append(np.flatnonzero(keep).tolist())
            yield pd.DataFrame({"key": b["key"], "kept": out})

    keyed = stored(once.withColumn("key", F.monotonically_increasing_id()), "arcs-once")
    lines = keyed.select("key", "n_arcs", F.col("arc.lat").alias("lat"), F.col("arc.lon").alias("lon")).mapInPandas(simplify, "key long, kept array<int>")
    simple = keyed.join(lines, "key").select("arc", F.transform("kept", lambda i: F.get("arc", i)).alias("line"))
    line = F.when(F.col("turned"), F.reverse("line")).otherwise(F.col("line"))
    pieces = arcs.join(simple, "arc").select("id", "ring_no", "k", F.slice(line, F.lit(1), F.size("line") - 1).alias("line"))
    ordered = lambda k, v: F.transform(F.array_sort(F.collect_list(F.struct(k, v))), lambda x: x[v])
    whole = pieces.groupBy("id", "ring_no").agg(F.flatten(ordered("k", "line")).alias("ring"))
    small = one.where(F.size("ring") < 3).select("id", "ring_no", "ring")
    made = whole.unionByName(small).groupBy("id").agg(ordered("ring_no", "ring").alias("_rings"))
    found = shapes.join(made.withColumnRenamed("id", "_id"), F.col(id_col) == F.col("_id"), "left")
    return found.select(*(F.coalesce("_rings", F.col(f"`{c}`")).alias(c) if c == rings_col else F.col(f"`{c}`") for c in shapes.columns))
