"""Points, distances and polygons as column expressions over degrees."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on a sphere; at most 0.5 % from the spheroid's; null if a coordinate is."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))


def in_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    return lat.between(south, north) & lon.between(west, east)


def in_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Whether a point lies in a polygon, an array of (lat, lon) corners, by the even-odd rule."""
    n = F.size(ring)
    edges = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(ring, i).alias("a"), F.get(ring, (i + 1) % n).alias("b")))
    crosses = lambda e: ((e["a"]["lat"] > lat) != (e["b"]["lat"] > lat)) & (lon < (e["b"]["lon"] - e["a"]["lon"]) * (lat - e["a"]["lat"]) / (e["b"]["lat"] - e["a"]["lat"]) + e["a"]["lon"])
    # Edges along the line of sight have no slope and are no crossings.
    level = lambda e: (e["a"]["lat"] > lat) == (e["b"]["lat"] > lat)
    return F.size(F.filter(edges, lambda e: F.when(level(e), F.lit(False)).otherwise(crosses(e)))) % 2 == 1


def in_rings(lat: Column, lon: Column, rings: Column) -> Column:
    """Whether a point lies in a shape of several rings, parts and holes alike, by the even-odd rule over all of them."""
    return F.aggregate(F.transform(rings, lambda r: in_ring(lat, lon, r)), F.lit(False), lambda a, x: a != x)


def edges_of(rings: Column) -> Column:
    """The edges of all rings of a shape that a line of sight along a parallel can cross, made ready once for ``within_edges``."""

    def of(ring: Column) -> Column:
        n = F.size(ring)
        edge = lambda a, b: F.struct(a["lat"].alias("a"), b["lat"].alias("b"), (b["lat"] - a["lat"]).alias("high"), (b["lon"] - a["lon"]).alias("wide"), a["lon"].alias("lon"))
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: edge(F.get(ring, i), F.get(ring, (i + 1) % n)))

    return F.filter(F.flatten(F.transform(rings, of)), lambda e: e["a"] != e["b"])


def within_edges(lat: Column, lon: Column, edges: Column) -> Column:
    """``in_rings`` over what ``edges_of`` gives."""
    crosses = lambda e: F.when((e["a"] > lat) != (e["b"] > lat), lon < e["wide"] * (lat - e["a"]) / e["high"] + e["lon"])
    return F.aggregate(edges, F.lit(False), lambda odd, e: odd != F.coalesce(crosses(e), F.lit(False)))


def centroid(ring: Column) -> Column:
    """(lat, lon) of a polygon's centre by the shoelace formula; the mean of corners without area."""
    n = F.size(ring)
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def step(acc: Column, i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, (i + 1) % n)
        c = a["lon"] * b["lat"] - b["lon"] * a["lat"]
        return F.struct((acc["s"] + c).alias("s"), (acc["x"] + (a["lon"] + b["lon"]) * c).alias("x"), (acc["y"] + (a["lat"] + b["lat"]) * c).alias("y"))

    mean = lambda f: F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[f]) / n
    out = lambda a: F.struct(F.coalesce(F.try_divide(a["y"], 3 * a["s"]), mean("lat")).alias("lat"), F.coalesce(F.try_divide(a["x"], 3 * a["s"]), mean("lon")).alias("lon"))
    return F.aggregate(F.sequence(F.lit(0), n - 1), zero, step, out)


def _columns_of(row: Column, size: float) -> Column:
    """Number of equal columns that a row of cells is cut into: as many as leave each as wide as ``size`` at the highest latitude of the row and those beside it."""
    worst = F.least(F.lit(90.0), (F.greatest(F.abs(row), F.abs(row + 1)) + 1) * size)
    share = F.sin(F.radians(F.lit(size)) / 2) / F.cos(F.radians(worst))
    return F.when((worst >= 90) | (share >= 1), F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(math.pi / F.asin(F.least(F.lit(1.0), share))))).cast("long")


def cells_around(lat: Column, lon: Column, metres: float) -> Column:
    """The grid cells around a point that may hold what is within ``metres``: (r, c) and the part of each that is near, from 0 to 1 a side.

    Rows of cells are as high as ``metres``; each is cut into columns around
    the whole circle that are at least as wide at its own latitude. So a
    point's neighbours are in its cell or those around it, across the date
    line too; near a pole a row is one cell.
    """
    size = math.degrees(metres / EARTH_M)
    clip = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    u, slack = lat / size, 1 + 1e-9

    def row(i: int) -> Column:
        r = F.floor(u).cast("long") + i
        n = _columns_of(r, size)
        v = (lon + 180) / 360 * n
        left = F.floor(v).cast("long")
        near = lambda j: F.struct(r.alias("r"), F.pmod(left + j, n).alias("c"), clip(u - slack - r).alias("lu"), clip(u + slack - r).alias("hu"), clip(v - slack - left - j).alias("lv"), clip(v + slack - left - j).alias("hv"))
        whole = F.transform(F.sequence(F.lit(0).cast("long"), F.least(n, F.lit(3)) - 1), lambda c: F.struct(r.alias("r"), c.alias("c"), clip(u - slack - r).alias("lu"), clip(u + slack - r).alias("hu"), F.lit(0.0).alias("lv"), F.lit(1.0).alias("hv")))
        return F.when(n <= 3, whole).otherwise(F.array(*(near(F.lit(j)) for j in (-1, 0, 1))))

    return F.concat(*(row(i) for i in (-1, 0, 1)))


def cell_of(lat: Column, lon: Column, metres: float) -> Column:
    """A point's own cell (r, c) on that grid, and where it lies in it (fu, fv)."""
    size = math.degrees(metres / EARTH_M)
    r = F.floor(lat / size).cast("long")
    n = _columns_of(r, size)
    v = (lon + 180) / 360 * n
    return F.struct(r.alias("r"), F.pmod(F.floor(v).cast("long"), n).alias("c"), (lat / size - r).alias("fu"), (v - F.floor(v)).alias("fv"))


def simplified(ring: Column, metres: float) -> Column:
    """A ring without corners that lie within ``metres`` of the line between the last kept corner and the next one; at least three stay.

    One pass, for output only: corners are dropped, none moves.
    """

    def off(a: Column, p: Column, b: Column) -> Column:
        """Metres of p from the line through a and b, on a plane around p."""
        k = F.cos(F.radians(p["lat"]))
        x = lambda q: F.radians(q["lon"] - p["lon"]) * k * EARTH_M
        y = lambda q: F.radians(q["lat"] - p["lat"]) * EARTH_M
        # The four numbers are bound once, as each is used several times.
        plane = F.struct(x(a).alias("xa"), y(a).alias("ya"), x(b).alias("xb"), y(b).alias("yb"))
        length = lambda q: F.sqrt(F.pow(q["xb"] - q["xa"], 2) + F.pow(q["yb"] - q["ya"], 2))
        far = lambda q: F.when(q["length"] > 0, F.abs(q["q"]["xa"] * q["q"]["yb"] - q["q"]["xb"] * q["q"]["ya"]) / q["length"]).otherwise(F.sqrt(F.pow(q["q"]["xa"], 2) + F.pow(q["q"]["ya"], 2)))
        return _bound(_bound(plane, lambda q: F.struct(q.alias("q"), length(q).alias("length"))), far)

    def kept_of(ring: Column) -> Column:
        n = F.size(ring)

        def step(kept: Column, i: Column) -> Column:
            p, after = F.get(ring, i), F.get(ring, (i + 1) % n)
            bend = off(F.element_at(kept, -1), p, after) > metres
            # The corners still to come and those kept have to make three.
            return F.when(bend | (F.size(kept) + (n - i - 1) < 3), F.concat(kept, F.array(p))).otherwise(kept)

        return F.when(n <= 3, ring).otherwise(F.aggregate(F.sequence(F.lit(1), n - 1), F.slice(ring, 1, 1), step))

    # A ring that is made by the row would be made again for each corner that is looked at.
    return _bound(ring, kept_of)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def grid(south: float, west: float, north: float, east: float, step_m: float, spark) -> DataFrame:
    """Centres of a regular grid over a box, at least one."""
    dlat = math.degrees(step_m / EARTH_M)
    dlon = dlat / math.cos(math.radians((south + north) / 2))
    rows, cols = max(1, math.ceil((north - south) / dlat)), max(1, math.ceil((east - west) / dlon))
    cells = spark.range(rows * cols)
    i, j = F.floor(F.col("id") / cols), F.col("id") % cols
    return cells.select(F.col("id").alias("cell"), (F.lit(south) + (i + 0.5) * dlat).alias("lat"), (F.lit(west) + (j + 0.5) * dlon).alias("lon"))


def grid_over(boxes: DataFrame, step_m: float) -> DataFrame:
    """``boxes`` (south, west, north, east beside other columns) with the cells of a regular grid over each, a row a cell, at least one.

    cell counts row by row from the south-west; lat and lon are its centre;
    rows, cols, dlat and dlon say how the grid lies.
    """
    dlat = math.degrees(step_m / EARTH_M)
    dlon = F.lit(dlat) / F.cos(F.radians((F.col("south") + F.col("north")) / 2))
    many = lambda low, high, d: F.greatest(F.lit(1), F.ceil((F.col(high) - F.col(low)) / d)).cast("long")
    sized = boxes.withColumns({"dlat": F.lit(dlat), "dlon": dlon}).withColumns({"rows": many("south", "north", F.col("dlat")), "cols": many("west", "east", F.col("dlon"))})
    cells = sized.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") * F.col("cols") - 1)))
    return cells.withColumns({"lat": F.col("south") + (F.floor(F.col("cell") / F.col("cols")) + 0.5) * F.col("dlat"), "lon": F.col("west") + (F.col("cell") % F.col("cols") + 0.5) * F.col("dlon")})


def mercator(lat: Column, lon: Column) -> Column:
    r = 6_378_137.0
    return F.struct((F.radians(lon) * r).alias("x"), (F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * r).alias("y"))


def tile(lat: Column, lon: Column, zoom: int) -> Column:
    n = 1 << zoom
    y = (1 - F.log(F.tan(F.radians(lat)) + 1 / F.cos(F.radians(lat))) / math.pi) / 2
    return F.struct(F.floor((lon + 180) / 360 * n).alias("x"), F.floor(y * n).alias("y"))


def pin_doubts(lat: Column, lon: Column, mid_lat: Column, mid_lon: Column) -> Column:
    """Reasons to doubt a pin: near the area's centre, few decimals, trailing zeros, equal coordinates."""
    decimals = lambda x: F.length(F.regexp_replace(F.regexp_extract(x.cast("string"), r"\.(\d+)", 1), "0+$", ""))
    zeros = lambda x: F.format_string("%.6f", x).rlike("000$")
    found = F.array(
        F.when(haversine(lat, lon, mid_lat, mid_lon) <= 50, "centre"),
        F.when((decimals(lat) < 4) | (decimals(lon) < 4), "few_decimals"),
        F.when(zeros(lat) | zeros(lon), "trailing_zeros"),
        F.when(F.abs(lat) == F.abs(lon), "equal_coordinates"),
    )
    return F.array_compact(found)


def rings_meet(a: Column, b: Column) -> Column:
    """Whether two polygons share a point: two edges cross or touch, or one holds a corner of the other."""

    def edges(ring: Column) -> Column:
        n = F.size(ring)
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(ring, i).alias("p"), F.get(ring, (i + 1) % n).alias("q")))

    def side(p: Column, q: Column, r: Column) -> Column:
        return F.signum((q["lon"] - p["lon"]) * (r["lat"] - p["lat"]) - (q["lat"] - p["lat"]) * (r["lon"] - p["lon"]))

    def overlap(x: Column, y: Column, f: str) -> Column:
        return (F.least(x["p"][f], x["q"][f]) <= F.greatest(y["p"][f], y["q"][f])) & (F.least(y["p"][f], y["q"][f]) <= F.greatest(x["p"][f], x["q"][f]))

    def touch(x: Column, y: Column) -> Column:
        crossed = (side(x["p"], x["q"], y["p"]) * side(x["p"], x["q"], y["q"]) <= 0) & (side(y["p"], y["q"], x["p"]) * side(y["p"], y["q"], x["q"]) <= 0)
        return crossed & overlap(x, y, "lat") & overlap(x, y, "lon")

    crossing = F.exists(edges(a), lambda x: F.exists(edges(b), lambda y: touch(x, y)))
    inside = lambda p, ring: in_ring(F.get(p, F.lit(0))["lat"], F.get(p, F.lit(0))["lon"], ring)
    return crossing | inside(a, b) | inside(b, a)
