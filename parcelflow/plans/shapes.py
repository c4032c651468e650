"""Parcels as shapes: with courtyards, of several parts, and with borders that neighbours share."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import spatial, topology
from ..operators.storage import scratch, stored
from ..sources import files, packages
from ..sources.domain import POINT_SQL, dealt, points, table
from .registry import book

QUERIES, SQL, query = book()

_SHAPE_SQL = """parcel AS (SELECT p_partkey, -33.4 + 0.001 * (p_partkey % 61 - 30) AS south, -70.6 + 0.001 * (p_partkey % 59 - 29) AS west, 0.0005 * p_size AS high, 0.0007 * (p_partkey % 40 + 1) AS wide, p_partkey % 3 AS kind FROM part),
held AS (SELECT vec_id, p_partkey FROM point JOIN parcel ON (lat > south AND lat < south + high AND lon > west AND lon < west + wide AND (kind = 0 OR NOT (lat > south + 0.25 * high AND lat < south + 0.75 * high AND lon > west + 0.25 * wide AND lon < west + 0.75 * wide)))
OR (kind = 2 AND lat > south + 2 * high AND lat < south + 3 * high AND lon > west AND lon < west + wide))"""


def _parcels(spark, sf_dir):
    """A parcel for each part: whole, with a courtyard, or with a courtyard and a second part."""
    k = F.col("p_partkey")
    south, west = -33.4 + 0.001 * (k % 61 - 30), -70.6 + 0.001 * (k % 59 - 29)
    high, wide = 0.0005 * F.col("p_size"), 0.0007 * (k % 40 + 1)

    def square(i0, j0, i1, j1):
        corner = lambda i, j: F.struct((south + i * high).alias("lat"), (west + j * wide).alias("lon"))
        return F.array(*(corner(i, j) for i, j in ((i0, j0), (i0, j1), (i1, j1), (i1, j0), (i0, j0))))

    outer, hole, second = square(0, 0, 1, 1), square(0.25, 0.25, 0.75, 0.75), square(2, 0, 3, 1)
    parts = F.when(k % 3 == 0, F.array(F.array(outer))).when(k % 3 == 1, F.array(F.array(outer, hole))).otherwise(F.array(F.array(outer, hole), F.array(second)))
    return dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", parts.alias("parts"))


@query("SRC-06_GEO-05_courtyards", f"WITH {POINT_SQL}, {_SHAPE_SQL} SELECT * FROM held")
def courtyards(spark, sf_dir):
    """Parcels with holes and several parts, written as GeoParquet and read back, and the points that they hold: none in a courtyard."""
    path = scratch(spark, "shapes")
    _parcels(spark, sf_dir).select("p_partkey", packages.wkb_multipolygon(F.col("parts")).alias("geometry")).write.parquet(path)
    back = packages.read_geo_parquet(spark, path, ["p_partkey"]).select("p_partkey", F.flatten(packages.wkb_parts(F.col("geometry"))).alias("rings"))
    return spatial.in_parcels(points(spark, sf_dir), back, "vec_id", "p_partkey")


@query("SRC-07_GEO-04_shapes_of_parts", f"WITH {POINT_SQL}, {_SHAPE_SQL} SELECT p_partkey, CASE kind WHEN 2 THEN 2 ELSE 1 END AS parts, CASE kind WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS rings, count(vec_id) AS points FROM parcel LEFT JOIN held USING (p_partkey) GROUP BY p_partkey, kind")
def shapes_of_parts(spark, sf_dir):
    """The same parcels through GeoJSON collections, with their numbers of parts, rings and points."""
    path = scratch(spark, "collections")
    one = F.struct(F.lit("Feature").alias("type"), F.struct("p_partkey").alias("properties"), files.geojson_shape(F.col("parts")).alias("geometry"))
    pages = _parcels(spark, sf_dir).groupBy(F.floor(F.col("p_partkey") / 100)).agg(F.collect_list(one).alias("features"))
    pages.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value")).write.text(path)
    read = files.read_shapes(spark, path, "p_partkey: bigint", lines=True)
    back = stored(read.select("p_partkey", F.size("parts").alias("parts"), F.flatten("parts").alias("rings")), "shapes-read")
    held = spatial.count_in_parcels(points(spark, sf_dir), back.select("p_partkey", "rings"), "vec_id", "p_partkey")
    return back.join(held, "p_partkey", "left").select("p_partkey", "parts", F.size("rings").alias("rings"), F.coalesce("points", F.lit(0)).alias("points"))


#: Metres that the middle of a border between two lattice corners stands off it, by the border's place.
_OFF_SQL = """lattice AS (SELECT p_partkey, p_partkey % 20 AS x, p_partkey // 20 AS y FROM part),
off AS (SELECT p_partkey, x, y, (x * 7 + y * 13) % 5 * 2 AS s, (x * 7 + (y + 1) * 13) % 5 * 2 AS n, (x * 11 + y * 3) % 5 * 2 AS w, ((x + 1) * 11 + y * 3) % 5 * 2 AS e FROM lattice)"""


@query("GEO-09_shared_borders", f"WITH {_OFF_SQL} SELECT p_partkey, 4 + (s > 5)::INT + (n > 5)::INT + (w > 5)::INT + (e > 5)::INT AS corners, round((4 * y + 2 + CASE WHEN s > 5 THEN y + s / 2000.0 ELSE 0 END + CASE WHEN n > 5 THEN y + 1 + n / 2000.0 ELSE 0 END + CASE WHEN w > 5 THEN y + 0.5 ELSE 0 END + CASE WHEN e > 5 THEN y + 0.5 ELSE 0 END)::DOUBLE, 6) AS rows FROM off")
def shared_borders(spark, sf_dir):
    """A lattice of parcels of 0.02 degrees whose borders bend in the middle, simplified to five metres: the small bends go, in both neighbours or in none.

    Every 1,500 rows (30 degrees) the lattice goes on at the equator, further east: nearer a pole a degree of longitude is shorter, and bends of the same degrees would be under five metres.
    """
    k, side, metre, rows = F.col("p_partkey"), 0.02, 0.02 / 2000, 1500
    strip, y = F.floor(k / (20 * rows)), F.floor(k / 20) % rows
    # Strips lie a column apart, and bends repeat after 1,500 rows and 25 columns.
    x = k % 20 + 25 * strip
    at = lambda i, j: F.struct((side * i).cast("double").alias("lat"), (side * j).cast("double").alias("lon"))
    level = lambda x, y: at(y + (x * 7 + y * 13) % 5 * 2 * metre / side, x + 0.5)
    upright = lambda x, y: at(y + 0.5, x + (x * 11 + y * 3) % 5 * 2 * metre / side)
    ring = F.array(at(y, x), level(x, y), at(y, x + 1), upright(x + 1, y), at(y + 1, x + 1), level(x, y + 1), at(y + 1, x), upright(x, y))
    parcels = table(spark, sf_dir, "part").select("p_partkey", F.array(ring).alias("rings"))
    simple = topology.simplified_together(parcels, "p_partkey", 5.0).withColumn("ring", F.get("rings", F.lit(0)))
    return simple.select("p_partkey", F.size("ring").alias("corners"), F.round(F.aggregate("ring", F.lit(0.0), lambda s, p: s + p["lat"]) / side + F.size("ring") * rows * F.floor(F.col("p_partkey") / (20 * rows)), 6).alias("rows"))
