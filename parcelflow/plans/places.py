"""Places: points in parcels, doubtful pins, zones from names; searches with totals and broker metrics."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators import aggregates as A
from ..operators import quantiles as Q
from ..operators import filters, spatial
from ..sources.domain import LISTING_SQL, POINT_SQL, dealt, listings, points, table
from .registry import book

QUERIES, SQL, query = book()
L, P = f"WITH {LISTING_SQL} ", f"WITH {POINT_SQL} "
PARCEL_SQL = "parcel AS (SELECT p_partkey, -33.4 + 0.001 * (p_partkey % 61 - 30) AS south, -70.6 + 0.001 * (p_partkey % 59 - 29) AS west, 0.0005 * p_size AS high, 0.0007 * (p_partkey % 40 + 1) AS wide FROM part)"


@query("GEO-05_point_in_parcel", P + f", {PARCEL_SQL} SELECT vec_id, p_partkey FROM point JOIN parcel ON lat > south AND lat < south + high AND lon > west AND lon < west + wide")
def point_in_parcel(spark, sf_dir):
    """Each point with the parcels that hold it: parcels of many sizes, over as many leaves of points as their boxes touch."""
    k = F.col("p_partkey")
    south, west = -33.4 + 0.001 * (k % 61 - 30), -70.6 + 0.001 * (k % 59 - 29)
    high, wide = 0.0005 * F.col("p_size"), 0.0007 * (k % 40 + 1)
    corner = lambda i, j: F.struct((south + i * high).alias("lat"), (west + j * wide).alias("lon"))
    parcels = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", F.array(*(corner(i, j) for i, j in ((0, 0), (0, 1), (1, 1), (1, 0)))).alias("ring"))
    return spatial.in_parcels(points(spark, sf_dir), parcels, "vec_id", "p_partkey")


@query("GEO-02_AGG-16_centres", P + f", m AS (SELECT label, avg(lat) AS a, avg(lon) AS o, count(*) AS n FROM point GROUP BY label) SELECT label, n, round(a, 9) AS lat, round(o, 9) AS lon, round(2 * 6371000.0 * asin(sqrt(pow(sin(radians(a + 33.4) / 2), 2) + cos(radians(-33.4)) * cos(radians(a)) * pow(sin(radians(o + 70.6) / 2), 2))), 3) AS metres FROM m")
def centres(spark, sf_dir):
    m = points(spark, sf_dir).groupBy("label").agg(F.avg("lat").alias("a"), F.avg("lon").alias("o"), F.count(F.lit(1)).alias("n"))
    return m.select("label", "n", F.round("a", 9).alias("lat"), F.round("o", 9).alias("lon"), F.round(geo.haversine(F.lit(-33.4), F.lit(-70.6), F.col("a"), F.col("o")), 3).alias("metres"))


@query("GEO-10_grid", P + f""", b AS (SELECT label, min(lat) AS south, max(lat) AS north, min(lon) AS west, max(lon) AS east, {math.degrees(500 / 6_371_000)!r}::DOUBLE AS dlat FROM point GROUP BY label),
d AS (SELECT *, dlat / cos(radians((south + north) / 2)) AS dlon FROM b), g AS (SELECT *, greatest(1, ceil((north - south) / dlat))::BIGINT AS nr, greatest(1, ceil((east - west) / dlon))::BIGINT AS nc FROM d),
c AS (SELECT *, unnest(range(nr * nc)) AS cell FROM g), n AS (SELECT label, least(nr - 1, floor((lat - south) / dlat)::BIGINT) * nc + least(nc - 1, floor((lon - west) / dlon)::BIGINT) AS cell, count(*) AS points FROM point JOIN g USING (label) GROUP BY 1, 2)
SELECT c.label, c.cell, round(south + (c.cell // nc + 0.5::DOUBLE) * dlat, 8) AS lat, round(west + (c.cell % nc + 0.5::DOUBLE) * dlon, 8) AS lon, coalesce(points, 0) AS points FROM c LEFT JOIN n ON n.label = c.label AND n.cell = c.cell""")
def grid(spark, sf_dir):
    """A grid of 500 m over the box of each label's points, with the points in each of its cells."""
    p = points(spark, sf_dir)
    cells = geo.grid_over(p.groupBy("label").agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east")), 500)
    boxes = cells.where("cell = 0").select("label", "south", "west", "dlat", "dlon", "rows", "cols")
    at = lambda x, low, d, n: F.least(F.col(n) - 1, F.floor((F.col(x) - F.col(low)) / F.col(d)))
    held = p.join(boxes, "label").groupBy("label", (at("lat", "south", "dlat", "rows") * F.col("cols") + at("lon", "west", "dlon", "cols")).alias("cell")).agg(F.count(F.lit(1)).alias("points"))
    return cells.join(held, ["label", "cell"], "left").select("label", "cell", F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"), F.coalesce("points", F.lit(0)).alias("points"))


@query("STR-16_zone_of_name", """SELECT s_suppkey, coalesce(r.r_regionkey, n.n_regionkey) AS region FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'nation ' || s_nationkey ELSE 'asia' END AS name, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey END AS k FROM supplier) LEFT JOIN region r ON lower(r_name) = name LEFT JOIN nation n ON n_nationkey = k""")
def zone_of_name(spark, sf_dir):
    """Exact names of the higher level, else of the lower one; each step is a left join to a dimension."""
    name = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("Nation "), F.col("s_nationkey").cast("string"))).otherwise("Ásia")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", text.fold(name).alias("name"))
    r = table(spark, sf_dir, "region").select(text.fold(F.col("r_name")).alias("name"), F.col("r_regionkey").alias("high"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")).alias("name"), F.col("n_regionkey").alias("low"))
    return s.join(r, "name", "left").join(n, "name", "left").select("s_suppkey", F.coalesce("high", "low").alias("region"))


@query("ER-27_broker_metrics", L + """SELECT advertiser_id, count(*) AS seen, count(*) FILTER (is_active) AS stock, list_sort(list(DISTINCT zone)) AS zones,
round(sum(CASE WHEN NOT is_active THEN round((epoch(last_seen) - epoch(first_seen)) / 86400) END) / nullif(count(*) FILTER (NOT is_active), 0), 4) AS rotation_days FROM listing GROUP BY advertiser_id""")
def broker_metrics(spark, sf_dir):
    days = F.when(~F.col("is_active"), F.round((F.unix_timestamp("last_seen") - F.unix_timestamp("first_seen")) / 86400))
    return listings(spark, sf_dir).groupBy("advertiser_id").agg(F.count(F.lit(1)).alias("seen"), A.count_if(F.col("is_active")).alias("stock"), F.array_sort(F.collect_set("zone")).alias("zones"), F.round(F.sum(days) / F.count(days), 4).alias("rotation_days"))


@query("Q-10_search_stats", L + "SELECT count(*) AS total, count(DISTINCT unit) AS units, round(quantile_cont(price, 0.5), 3) AS median_price, min(price) AS low FROM listing WHERE operation = 'O' AND price <= 50000")
def search_stats(spark, sf_dir):
    l = listings(spark, sf_dir).where(filters.listing_filter(operation="O", price=(None, 50_000)))
    stats = l.agg(F.count(F.lit(1)).alias("total"), F.countDistinct("unit").alias("units"), F.min("price").alias("low"))
    median = Q.quantiles(l, [], {"median_price": (F.col("price"), 0.5)})
    # Two tables of one row each.
    return stats.crossJoin(median).select("total", "units", F.round("median_price", 3).alias("median_price"), "low")


@query("Q-11_19_coverage", "SELECT n_name AS zone, count(*) AS rolls, count(*) FILTER (c_acctbal > 0) AS located, count(*) FILTER (c_acctbal > 5000) AS exact, round(100.0 * count(*) FILTER (c_acctbal > 0) / count(*), 1) AS pct FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def coverage(spark, sf_dir):
    c, b = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")), F.col("c_acctbal")
    return c.groupBy(F.col("n_name").alias("zone")).agg(F.count(F.lit(1)).alias("rolls"), A.count_if(b > 0).alias("located"), A.count_if(b > 5000).alias("exact"), A.percent(A.count_if(b > 0), F.count(F.lit(1))).alias("pct"))


@query("Q-15_16_locations", L + "SELECT region, zone, count(*) FILTER (advertiser ILIKE '%1%') AS named, count(DISTINCT advertiser_id) AS advertisers FROM listing WHERE is_active AND region <> 'ASIA' GROUP BY region, zone HAVING count(*) >= 3")
def locations(spark, sf_dir):
    l = listings(spark, sf_dir).where(filters.all_of(F.col("is_active"), F.col("region") != "ASIA"))
    return l.groupBy("region", "zone").agg(A.count_if(filters.mentions([F.col("advertiser")], "1")).alias("named"), F.countDistinct("advertiser_id").alias("advertisers"), F.count(F.lit(1)).alias("n")).where("n >= 3").drop("n")


@query("Q-17_roll_detail", "SELECT o_orderkey, coalesce(sum(l_quantity) FILTER (l_returnflag = 'N'), sum(l_quantity))::DOUBLE AS m2, count(l_orderkey) AS lines, max(l_shipdate) AS last FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def roll_detail(spark, sf_dir):
    """The area of the preferred kind where there is any, else of all kinds."""
    q = F.col("l_quantity")
    sums = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.coalesce(F.sum(F.when(F.col("l_returnflag") == "N", q)), F.sum(q)).alias("m2"), F.count(F.lit(1)).alias("lines"), F.max("l_shipdate").alias("last"))
    return table(spark, sf_dir, "orders").join(sums, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.col("m2").cast("double").alias("m2"), F.coalesce("lines", F.lit(0)).alias("lines"), "last")


@query("Q-25_domains", "SELECT regexp_extract(lower(url), '^https?://(?:www\\.)?([^/?#:]+)', 1) AS domain, count(*) AS pages FROM pages GROUP BY 1")
def domains(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(F.regexp_extract(F.lower("url"), r"^https?://(?:www\.)?([^/?#:]+)", 1).alias("domain")).agg(F.count(F.lit(1)).alias("pages"))
