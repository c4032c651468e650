"""Answers about the market: medians by zone, opportunities, broken exclusives, valuation, brokers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import aggregates as A
from ..operators import spatial
from ..operators import quantiles as Q
from ..sources.domain import LISTING_SQL, POINT_SQL, listings, points, table
from .registry import book

QUERIES, SQL, query = book()
L = f"WITH {LISTING_SQL} "
AS_OF = "1999-01-01 00:00:00"


@query("Q-01_market_by_zone", L + f"""SELECT zone, operation, count(*) AS n, count(*) FILTER (is_active) AS active, round(quantile_cont(price, 0.5), 3) AS median_price,
round(quantile_cont(round(price * 100)::BIGINT // square_meters::BIGINT, 0.5), 1) AS median_cents_m2, quantile_cont(round((epoch(TIMESTAMP '{AS_OF}') - epoch(first_seen)) / 86400)::BIGINT, 0.5) AS median_days
FROM listing GROUP BY zone, operation""")
def market_by_zone(spark, sf_dir):
    days = F.round((F.unix_timestamp(F.lit(AS_OF).cast("timestamp")) - F.unix_timestamp("first_seen")) / 86400).cast("long")
    cents = F.expr("cast(round(price * 100) as bigint) div cast(square_meters as bigint)")
    l, keys = listings(spark, sf_dir), ["zone", "operation"]
    counts = l.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), A.count_if(F.col("is_active")).alias("active"))
    medians = Q.quantiles(l, keys, {"median_price": (F.col("price"), 0.5), "median_cents_m2": (cents, 0.5), "median_days": (days, 0.5)})
    return counts.join(medians, keys).select(*keys, "n", "active", F.round("median_price", 3).alias("median_price"), F.round("median_cents_m2", 1).alias("median_cents_m2"), "median_days")


@query("Q-02_broken_exclusives", L + "SELECT unit, count(DISTINCT advertiser_id) AS agencies, list_sort(list(DISTINCT advertiser)) AS names, min(price) AS low, max(price) AS high FROM listing WHERE is_active GROUP BY unit HAVING count(DISTINCT advertiser_id) >= 2")
def broken_exclusives(spark, sf_dir):
    return listings(spark, sf_dir).where("is_active").groupBy("unit").agg(F.countDistinct("advertiser_id").alias("agencies"), F.array_sort(F.collect_set("advertiser")).alias("names"), F.min("price").alias("low"), F.max("price").alias("high")).where("agencies >= 2")


@query("Q-03_opportunities", L + """, m AS (SELECT zone, operation, quantile_cont(price / square_meters, 0.5) AS m FROM listing GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT id, zone, round(price / square_meters / m, 6) AS ratio FROM listing JOIN m USING (zone, operation) WHERE price / square_meters < 0.85 * m""")
def opportunities(spark, sf_dir):
    l, keys = listings(spark, sf_dir).withColumn("p", F.col("price") / F.col("square_meters")).select("id", "zone", "operation", "p"), ["zone", "operation"]
    often = l.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n >= 5").select(*keys)
    m = Q.quantiles(l, keys, {"m": (F.col("p"), 0.5)}).join(often, keys, "left_semi")
    return l.join(m, keys).where("p < 0.85 * m").select("id", "zone", F.round(F.col("p") / F.col("m"), 6).alias("ratio"))


_DIST = "2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2))))"


@query("Q-04_valuation", f"""WITH {POINT_SQL}, priced AS (SELECT point.*, p_retailprice AS price FROM point LEFT JOIN part ON p_partkey = vec_id), near AS (SELECT a.vec_id, count(*) AS n, quantile_cont(b.price, 0.5) AS m FROM priced a JOIN priced b ON a.vec_id <> b.vec_id AND {_DIST.format(a='a.', b='b.')} <= 1000 WHERE b.price IS NOT NULL GROUP BY a.vec_id),
zone AS (SELECT label, count(price) AS n, quantile_cont(price, 0.5) AS m FROM priced GROUP BY label)
SELECT p.vec_id, CASE WHEN coalesce(near.n, 0) < 5 AND zone.n > coalesce(near.n, 0) THEN 'zone' ELSE 'near' END AS used, round(CASE WHEN coalesce(near.n, 0) < 5 AND zone.n > coalesce(near.n, 0) THEN zone.m ELSE near.m END, 4) AS value
FROM priced p JOIN zone USING (label) LEFT JOIN near ON near.vec_id = p.vec_id""")
def valuation(spark, sf_dir):
    """Median price of comparables within 1 km; of the zone if under five and it has more."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("vec_id"), F.col("p_retailprice").alias("price"))
    p = points(spark, sf_dir).join(part, "vec_id", "left")
    near = spatial.medians_within(p, p, 1000, "vec_id", "vec_id", "price").withColumnRenamed("median", "m")
    zone = p.groupBy("label").agg(F.count("price").alias("zn")).join(Q.quantiles(p, ["label"], {"zm": (F.col("price"), 0.5)}), "label")
    n = F.coalesce("n", F.lit(0))
    wide = (n < 5) & (F.col("zn") > n)
    return p.select("vec_id", "label").join(zone, "label").join(near, "vec_id", "left").select("vec_id", F.when(wide, "zone").otherwise("near").alias("used"), F.round(F.when(wide, F.col("zm")).otherwise(F.col("m")), 4).alias("value"))


@query("Q-05_recent_comparables", L + "SELECT zone, count(*) AS n, round(quantile_cont(price, 0.25), 4) AS p25, round(quantile_cont(price, 0.5), 4) AS p50 FROM listing WHERE last_seen >= TIMESTAMP '1998-01-01' AND last_seen < TIMESTAMP '1999-01-01' GROUP BY zone HAVING count(*) >= 3")
def recent_comparables(spark, sf_dir):
    l = listings(spark, sf_dir).where(F.col("last_seen").between("1998-01-01", "1998-12-31 23:59:59.999999"))
    n = l.groupBy("zone").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    found = Q.quantiles(l, ["zone"], {"p25": (F.col("price"), 0.25), "p50": (F.col("price"), 0.5)})
    return n.join(found, "zone").select("zone", "n", F.round("p25", 4).alias("p25"), F.round("p50", 4).alias("p50"))


@query("Q-05_cell_comparables", L + """, y AS (SELECT unit % 50 AS cell, zone, round(price * 100)::BIGINT // square_meters::BIGINT AS cents_m2, last_seen FROM listing WHERE square_meters >= 1 AND price > 0 AND last_seen >= (SELECT max(last_seen) FROM listing) - INTERVAL 12 MONTHS)
SELECT cell, zone, count(*) AS n, round(quantile_cont(cents_m2, 0.5), 1) AS median_cents_m2, round(avg(cents_m2), 4) AS mean_cents_m2, min(last_seen) AS since, max(last_seen) AS until FROM y GROUP BY cell, zone""")
def cell_comparables(spark, sf_dir):
    """Prices a square metre by cell and zone over the last 12 months of the table; the cell is a column that the rows bring."""
    l, seen = listings(spark, sf_dir), F.col("last_seen")
    # The newest advert is looked for among the last month's lines, of all where those are of no advert. As a
    # number it cuts the lines before they are joined.
    text_of = lambda df, c: df.agg(F.max(c).cast("string")).first()[0]
    moment = lambda x: F.lit(x).cast(l.schema["last_seen"].dataType)
    last = text_of(table(spark, sf_dir, "lineitem"), "l_shipdate")
    newest = text_of(l.where(seen >= moment(last) - F.expr("interval 1 month")), "last_seen") or text_of(l, "last_seen")
    m2 = F.expr("cast(round(price * 100) as long) div cast(square_meters as long)").alias("cents_m2")
    y = l.where("square_meters >= 1 and price > 0").where(seen >= moment(newest) - F.expr("interval 12 months")).select((F.col("unit") % 50).alias("cell"), "zone", m2, "last_seen")
    sums = y.groupBy("cell", "zone").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("cents_m2"), 4).alias("mean_cents_m2"), F.min("last_seen").alias("since"), F.max("last_seen").alias("until"))
    return sums.join(Q.quantiles(y, ["cell", "zone"], {"median_cents_m2": (F.col("cents_m2"), 0.5)}), ["cell", "zone"]).withColumn("median_cents_m2", F.round("median_cents_m2", 1))


@query("Q-06_buildings", "SELECT regexp_replace(p_name, '\\s*\\S+$', '') AS base, count(*) AS units, arg_max(p_partkey, (p_retailprice, p_partkey)) AS sample FROM part GROUP BY 1 HAVING count(*) >= 2")
def buildings(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.regexp_replace("p_name", r"\s*\S+$", "").alias("base")).agg(F.count(F.lit(1)).alias("units"), A.first_by(F.col("p_partkey"), "p_retailprice", "p_partkey").alias("sample")).where("units >= 2")


@query("Q-07_units", "SELECT p.p_partkey, count(q.p_partkey) AS beside FROM part p LEFT JOIN part q ON p.p_brand = q.p_brand AND p.p_size = q.p_size AND p.p_partkey <> q.p_partkey GROUP BY 1")
def units(spark, sf_dir):
    """Other units of each one's building: its size is enough, no pairs are made."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    n = p.groupBy("p_brand", "p_size").agg((F.count(F.lit(1)) - 1).alias("beside"))
    return p.join(n, ["p_brand", "p_size"]).select("p_partkey", "beside")


@query("Q-08_summary", "SELECT n_name AS zone, count(*) AS rolls, count(*) FILTER (c_mktsegment = 'BUILDING') AS building, count(*) FILTER (c_mktsegment = 'MACHINERY') AS machinery, count(*) FILTER (c_mktsegment NOT IN ('BUILDING', 'MACHINERY')) AS others, count(*) FILTER (c_acctbal < 0) AS indebted, count(DISTINCT regexp_replace(c_name, '\\d$', '')) AS names FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def summary(spark, sf_dir):
    c, seg = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")), F.col("c_mktsegment")
    known = ("BUILDING", "MACHINERY")
    return c.groupBy(F.col("n_name").alias("zone")).agg(F.count(F.lit(1)).alias("rolls"), *(A.count_if(seg == k).alias(k.lower()) for k in known), A.count_if(~seg.isin(*known)).alias("others"), A.count_if(F.col("c_acctbal") < 0).alias("indebted"), F.countDistinct(F.regexp_replace("c_name", r"\d$", "")).alias("names"))


@query("Q-09_brokers", L + ", u AS (SELECT unit, count(DISTINCT advertiser_id) AS k FROM listing GROUP BY unit) SELECT advertiser_id, count(*) AS seen, count(*) FILTER (is_active) AS stock, count(DISTINCT zone) AS zones, round(100.0 * count(*) FILTER (k = 1) / count(*), 1) AS exclusive_pct FROM listing JOIN u USING (unit) GROUP BY advertiser_id")
def brokers(spark, sf_dir):
    l = listings(spark, sf_dir)
    u = l.groupBy("unit").agg(F.countDistinct("advertiser_id").alias("k"))
    return l.join(u, "unit").groupBy("advertiser_id").agg(F.count(F.lit(1)).alias("seen"), A.count_if(F.col("is_active")).alias("stock"), F.countDistinct("zone").alias("zones"), A.percent(A.count_if(F.col("k") == 1), F.count(F.lit(1))).alias("exclusive_pct"))


@query("Q-12_watchlist_news", f"WITH {POINT_SQL} SELECT label, greatest(0, count(*) FILTER (lat BETWEEN -33.45 AND -33.35 AND lon BETWEEN -70.65 AND -70.55) - 20) AS news FROM point GROUP BY label")
def watchlist_news(spark, sf_dir):
    inside = geo.in_box(F.col("lat"), F.col("lon"), -33.45, -70.65, -33.35, -70.55)
    return points(spark, sf_dir).groupBy("label").agg(F.greatest(F.lit(0).cast("long"), A.count_if(inside) - 20).alias("news"))


@query("Q-13_debt", "SELECT c_mktsegment AS kind, count(*) FILTER (c_acctbal < 0) AS debtors, coalesce(sum(-c_acctbal::DECIMAL(18,2)) FILTER (c_acctbal < 0), 0)::DOUBLE AS owed FROM customer GROUP BY 1")
def debt(spark, sf_dir):
    owed = F.coalesce(A.exact_sum(F.when(F.col("c_acctbal") < 0, -F.col("c_acctbal"))), F.lit(0.0))
    return table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("kind")).agg(A.count_if(F.col("c_acctbal") < 0).alias("debtors"), owed.alias("owed"))


@query("Q-14_latest_value", "SELECT n_nationkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS latest, round(sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(*), 2) AS mean FROM orders JOIN customer ON o_custkey = c_custkey RIGHT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def latest_value(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    v = o.groupBy("c_nationkey").agg(A.first_by(F.col("o_totalprice"), "o_orderdate", "o_orderkey").alias("latest"), A.mean(F.col("o_totalprice")).alias("mean"))
    return table(spark, sf_dir, "nation").join(v, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_nationkey", "latest", "mean")


@query("Q-18_typeahead", "SELECT * FROM (SELECT 'region' AS kind, r_name AS name FROM region WHERE r_name ILIKE '%a%' ORDER BY r_name LIMIT 3) UNION ALL SELECT * FROM (SELECT 'zone', n_name FROM nation WHERE n_name ILIKE '%a%' ORDER BY n_name LIMIT 5)")
def typeahead(spark, sf_dir):
    of = lambda t, c, kind, n: table(spark, sf_dir, t).where(F.col(c).ilike("%a%")).orderBy(c).limit(n).select(F.lit(kind).alias("kind"), F.col(c).alias("name"))
    return of("region", "r_name", "region", 3).unionByName(of("nation", "n_name", "zone", 5))


@query("Q-20_distribution", "SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2 ORDER BY n DESC, p_brand, p_size LIMIT 20")
def distribution(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p_brand", "p_size").limit(20)


@query("Q-23_without_match", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def without_match(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("GEO-03_within_radius", f"WITH {POINT_SQL} SELECT a.vec_id AS a, b.vec_id AS b, round({_DIST.format(a='a.', b='b.')}, 2) AS metres FROM point a JOIN point b ON a.vec_id < b.vec_id AND {_DIST.format(a='a.', b='b.')} <= 350")
def within_radius(spark, sf_dir):
    p = points(spark, sf_dir)
    return spatial.pairs_within(p.withColumnRenamed("vec_id", "a"), p.withColumnRenamed("vec_id", "b"), 350, "a", "b").where("a < b").select("a", "b", F.round("metres", 2).alias("metres"))


@query("GEO-04_in_polygon", f"WITH {POINT_SQL} SELECT vec_id FROM point WHERE lat - (-33.4) + abs(lon - (-70.6)) < 0.01 AND lat > -33.42")
def in_polygon(spark, sf_dir):
    """A triangle, tip up."""
    corner = lambda a, b: F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon"))
    ring = F.array(corner(-33.39, -70.6), corner(-33.42, -70.63), corner(-33.42, -70.57))
    return points(spark, sf_dir).where(geo.in_ring(F.col("lat"), F.col("lon"), ring)).select("vec_id")


@query("GEO-11_tiles", f"WITH {POINT_SQL} SELECT floor((lon + 180) / 360 * 4096)::BIGINT AS x, floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 4096)::BIGINT AS y, count(*) AS n FROM point GROUP BY 1, 2")
def tiles(spark, sf_dir):
    return points(spark, sf_dir).select(geo.tile(F.col("lat"), F.col("lon"), 12).alias("t")).groupBy("t.x", "t.y").agg(F.count(F.lit(1)).alias("n"))


@query("GEO-13_rings", f"WITH {POINT_SQL}, d AS (SELECT a.vec_id, {_DIST.format(a='a.', b='b.')} AS m FROM point a JOIN point b ON a.vec_id <> b.vec_id), c AS (SELECT vec_id, count(*) FILTER (m <= 100) AS c1, count(*) FILTER (m <= 300) AS c2, count(*) FILTER (m <= 1000) AS c3, count(*) FILTER (m <= 2500) AS c4 FROM d WHERE m <= 2500 GROUP BY 1) SELECT vec_id, CASE WHEN c1 >= 3 THEN 100 WHEN c2 >= 3 THEN 300 WHEN c3 >= 3 THEN 1000 ELSE 2500 END AS ring, CASE WHEN c1 >= 3 THEN c1 WHEN c2 >= 3 THEN c2 WHEN c3 >= 3 THEN c3 ELSE c4 END AS n FROM c")
def rings(spark, sf_dir):
    """The smallest ring with three neighbours: only points that a ring leaves with fewer look in the next."""
    p, steps = points(spark, sf_dir), (100, 300, 1000, 2500)
    n = F.count(F.lit(1)).alias("n")
    enough = lambda found, _: found.groupBy("vec_id").agg(n).where("n >= 3")
    found = spatial.growing_rings(p, p.withColumnRenamed("vec_id", "other"), steps, "vec_id", "other", lambda d: d.where("vec_id <> other"), enough)
    c = found.groupBy("vec_id").agg(n, F.max("ring").alias("last"))
    return c.select("vec_id", F.when(F.col("n") >= 3, F.col("last")).otherwise(steps[-1]).alias("ring"), "n")


@query("JN-14_latest_in_box", f"WITH {POINT_SQL} SELECT a.vec_id, max(b.vec_id) AS latest FROM point a LEFT JOIN point b ON b.vec_id < a.vec_id AND b.lat BETWEEN a.lat - 0.005 AND a.lat + 0.005 AND b.lon BETWEEN a.lon - 0.005 AND a.lon + 0.005 GROUP BY a.vec_id")
def latest_in_box(spark, sf_dir):
    """For each point the latest earlier one in a box around it: points meet in the cells that their boxes cover."""
    p, half, size = points(spark, sf_dir), 0.005, 0.01
    cell = lambda x: F.floor(x / size).cast("long")
    span = lambda c: F.sequence(cell(F.col(c) - half), cell(F.col(c) + half))
    boxes = p.withColumn("r", F.explode(span("lat"))).withColumn("c", F.explode(span("lon"))).select("vec_id", F.col("lat").alias("mid_lat"), F.col("lon").alias("mid_lon"), "r", "c")
    inside = p.select(F.col("vec_id").alias("other"), "lat", "lon", cell(F.col("lat")).alias("r"), cell(F.col("lon")).alias("c"))
    near = (F.col("other") < F.col("vec_id")) & F.col("lat").between(F.col("mid_lat") - half, F.col("mid_lat") + half) & F.col("lon").between(F.col("mid_lon") - half, F.col("mid_lon") + half)
    best = boxes.join(inside, ["r", "c"]).where(near).groupBy("vec_id").agg(F.max("other").alias("latest"))
    return p.select("vec_id").join(best, "vec_id", "left")
