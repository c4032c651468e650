"""Pairs of adverts with all their signals, matches with the cadastre, change kinds, the outbox, and further sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators import cadastre, entity, joins, outbox
from ..operators import changes as CH
from ..operators.storage import scratch
from ..sources import files, packages
from ..sources.domain import CHANGE_SQL, PHASH_SQL, POINT_SQL, adverts, changes, points, table
from .registry import book

QUERIES, SQL, query = book()

ADVERT_SQL = f"""{POINT_SQL}, {PHASH_SQL}, advert AS (SELECT point.vec_id AS id, lat, lon, picture.phash AS phash, p_size::DOUBLE AS area, p_retailprice AS price, point.vec_id % 4 AS bedrooms, point.vec_id % 3 AS bathrooms, p_type AS kind,
CASE WHEN point.vec_id % 2 = 0 THEN 'sale' ELSE 'rent' END AS operation, 'c' || point.vec_id // 500 AS commune, lpad((point.vec_id // 3)::VARCHAR, 8, '0') AS digits, lower(concat_ws(' ', p_brand, (point.vec_id // 50)::VARCHAR)) AS agency,
lower(strip_accents(p_name)) AS address, point.vec_id % 5 > 0 AS is_active, list_prepend(picture.phash, CASE point.vec_id % 4 WHEN 0 THEN [xor(room.phash, 21845::UBIGINT), xor(picture.phash, 18446744073709551615::UBIGINT)] WHEN 1 THEN [xor(room.phash, 21842::UBIGINT)] ELSE [] END) AS hashes
FROM point JOIN picture USING (vec_id) JOIN picture room ON room.vec_id = point.vec_id - point.vec_id % 4 LEFT JOIN part ON p_partkey = point.vec_id)"""
_METRES = "2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"
_WORDS = "trim(regexp_replace({x}, '[^a-z0-9]+', ' ', 'g'))"
_RUNS = "list_distinct(list_transform(range(1, length({x}) + 2), lambda i: substr('  ' || {x} || ' ', i, 3)))"
#: Both blockings, each signal from the columns of the two adverts, both weighted sums, and the decision.
VERDICT_SQL = f"""{ADVERT_SQL}, worded AS (SELECT *, {_WORDS.format(x='address')} AS w, {_WORDS.format(x='agency')} AS g FROM advert), full_rows AS (SELECT *, {_RUNS.format(x='w')} AS t FROM worded),
two AS (SELECT a.id AS a, b.id AS b, {_METRES} AS distance,
CASE WHEN greatest(a.area, b.area) > 0 AND a.area IS NOT NULL AND b.area IS NOT NULL THEN abs(a.area - b.area) / greatest(a.area, b.area) * 100 END AS area,
a.bedrooms = b.bedrooms AS bedrooms, abs(a.bathrooms - b.bathrooms) AS bathrooms,
CASE WHEN greatest(a.price, b.price) > 0 AND a.price IS NOT NULL AND b.price IS NOT NULL THEN abs(a.price - b.price) / greatest(a.price, b.price) * 100 END AS price,
CASE WHEN length(a.w) >= 2 AND length(b.w) >= 2 THEN len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(a.t || b.t)) END AS text,
list_min(flatten(list_transform(a.hashes, lambda x: list_transform(b.hashes, lambda y: bit_count(xor(x, y)))))) AS phash, a.kind = b.kind AS kind, a.operation = b.operation AS operation, ('9' || a.digits) = ('9' || b.digits) AS same_phone,
CASE WHEN length(a.g) >= 3 AND length(b.g) >= 3 THEN a.g = b.g END AS same_agency,
a.commune = b.commune AS one_commune, a.agency = b.agency AS one_agency, a.address = b.address AND length(a.address) > 4 AS one_address,
coalesce(least(a.price, b.price) <= 0 OR abs(a.price - b.price) <= 0.3 * greatest(a.price, b.price), true) OR a.price IS NULL OR b.price IS NULL AS priced,
b.is_active AND coalesce(abs(a.area - b.area) <= ceil(a.area * 0.08), true) OR a.is_active AND coalesce(abs(a.area - b.area) <= ceil(b.area * 0.08), true) AS alike
FROM full_rows a JOIN full_rows b ON a.id < b.id),
blocked AS (SELECT *, distance <= 150 AND operation AND bedrooms AND alike AS near_alike, one_commune AND (coalesce(same_phone OR one_agency OR one_address, coalesce(same_phone, false) OR coalesce(one_agency, false) OR coalesce(one_address, false)) OR distance <= 350 AND priced) AS near_or_named FROM two),
summed AS (SELECT *, (-0.15 * least(1, distance / 150) + CASE WHEN area IS NULL THEN 0 ELSE -0.10 * least(1, area / 50) END + CASE WHEN bedrooms THEN 0.15 ELSE 0 END - 0.05 * least(1, bathrooms / 3) + CASE WHEN price IS NULL THEN 0 ELSE -0.08 * least(1, price / 50) END + coalesce(0.12 * text, 0) - 0.20 * least(1, phash / 16) + CASE WHEN kind THEN 0.10 ELSE 0 END + CASE WHEN operation THEN 0.10 ELSE 0 END)::DOUBLE AS es,
(-0.25 * least(1, distance / 150) + CASE WHEN area IS NULL THEN 0 ELSE -0.06 * least(1, area / 50) END + CASE WHEN bedrooms THEN 0.15 ELSE 0 END - 0.04 * least(1, bathrooms / 3) + CASE WHEN price IS NULL THEN 0 ELSE -0.06 * least(1, price / 50) END + coalesce(0.20 * text, 0) + CASE WHEN kind THEN 0.10 ELSE 0 END + CASE WHEN operation THEN 0.10 ELSE 0 END
+ CASE WHEN same_phone THEN 0.60 ELSE 0 END + CASE WHEN same_agency THEN 0.35 ELSE 0 END + CASE WHEN phash <= 8 THEN 0.50 ELSE 0 END)::DOUBLE AS cl FROM blocked WHERE near_alike OR near_or_named),
verdict AS (SELECT *, 1 / (1 + exp(-2 * es)) AS footprint, 1 / (1 + exp(-2 * cl)) AS score, coalesce(phash <= 8, false) OR coalesce(same_phone, false) OR coalesce(text >= 0.5, false) AS proof FROM summed),
decided AS (SELECT *, CASE WHEN score >= 0.75 AND proof THEN 'confirmed' WHEN score >= 0.45 THEN 'candidate' ELSE 'rejected' END AS decision FROM verdict)"""


def verdicts(spark, sf_dir):
    """Pairs of either market's blocking with all signals, both scores and the decision."""
    rows = adverts(spark, sf_dir)
    ways = entity.near_alike(rows).withColumn("way", F.lit("near_alike")).unionByName(entity.near_or_named(rows).withColumn("way", F.lit("near_or_named")))
    found = ways.groupBy("a", "b").agg(F.bool_or(F.col("way") == "near_alike").alias("near_alike"), F.bool_or(F.col("way") == "near_or_named").alias("near_or_named"))
    return entity.pair_verdicts(entity.pair_signals(found.select("a", "b"), rows)).join(found, ["a", "b"])


@query("ER-01_05_pair_decisions", f"WITH {VERDICT_SQL} SELECT a, b, near_alike, near_or_named, round(distance, 3) AS distance, round(area, 6) AS area, bedrooms, bathrooms::INT AS bathrooms, round(price, 6) AS price, round(text, 6) AS text, phash::INT AS phash, kind, operation, same_phone, same_agency, round(footprint, 6) AS footprint, round(score, 6) AS score, decision FROM decided")
def pair_decisions(spark, sf_dir):
    v = verdicts(spark, sf_dir)
    rounded = {"distance": 3, "area": 6, "price": 6, "text": 6, "footprint": 6, "score": 6}
    return v.select("a", "b", "near_alike", "near_or_named", *(F.round(c, rounded[c]).alias(c) if c in rounded else F.col(c) for c in ("distance", "area", "bedrooms", "bathrooms", "price", "text", "phash", "kind", "operation", "same_phone", "same_agency", "footprint", "score", "decision")))


@query("ER-01_05_all_signals")
def all_signals(spark, sf_dir):
    return verdicts(spark, sf_dir)


@query("ER-09_clusters", f"""WITH RECURSIVE {VERDICT_SQL}, good AS (SELECT a, b FROM decided WHERE decision = 'confirmed' UNION SELECT b, a FROM decided WHERE decision = 'confirmed'),
walk(node, seen) AS (SELECT DISTINCT a, a FROM good UNION SELECT walk.node, good.b FROM walk JOIN good ON walk.seen = good.a) SELECT node, min(seen) AS cluster FROM walk GROUP BY node""")
def clusters(spark, sf_dir):
    return entity.clusters(verdicts(spark, sf_dir).where("decision = 'confirmed'").select("a", "b", "score"), most=10**9)


@query("ER-11_confidence", f"WITH {VERDICT_SQL} SELECT node, round(max(score), 6) AS confidence FROM (SELECT a AS node, score FROM decided WHERE decision = 'confirmed' UNION ALL SELECT b, score FROM decided WHERE decision = 'confirmed') GROUP BY node")
def confidence(spark, sf_dir):
    return entity.confidence(verdicts(spark, sf_dir).where("decision = 'confirmed'")).select("node", F.round("confidence", 6).alias("confidence"))


def _adverts_and_rolls(spark, sf_dir):
    """Adverts, and the rolls of the same places: numbers a little off, addresses with a number of their own."""
    a = adverts(spark, sf_dir)
    i = F.col("id")
    address = F.concat(F.lit("Calle "), F.col("address"), F.lit(" "), (i % 40 + 1).cast("string"))
    none = lambda kind: F.lit(None).cast(kind)
    l = a.select(i.alias("advert"), "commune", F.when(i % 7 > 0, F.col("lat")).alias("lat"), F.col("lon"), F.when(i % 11 > 0, address).alias("address"), (F.col("area") * 10).alias("area"), F.when(i % 3 == 0, F.col("area") * 6).alias("built"), F.when(i % 3 == 1, F.col("area") * 12).alias("land"), (i % 3 + 1).alias("floors"), (1980 + i % 40).alias("year"), (i % 4 == 0).alias("in_condominium"), F.when(i % 2 == 0, "casa").otherwise("departamento").alias("kind"), "operation", (F.col("price") * 1000).alias("price"))
    r = a.select(i.alias("roll"), "commune", "lat", "lon", F.when(i % 13 > 0, F.upper(address)).alias("address"), (F.col("area") * 7).alias("built"), (F.col("area") * 12).alias("land"), (i % 2 + 1).alias("floors"), (1982 + i % 35).alias("year"), F.when(i % 4 == 0, i).alias("parent"), F.when(i % 5 < 2, F.lit(True)).when(i % 5 == 2, F.lit(False)).alias("use_fits"), (F.col("price") * 400).alias("valuation"), none("double").alias("pictures"))
    return l, r


@query("ER-25_roll_candidates")
def roll_candidates(spark, sf_dir):
    """The twelve likeliest rolls of each advert."""
    return cadastre.candidates(*_adverts_and_rolls(spark, sf_dir))


@query("ER-22_roll_scores", """WITH o AS (SELECT o_orderkey AS k, (o_orderkey % 700)::DOUBLE * 3 AS d, (o_custkey % 50 + 40)::DOUBLE AS mine, (o_orderkey % 60 + 40)::DOUBLE AS its, o_custkey % 4 AS fl, o_orderkey % 4 AS fr, 1950 + o_custkey % 60 AS y1, 1950 + o_orderkey % 60 AS y2, o_orderkey % 3 AS u, o_custkey % 2 = 0 AS condo, o_orderkey % 2 AS par, o_totalprice AS price, (o_orderkey % 9 + 1) * 20000.0 AS val, o_custkey % 30 AS n1, o_orderkey % 30 AS n2 FROM orders),
p AS (SELECT *, abs(n1 - n2) AS ap, abs(mine - its) / mine AS s, abs(y1 - y2) AS yd, price / val AS r FROM o),
e AS (SELECT *, CASE WHEN ap = 0 THEN 4.2 WHEN ap <= 4 THEN 3.2 - ap * 0.25 WHEN ap <= 20 THEN 2.2 - (ap - 4) * 0.075 ELSE 1.0 - (ap - 20) * 0.02 END AS ad,
CASE WHEN d <= 50 THEN 1.3 - 0.006 * d WHEN d <= 150 THEN 1.0 - 0.005 * (d - 50) WHEN d <= 300 THEN 0.5 - (d - 150) / 300 WHEN d <= 600 THEN -0.4 * (d - 300) / 300 WHEN d <= 1200 THEN -0.4 - 0.4 * (d - 600) / 600 ELSE -0.8 - 0.4 * (d - 1200) / 1300 END AS di,
CASE WHEN s <= 0.08 THEN 2.4 - 5 * s WHEN s <= 0.2 THEN 2.0 - (s - 0.08) / 0.12 WHEN s <= 0.4 THEN 1 - (s - 0.2) / 0.2 WHEN s <= 0.7 THEN -1.2 * (s - 0.4) / 0.3 WHEN s <= 1.5 THEN -1.2 - (s - 0.7) / 0.8 ELSE -2.2 END AS bu,
CASE abs(fl - fr) WHEN 0 THEN 1.2 WHEN 1 THEN 0.2 ELSE -0.8 END AS fo,
CASE WHEN yd <= 3 THEN 1.6 - 0.2 * yd / 3 WHEN yd <= 8 THEN 1.4 - 0.8 * (yd - 3) / 5 WHEN yd <= 20 THEN 0.6 - 0.6 * (yd - 8) / 12 WHEN yd <= 50 THEN -0.8 * (yd - 20) / 30 ELSE -0.8 END AS ye,
CASE WHEN condo AND par = 1 THEN 0.4 ELSE 0 END AS co, CASE u WHEN 0 THEN 0.4 WHEN 1 THEN -2.5 ELSE 0 END AS us, CASE WHEN r BETWEEN 0.9 AND 4.5 THEN 0.3 WHEN r < 0.4 OR r > 10 THEN -0.8 ELSE 0 END AS pr FROM p),
t AS (SELECT k, (-1.2 + ad + CASE WHEN ad >= 4 AND di < 0 THEN 0 ELSE di END + bu + fo + ye + co + us + pr)::DOUBLE AS odds FROM e)
SELECT k AS o_orderkey, round(odds, 6) AS odds, round(1 / (1 + exp(-odds)), 6) AS p, CASE WHEN 1 / (1 + exp(-odds)) >= 0.92 THEN 'confirmed' WHEN 1 / (1 + exp(-odds)) >= 0.8 THEN 'high_candidate' WHEN 1 / (1 + exp(-odds)) >= 0.65 THEN 'candidate' ELSE 'rejected' END AS level FROM t""")
def roll_scores(spark, sf_dir):
    """An advert and a roll of each order, one street, with all evidence but the weaker areas and pictures."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    street = lambda n: F.concat(F.lit("Av. Ñuñoa "), n.cast("string"))
    rows = cadastre.addressed(table(spark, sf_dir, "orders").withColumns({"a_address": street(c % 30), "r_address": F.upper(street(k % 30))}), "a_address", "a_")
    rows = cadastre.addressed(rows, "r_address", "r_")
    none = F.lit(None).cast("double")
    of = lambda side: {n: F.col(f"{side}_{n}") for n in ("address", "street", "number")}
    advert = of("a") | {"area": none, "built": (c % 50 + 40).cast("double"), "land": none, "floors": c % 4, "year": 1950 + c % 60, "in_condominium": c % 2 == 0, "kind": F.lit("departamento"), "operation": F.lit("sale"), "price": F.col("o_totalprice")}
    roll = of("r") | {"distance": (k % 700).cast("double") * 3, "similarity": none, "built": (k % 60 + 40).cast("double"), "land": none, "floors": k % 4, "year": 1950 + k % 60, "parent": F.when(k % 2 == 1, k), "use_fits": F.when(k % 3 == 0, F.lit(True)).when(k % 3 == 1, F.lit(False)), "valuation": (k % 9 + 1) * 20000.0, "pictures": none}
    odds = cadastre.log_odds(cadastre.evidence(advert, roll))
    p = 1 / (1 + F.exp(-odds))
    return rows.select("o_orderkey", F.round(odds, 6).alias("odds"), F.round(p, 6).alias("p"), cadastre.level(p).alias("level"))


_KIND_SQL = CHANGE_SQL + """, v AS (SELECT event_id, listing_id, ts, price, CASE WHEN agency <> 'error' THEN agency END AS agency, k, k % 7 > 0 AS is_active FROM change),
w AS (SELECT *, lag(agency) OVER w AS a0, lag(price) OVER w AS p0, lag(k) OVER w AS k0, lag(is_active) OVER w AS i0, row_number() OVER w AS n FROM v WINDOW w AS (PARTITION BY listing_id ORDER BY ts, event_id))"""


@query("WIN-04_STM-01_change_kinds", f"WITH {_KIND_SQL} SELECT event_id, CASE WHEN n = 1 THEN 'new' WHEN NOT i0 AND is_active THEN 'reactivated' WHEN agency <> a0 THEN 'agency_change' WHEN price <> p0 THEN 'price_change' WHEN k IS DISTINCT FROM k0 THEN 'updated' END AS kind FROM w")
def change_kinds(spark, sf_dir):
    v = changes(spark, sf_dir).withColumns({"agency": F.when(F.col("agency") != "error", F.col("agency")), "is_active": F.col("k") % 7 > 0})
    return CH.with_change_kind(v, "listing_id", ["ts", "event_id"], ["k"]).select("event_id", "kind")


@query("STM-09_outbox", CHANGE_SQL.join(("WITH ", "")) + """, old AS (SELECT listing_id, max(ts) AS dirty FROM change WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1), tried AS (SELECT *, dirty AS sent_at, listing_id % 3 = 0 AS failed FROM old WHERE listing_id % 2 = 0),
kept AS (SELECT old.listing_id, old.dirty, CASE WHEN t.failed THEN 1 ELSE 0 END AS attempts, CASE WHEN t.failed THEN TIMESTAMP '2024-01-15' + INTERVAL 30 SECONDS ELSE old.dirty END AS next_try_at, CASE WHEN t.failed THEN 'no answer' END AS last_error FROM old LEFT JOIN tried t USING (listing_id) WHERE t.listing_id IS NULL OR t.failed),
fresh AS (SELECT listing_id, max(ts) AS dirty FROM change WHERE ts >= TIMESTAMP '2024-01-29' GROUP BY 1)
SELECT coalesce(f.listing_id, k.listing_id) AS listing_id, coalesce(f.dirty, k.dirty) AS dirty_at, CASE WHEN f.dirty IS NOT NULL THEN 0 ELSE k.attempts END AS attempts, coalesce(f.dirty, k.next_try_at) AS next_try_at, CASE WHEN f.dirty IS NULL THEN k.last_error END AS last_error FROM kept k FULL JOIN fresh f ON k.listing_id = f.listing_id""")
def outbox_table(spark, sf_dir):
    """Marked, tried with some failures, and marked again."""
    c = changes(spark, sf_dir).select("listing_id", F.col("ts").alias("at"))
    none = spark.createDataFrame([], "listing_id long, dirty_at timestamp, attempts int, next_try_at timestamp, last_error string")
    dirty = outbox.marked(none, c.where("at < timestamp'2024-01-15'"), "listing_id")
    now = F.lit("2024-01-15").cast("timestamp")
    tried = outbox.claimed(dirty, now).where("listing_id % 2 = 0").select("listing_id", F.col("dirty_at").alias("sent_at"), F.when(F.col("listing_id") % 3 == 0, "no answer").alias("error"))
    return outbox.marked(outbox.settled(dirty, tried, "listing_id", now), c.where("at >= timestamp'2024-01-29'"), "listing_id")


_SIM = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query("STR-05_similar_words", f"WITH t AS (SELECT p_partkey AS k, p_brand AS g, {_SIM} AS t FROM part), s AS (SELECT a.k AS asked, b.k AS found, len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(a.t || b.t)) AS s FROM t a JOIN t b ON a.g = b.g AND a.k <> b.k) SELECT asked, found, round(s, 6) AS similarity FROM s WHERE s >= 0.4 QUALIFY row_number() OVER (PARTITION BY asked ORDER BY s DESC, found) <= 5")
def similar_words(spark, sf_dir):
    """The five most similar names of the same brand, by the trigrams of their words, at 0.4 or more."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("g"), text.fold(F.col("p_name")).alias("name"))
    return joins.most_similar(p, "k", "name", 0.4, 5, ["g"], of=text.word_trigrams).select("asked", "found", F.round("similarity", 6).alias("similarity"))


@query("SRC-07_features", f"WITH {POINT_SQL} SELECT vec_id, label, round(lat + 0.001, 6) AS lat, round(lon + 0.001, 6) AS lon FROM point")
def features(spark, sf_dir):
    """Squares written as GeoJSON collections and read back, with their centres."""
    path = scratch(spark, "features")
    p = points(spark, sf_dir)
    corner = lambda i, j: F.array(F.col("lon") + j, F.col("lat") + i)
    ring = F.array(*(corner(i, j) for i, j in ((0.0, 0.0), (0.0, 0.002), (0.002, 0.002), (0.002, 0.0), (0.0, 0.0))))
    one = F.struct(F.lit("Feature").alias("type"), F.struct("vec_id", "label").alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    # One collection a line, each of up to a thousand features, as pages of a service come.
    pages = p.select(F.floor(F.col("vec_id") / 1000).alias("page"), one.alias("f")).groupBy("page").agg(F.collect_list("f").alias("features")).select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value"))
    pages.write.text(path)
    back = files.read_features(spark, path, "vec_id: bigint, label: int", lines=True)
    # The ring says its first corner again; a centre counts each once, around the corner for precision.
    first = F.get("ring", F.lit(0))
    near = F.transform(F.slice("ring", F.lit(1), F.size("ring") - 1), lambda q: F.struct((q["lat"] - first["lat"]).alias("lat"), (q["lon"] - first["lon"]).alias("lon")))
    mid = geo.centroid(near)
    return back.select("vec_id", "label", F.round(mid["lat"] + first["lat"], 6).alias("lat"), F.round(mid["lon"] + first["lon"], 6).alias("lon"))


@query("SRC-09_embedded", "SELECT o_orderkey, o_totalprice AS price, CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority || ' {\"}\\' END AS title, o_orderkey % 3 AS rooms FROM orders WHERE o_orderkey % 9 > 0")
def embedded(spark, sf_dir):
    """Data in a script of a page, found by counting braces outside strings, as typed rows; pages without it have none."""
    k = F.col("o_orderkey")
    title = F.when(k % 4 > 0, F.concat("o_orderpriority", F.lit(' {"}\\')))
    blob = F.to_json(F.struct(F.struct(k.alias("id"), F.col("o_totalprice").alias("price"), title.alias("title"), F.struct((k % 3).alias("rooms")).alias("attributes")).alias("item")))
    page = F.when(k % 9 > 0, F.concat(F.lit("<p>{</p><script>window.state = "), blob, F.lit("; other({});</script>}"))).otherwise(F.lit("<p>no data {}</p>"))
    found = table(spark, sf_dir, "orders").select(files.embedded_json(page, "window.state").alias("j")).where("j is not null")
    item = F.from_json("j", "item struct<id: bigint, price: double, title: string, attributes: struct<rooms: bigint>>")["item"]
    return found.select(item["id"].alias("o_orderkey"), item["price"].alias("price"), item["title"].alias("title"), item["attributes"]["rooms"].alias("rooms"))


@query("SRC-11_rates", "WITH rate AS (SELECT DISTINCT o_orderdate::DATE AS day, 30000 + dayofyear(o_orderdate) AS uf FROM orders WHERE dayofweek(o_orderdate) NOT IN (0, 6)) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, uf::DOUBLE AS uf FROM lineitem ASOF LEFT JOIN rate ON l_shipdate >= day")
def rates(spark, sf_dir):
    """A daily series as a JSON-lines cache, read back; each line takes the last rate published by its day (none at weekends)."""
    path = scratch(spark, "rates")
    day = F.col("o_orderdate").cast("date")
    table(spark, sf_dir, "orders").where(~F.dayofweek(day).isin(1, 7)).select(day.cast("string").alias("day"), (30000 + F.dayofyear(day)).cast("double").alias("uf")).distinct().write.json(path)
    series = spark.read.schema("day date, uf double").json(path)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return joins.as_of(lines, series, "l_shipdate", "day", ["uf"]).drop("l_shipdate")


@query("Q-24_parcel_shapes", "SELECT p_partkey, p_brand AS status, CASE WHEN p_partkey % 6 > 0 THEN 5 END AS corners, CASE WHEN p_partkey % 6 > 0 THEN round(-33.4 + p_size * 0.001, 6) END AS north FROM part WHERE p_size > 5")
def parcel_shapes(spark, sf_dir):
    """Captured properties with their status, and the simplified shape of their roll's parcel where one is known."""
    p = table(spark, sf_dir, "part")
    at = lambda i, j: F.struct((-33.4 + i * F.col("p_size") * 0.001).alias("lat"), (-70.6 + j * F.col("p_size") * 0.001).alias("lon"))
    ring = F.array(at(0, 0), at(0, 0.5), at(0, 1), at(0.5, 1.4), at(1, 1), at(1, 0))
    shapes = p.where("p_partkey % 6 > 0").select("p_partkey", geo.simplified(ring, 3.0).alias("ring"))
    captured = p.where("p_size > 5").select("p_partkey", F.col("p_brand").alias("status"))
    return captured.join(shapes, "p_partkey", "left").select("p_partkey", "status", F.when(F.col("ring").isNotNull(), F.size("ring")).alias("corners"), F.round(F.array_max(F.transform("ring", lambda q: q["lat"])), 6).alias("north"))


@query("SRC-06_geo_parquet", f"WITH {POINT_SQL} SELECT vec_id, label, 93 AS bytes, round(lat, 6) AS lat, round(lon, 6) AS lon FROM point")
def geo_parquet(spark, sf_dir):
    """Squares in GeoParquet by commune, read back with the first corner of each."""
    path = scratch(spark, "geoparquet")
    corner = lambda i, j: F.struct((F.col("lat") + i).alias("lat"), (F.col("lon") + j).alias("lon"))
    ring = F.array(*(corner(i, j) for i, j in ((0.0, 0.0), (0.0, 0.002), (0.002, 0.002), (0.002, 0.0), (0.0, 0.0))))
    points(spark, sf_dir).select("vec_id", packages.wkb_polygon(ring).alias("geometry"), "label").write.partitionBy("label").parquet(path)
    back = packages.read_geo_parquet(spark, path, ["vec_id", "label"])
    first = F.get(F.get("ring", F.lit(0)), F.lit(0))
    shapes = back.select("vec_id", "label", (F.length("geometry_hex") / 2).cast("int").alias("bytes"), packages.wkb_rings(F.unhex("geometry_hex")).alias("ring"))
    return shapes.select("vec_id", "label", "bytes", F.round(first["lat"], 6).alias("lat"), F.round(first["lon"], 6).alias("lon"))


@query("SRC-08_zipped_parcels", """SELECT s_suppkey, CASE WHEN s_suppkey % 4 < 3 THEN s_nationkey END AS nation, CASE WHEN s_suppkey % 4 < 3 THEN s_suppkey % 4 + 1 END AS found_by, round(s_acctbal / 1000, 6) AS lat FROM supplier""")
def zipped_parcels(spark, sf_dir):
    """Archives with a GeoJSON file each; the file's name says the commune by code, by name, or by name with accents."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.concat(F.lit("C"), F.col("n_nationkey").cast("string")).alias("code"))
    # A small table is read by one task: its archives are dealt over all, since packing is what takes long.
    s = table(spark, sf_dir, "supplier").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "s_suppkey").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    kind, x = F.col("s_suppkey") % 4, (F.col("s_acctbal") / 1000)
    name = F.when(kind == 0, F.concat_ws("_", "code", F.lit("?"))).when(kind == 1, F.concat(F.lit("_"), F.lower("n_name"))).when(kind == 2, F.concat(F.lit("_"), F.translate("n_name", "AEIOU", "ÁÉÍÓÚ"))).otherwise("_nowhere")
    ring = F.array(*(F.array(F.lit(j), x + i) for i, j in ((0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0))))
    one = F.struct(F.struct("s_suppkey").alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    text_of = F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(one).alias("features")))
    archive = packages.zipped(F.array(F.concat(F.lit("parcels/"), name, F.lit(".geojson")), F.lit("readme.txt")), F.array(text_of, F.lit("-")))
    entries = packages.unzipped(s.select(F.col("s_suppkey").cast("string").alias("path"), archive.alias("content"))).where("name like '%.geojson'")
    parcels = files.features_in(entries.select("name", F.decode("content", "UTF-8").alias("json")), F.col("json"), "s_suppkey: bigint").drop("json")
    named = lambda i: F.nullif(F.get(F.split(F.substring_index("name", ".geojson", 1), "_", 2), F.lit(i)), F.lit(""))
    keys = [(named(0), F.col("code")), (F.lower(named(1)), F.lower("n_name")), (text.fold(named(1)), text.fold(F.col("n_name")))]
    found = joins.first_match(parcels, n, "n_nationkey", keys, "nation", "found_by")
    return found.select("s_suppkey", "nation", "found_by", F.round(F.get("ring", F.lit(0))["lat"], 6).alias("lat"))


@query("STM-11_debounced", CHANGE_SQL.join(("WITH ", "")) + """, c AS (SELECT listing_id, event_id, epoch_us(ts) // 1440 AS t FROM change), g AS (SELECT *, t // 60000000 AS m, coalesce(t - lag(t) OVER (PARTITION BY listing_id, t // 60000000 ORDER BY t, event_id) > 2000000, true)::INT AS new FROM c),
b AS (SELECT *, sum(new) OVER (PARTITION BY listing_id, m ORDER BY t, event_id) AS burst FROM g) SELECT listing_id, make_timestamp(least((m + 1) * 60000000, max(t) + 2000000)) AS sent_at, count(*) AS n, arg_max(event_id, (t, event_id)) AS last FROM b GROUP BY listing_id, m, burst""")
def debounced(spark, sf_dir):
    """Bursts of changes with a day of the table as a minute, as its changes lie hours apart."""
    c = changes(spark, sf_dir).select("listing_id", "event_id", F.timestamp_micros(F.expr("unix_micros(cast(ts as timestamp)) div 1440")).alias("at"))
    return outbox.bursts(c, "listing_id", "at", F.col("event_id"))
