"""Upserts of further kinds, searches by code, fields of adverts, polygons, merges, price bands and dashboards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import documents, geo, numeric, text
from ..operators import aggregates as A
from ..operators import entity, latest, upsert
from ..operators.storage import scratch
from ..sources.domain import CHANGE_SQL, LISTING_SQL, POINT_SQL, changes, listings, points, table
from .registry import book

QUERIES, SQL, query = book()
L, C, P = f"WITH {LISTING_SQL} ", f"WITH {CHANGE_SQL} ", f"WITH {POINT_SQL} "


@query("SNK-05_replaced_partitions", "SELECT c_custkey, c_acctbal AS balance, c_nationkey FROM customer WHERE c_nationkey >= 5 UNION ALL SELECT min(c_custkey), 0, c_nationkey FROM customer WHERE c_nationkey < 5 GROUP BY c_nationkey")
def replaced_partitions(spark, sf_dir):
    """A second load replaces the partitions it has rows of, and no other."""
    path, c = scratch(spark, "partitions"), table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"), "c_nationkey")
    upsert.replace_partitions(c, path, ["c_nationkey"])
    again = c.where("c_nationkey < 5").groupBy("c_nationkey").agg(F.min("c_custkey").alias("c_custkey"), F.lit(0.0).alias("balance"))
    upsert.replace_partitions(again, path, ["c_nationkey"])
    return spark.read.schema("c_custkey long, balance double, c_nationkey int").parquet(path)


@query("SNK-07_refreshed_views", "SELECT * FROM (VALUES ('parts', true, NULL::VARCHAR), ('zones', true, NULL)) v(view, ok, detail)")
def refreshed_views(spark, sf_dir):
    zones = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    parts = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.max("p_size").alias("most"))
    return upsert.refresh({"zones": zones, "parts": parts}, scratch(spark, "views"))


@query("SNK-08_content_store", """SELECT DISTINCT sha256('{"p_brand":"' || p_brand || '","p_size":' || p_size || '}') AS hash, p_brand, p_size FROM part""")
def content_store(spark, sf_dir):
    """Content is stored once under its hash, whatever comes again."""
    p = table(spark, sf_dir, "part")
    blobs = lambda rows: rows.select(documents.content_hash(["p_size", "p_brand"]).alias("hash"), "p_brand", "p_size").distinct()
    return upsert.insert_new(blobs(p.where("p_partkey % 2 = 0")), blobs(p), ["hash"])


@query("SNK-10_computed_key", "SELECT c_custkey, CASE WHEN c_nationkey > 0 OR c_custkey % 3 = 0 THEN c_nationkey END AS nation, c_acctbal + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS balance FROM customer")
def computed_key(spark, sf_dir):
    """No nation and nation 0 are the same key."""
    c = table(spark, sf_dir, "customer")
    old = c.select("c_custkey", F.nullif(F.col("c_nationkey"), F.lit(0)).alias("nation"), F.col("c_acctbal").alias("balance"))
    new = c.where("c_custkey % 3 = 0").select("c_custkey", F.col("c_nationkey").alias("nation"), (F.col("c_acctbal") + 1).alias("balance"))
    keyed = lambda rows: rows.withColumn("k", F.coalesce("nation", F.lit(0)))
    return upsert.upsert(keyed(old), keyed(new), ["c_custkey", "k"]).drop("k")


@query("SNK-11_partial_update", "SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 AND s_suppkey % 2 = 0 THEN 0 ELSE s_acctbal END::DOUBLE AS balance, CASE WHEN s_suppkey % 5 = 0 AND s_suppkey % 2 = 1 THEN 'renamed' ELSE s_name END AS name FROM supplier")
def partial_update(spark, sf_dir):
    """Only the fields that were sent are written."""
    old = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"))
    even = F.col("s_suppkey") % 2 == 0
    new = old.where("s_suppkey % 5 = 0").select("s_suppkey", F.when(even, 0.0).alias("balance"), F.when(~even, "renamed").alias("name"))
    return upsert.upsert(old, new, ["s_suppkey"], {"balance": upsert.NEW_ELSE_OLD, "name": upsert.NEW_ELSE_OLD})


@query("SNK-12_counted_upsert", L + ", n AS (SELECT advertiser_id, count(*) AS ads, min(zone) AS sample FROM listing GROUP BY 1), o AS (SELECT s_suppkey AS advertiser_id FROM supplier WHERE s_suppkey % 2 = 0) SELECT advertiser_id, coalesce(ads, 0) AS ads, sample, CASE WHEN o.advertiser_id IS NULL THEN 'insert' WHEN n.advertiser_id IS NULL THEN 'keep' ELSE 'update' END AS action FROM o FULL JOIN n USING (advertiser_id)")
def counted_upsert(spark, sf_dir):
    """Counts and a sample of each advertiser, put into a table that knows half of them."""
    old = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("advertiser_id"), F.lit(0).cast("long").alias("ads"), F.lit(None).cast("string").alias("sample"))
    new = listings(spark, sf_dir).groupBy("advertiser_id").agg(F.count(F.lit(1)).alias("ads"), F.min("zone").alias("sample"))
    return upsert.upsert(old, new, ["advertiser_id"], action="action")


@query("SNK-13_replaced_children", "SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS quantity FROM lineitem WHERE l_orderkey % 4 <> 0 OR l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT o_orderkey, 0, o_totalprice FROM orders WHERE o_orderkey % 4 = 0")
def replaced_children(spark, sf_dir):
    """New parents bring their lines; the old lines go."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), F.col("l_quantity").cast("double").alias("quantity"))
    fresh = table(spark, sf_dir, "orders").where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(0).alias("l_linenumber"), F.col("o_totalprice").alias("quantity"))
    return upsert.replace_children(lines, fresh, fresh, "l_orderkey")


@query("FLT-10_search_box", """SELECT p_partkey, CASE WHEN m = 0 THEN 'MLC-' || (p_partkey + 2000000000) END AS advert_id, CASE WHEN m = 2 THEN 'https://example.org/x/' || p_partkey END AS url, CASE m WHEN 1 THEN '' || p_partkey WHEN 3 THEN 'PI-' || p_partkey END AS code,
CASE m WHEN 1 THEN '' || p_partkey WHEN 2 THEN 'example.org/x/' || p_partkey WHEN 3 THEN 'PI-' || p_partkey END AS like_text, m = 0 AS fetchable FROM (SELECT p_partkey, p_partkey % 4 AS m FROM part)""")
def search_box(spark, sf_dir):
    k, m = F.col("p_partkey").cast("string"), F.col("p_partkey") % 4
    typed = F.when(m == 0, F.concat(F.lit(" mlc"), (F.col("p_partkey") + 2_000_000_000).cast("string"))).when(m == 1, k).when(m == 2, F.concat(F.lit("https://example.org/x/"), k, F.lit("/?a=1#b"))).otherwise(F.concat(F.lit('"PI-'), k, F.lit('" ')))
    return table(spark, sf_dir, "part").select("p_partkey", text.search_box(typed).alias("q")).select("p_partkey", "q.*")


@query("FLT-11_roll_or_address", "SELECT p_partkey AS asked, CASE WHEN p_partkey % 3 < 2 THEN p_partkey END AS found, CASE p_partkey % 3 WHEN 0 THEN 'roll' WHEN 1 THEN 'address' ELSE 'other' END AS source FROM part")
def roll_or_address(spark, sf_dir):
    """A roll number is looked up as such, an address by its usual form; the rest goes on to another source."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey").cast("string")
    known = p.select(F.col("p_partkey").alias("found"), F.concat(k, F.lit("-"), F.col("p_size").cast("string")).alias("roll"), F.concat(F.lit("AVENIDA ITALIA "), k).alias("address"))
    kind = F.col("p_partkey") % 3
    typed = F.when(kind == 0, F.concat(F.lit("00"), k, F.lit("-0"), F.col("p_size").cast("string"))).when(kind == 1, F.concat(F.lit("Av. Itália "), k)).otherwise("?")
    asked = p.select(F.col("p_partkey").alias("asked"), text.roll(typed).alias("roll"), text.address(typed).alias("address"))
    rolls = asked.join(known.select("roll", F.col("found").alias("by_roll")), "roll", "left")
    addresses = known.select("address", F.col("found").alias("by_address"))
    both = rolls.withColumn("address", F.when(F.col("roll").isNull(), F.col("address"))).join(addresses, "address", "left")
    source = F.when(F.col("by_roll").isNotNull(), "roll").when(F.col("by_address").isNotNull(), "address").otherwise("other")
    return both.select("asked", F.coalesce("by_roll", "by_address").alias("found"), source.alias("source"))


@query("STR-13_14_brokers", "SELECT s_suppkey, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) AS agency, lpad(s_suppkey::VARCHAR, 9, '0') AS phone FROM supplier")
def brokers(spark, sf_dir):
    number = F.concat(F.lit("(+56) "), F.lpad(F.col("s_suppkey").cast("string"), 9, "0"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.agency(F.concat(F.lit("· "), F.col("s_name"))).alias("agency"), text.phone(number).alias("phone"))


@query("STR-15_resolved_places", "SELECT s_suppkey, s_nationkey AS nation FROM supplier")
def resolved_places(spark, sf_dir):
    """The first part of a text that names a place."""
    known = table(spark, sf_dir, "nation").select(text.fold(F.concat(F.lit("Villa "), F.col("n_nationkey").cast("string"))).alias("name"), F.col("n_nationkey").alias("nation"))
    typed = F.concat(F.lit("Calle 1, Comuna de Villa "), F.col("s_nationkey").cast("string"), F.lit(" / Villa 1"))
    names = table(spark, sf_dir, "supplier").select("s_suppkey", F.posexplode(text.place_names(typed)).alias("i", "name"))
    return names.join(known, "name").groupBy("s_suppkey").agg(F.min_by("nation", "i").alias("nation"))


@query("STR-17_19_20_21_25_fields", """SELECT p_partkey, greatest(p_partkey * 10, p_size) AS land, least(p_partkey * 10, p_size) AS built, CASE WHEN p_size % 2 = 0 THEN 'rent' ELSE 'sale' END AS operation, CASE WHEN p_partkey % 2 = 0 THEN 'casa' END AS property_type, p_partkey % 3 = 0 AS is_development,
p_size % 4 = 0 AS company, p_partkey * 1000 AS debt, 'Casa & patio ' || p_size AS plain FROM part""")
def fields(spark, sf_dir):
    k, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    title = F.concat(F.lit("Casa "), (F.col("p_partkey") * 10).cast("string"), F.lit("/"), size, F.lit(" Mt2"))
    domain = F.concat(F.lit("MLC-"), F.when(F.col("p_partkey") % 2 == 0, "HOUSES").otherwise("OFFICES"), F.when(F.col("p_size") % 2 == 0, "_FOR_RENT").otherwise("_FOR_SALE"), F.when(F.col("p_partkey") % 3 == 0, "_DEVELOPMENT").otherwise(""))
    owner = F.when(F.col("p_size") % 4 == 0, "Inversiones Sur").otherwise("Ana Soto")
    debt = text.labelled_amount(F.concat(F.lit("Multas CLP 5\nTotal deuda: CLP "), k, F.lit(".000")), "total deuda")
    page = F.concat(F.lit("<style>p{}</style><p>Casa &amp; <b>patio</b>\n"), size, F.lit("</p>"))
    rows = table(spark, sf_dir, "part").select("p_partkey", text.areas(title).alias("a"), text.domain_kind(domain).alias("d"), text.is_company(owner).alias("company"), debt.alias("debt"), text.without_tags(page).alias("plain"))
    return rows.select("p_partkey", F.col("a.land").cast("long").alias("land"), F.col("a.built").cast("long").alias("built"), "d.*", "company", "debt", "plain")


@query("GEO-07_08_polygons", P + "SELECT vec_id, round(lat, 6) AS lat, round(lon, 6) AS lon, abs(lat + 33.4) <= 0.015 AND abs(lon + 70.6) <= 0.015 AS meets FROM point")
def polygons(spark, sf_dir):
    """The centre of a square around each point, and whether it meets a square area."""

    def square(lat, lon, half):
        return F.array(*(F.struct((lat + a * half).alias("lat"), (lon + b * half).alias("lon")) for a, b in ((-1, -1), (-1, 1), (1, 1), (1, -1))))

    # Around the area's centre: far from it a corner's rounding is wider than the gap between squares that just miss each other.
    ring, area = square(F.col("lat") + 33.4, F.col("lon") + 70.6, 0.005), square(F.lit(0.0), F.lit(0.0), 0.01)
    mid = geo.centroid(F.col("ring"))
    # The ring is a column before any other is named: beside a new lat, lambdas would take that one, rounded, for the point's.
    rings = points(spark, sf_dir).select("vec_id", ring.alias("ring"))
    return rings.select("vec_id", F.round(mid["lat"] - 33.4, 6).alias("lat"), F.round(mid["lon"] - 70.6, 6).alias("lon"), geo.rings_meet(F.col("ring"), area).alias("meets"))


@query("GEO-12_doubtful_pins", "SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN ['centre', 'few_decimals', 'trailing_zeros'] ELSE []::VARCHAR[] END AS doubts FROM embeddings")
def doubtful_pins(spark, sf_dir):
    lat = F.when(F.col("vec_id") % 2 == 0, -33.5).otherwise(-33.123457)
    return table(spark, sf_dir, "embeddings").select("vec_id", geo.pin_doubts(lat, F.lit(-70.654321), F.lit(-33.5), F.lit(-70.654321)).alias("doubts"))


@query("ER-06_07_21_identity", """WITH s AS (SELECT o_orderkey, (o_custkey % 5) / 4.0 AS t, o_orderkey % 3 AS g, o_custkey % 2 = 0 AS parcel, o_orderkey % 5 = 0 AS bad FROM orders),
w AS (SELECT *, 0.30 * t AS a, CASE g WHEN 0 THEN 0.25 WHEN 1 THEN -0.25 ELSE 0 END AS b, CASE WHEN parcel AND NOT bad THEN 0.20 ELSE 0 END AS c, CASE WHEN bad THEN -0.25 ELSE 0 END AS d FROM s), v AS (SELECT *, 1 / (1 + exp(-3.0 * (a + b + c + d))) AS p FROM w)
SELECT o_orderkey, round(p, 6) AS score, CASE WHEN bad AND p < 0.75 THEN 'pin_suspect' WHEN p >= 0.75 AND parcel THEN 'confirmed' WHEN p >= 0.45 THEN 'candidate' ELSE 'none' END AS place,
CASE WHEN p >= 0.90 THEN 'confirmed' WHEN p >= 0.75 THEN 'candidate' ELSE 'rejected' END AS strict, CASE WHEN b >= 0 THEN '+' ELSE '' END || 'geocode(' || printf('%.2f', b::DOUBLE) || ')' AS said FROM v""")
def identity(spark, sf_dir):
    """Score of a property's place, two decisions on it, and its geocode in words."""
    g, parcel, bad = F.col("o_orderkey") % 3, F.col("o_custkey") % 2 == 0, F.col("o_orderkey") % 5 == 0
    unknown = F.lit(None).cast("double")
    parts = entity.identity_parts((F.col("o_custkey") % 5) / 4, F.when(g < 2, g == 0), parcel, bad, unknown, unknown)
    score = numeric.sigmoid(sum(parts.values(), F.lit(0.0)), 3)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(score, 6).alias("score"), entity.location_confidence(score, parcel, bad).alias("place"), entity.decision(score, F.lit(True), 0.90, 0.75).alias("strict"), entity.explained({"geocode": parts["geocode"]}).alias("said"))


@query("ER-08_fed_pairs", "SELECT p_partkey AS a, p_partkey + 1 AS b, CASE WHEN p_partkey % 6 = 0 THEN 0.5 ELSE 0.8 END::DOUBLE AS score, CASE WHEN p_partkey % 6 = 0 THEN 'rejected' ELSE 'confirmed' END AS status, CASE WHEN p_partkey % 6 = 0 THEN 'person' ELSE 'auto' END AS decided_by FROM part WHERE p_partkey % 3 = 0")
def fed_pairs(spark, sf_dir):
    """New scores of pairs in either order; a person's decision stays, one property's pairs don't count."""
    k = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    old = k.where("k % 6 = 0").select(F.col("k").alias("a"), (F.col("k") + 1).alias("b"), F.lit(0.5).alias("score"), F.lit("rejected").alias("status"), F.lit("person").alias("decided_by"))
    one = k.select(F.col("k").alias("a"), (F.col("k") + 1).alias("b"), F.lit(0.8).alias("score"), F.when(F.col("k") % 3 == 1, "rejected").otherwise("confirmed").alias("status"), (F.col("k") % 3 == 2).alias("same_property"))
    return entity.fed_pairs(old, one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "score", "status", "same_property")))


@query("ER-10_split_clusters", "SELECT node, CASE WHEN node % 30 <= 10 THEN node - node % 30 ELSE node END AS cluster FROM (SELECT p_partkey AS node FROM part UNION SELECT p_partkey + 1 FROM part WHERE p_partkey % 30 < 29)")
def split_clusters(spark, sf_dir):
    """Chains of over 20 nodes fall into their strong parts and single nodes."""
    k = F.col("p_partkey")
    return entity.clusters(table(spark, sf_dir, "part").where(k % 30 < 29).select(k.alias("a"), (k + 1).alias("b"), F.when(k % 30 < 10, 0.95).otherwise(0.8).alias("score")))


@query("ER-13_merge_plan", "SELECT p_partkey AS listing, p_partkey // 5 AS property, CASE WHEN c % 20 = 0 THEN c // 5 ELSE -1 END AS survivor, CASE WHEN p_partkey % 10 < 3 THEN 0.9::DOUBLE END AS confidence, c % 20 <> 0 AS moves FROM (SELECT p_partkey, p_partkey - p_partkey % 10 AS c FROM part) WHERE p_partkey % 10 < 5 AND c IN (SELECT p_partkey - p_partkey % 10 FROM part WHERE p_partkey % 10 < 3)")
def merge_plan(spark, sf_dir):
    """Matched listings and all others of the properties they touch, with the property that stays."""
    k, c = F.col("p_partkey"), F.col("p_partkey") - F.col("p_partkey") % 10
    p = table(spark, sf_dir, "part")
    nodes = p.where(k % 10 < 3).select(k.alias("listing"), c.alias("cluster"), F.lit(0.9).alias("confidence"))
    survivors = p.select(c.alias("cluster")).distinct().select("cluster", F.when(F.col("cluster") % 20 == 0, F.floor(F.col("cluster") / 5)).otherwise(-1).alias("survivor"))
    return entity.merge_plan(nodes, p.select(k.alias("listing"), F.floor(k / 5).alias("property")), survivors)


@query("STM-06_price_bands", """WITH n AS (SELECT d, p FROM range(9) t(d), range(256) u(p) WHERE p < (1::BIGINT << d)), o AS (SELECT least(floor(o_totalprice / 2048)::BIGINT, 255) AS band FROM orders), t AS (SELECT d, p, count(band) AS total FROM n LEFT JOIN o ON band >> (8 - d) = p GROUP BY d, p)
SELECT (p * (524288 >> d))::DOUBLE AS low, ((p + 1) * (524288 >> d))::DOUBLE AS high, total FROM t WHERE (total <= 300 OR d = 8) AND NOT EXISTS (SELECT 1 FROM t a WHERE a.d < t.d AND a.total <= 300 AND a.p = t.p >> (t.d - a.d))""")
def bands(spark, sf_dir):
    return A.price_bands(table(spark, sf_dir, "orders"), "o_totalprice", 524_288, 300)


@query("STM-14_change_list", "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN ['segment', 'balance'] WHEN c_custkey % 2 = 0 THEN ['balance'] ELSE ['segment'] END AS changes FROM customer WHERE c_custkey % 7 = 0 OR c_custkey % 2 = 0 OR c_custkey % 3 = 0 AND c_mktsegment <> 'x'")
def change_list(spark, sf_dir):
    """History only of what changed, with the names of the fields; a new key lists all."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    k = F.col("c_custkey")
    new = c.withColumn("balance", F.when(k % 2 == 0, F.col("balance") + 1).otherwise(F.col("balance"))).withColumn("segment", F.when((k % 2 != 0) & (k % 3 == 0), "x").otherwise(F.col("segment")))
    return upsert.with_change_list(c.where(k % 7 != 0), new, ["c_custkey"], ["segment", "balance"]).select("c_custkey", "changes")


@query("STM-15_resumed", C + "SELECT event_id FROM change WHERE listing_id NOT IN (SELECT listing_id FROM change WHERE k % 100 = 0)")
def resumed(spark, sf_dir):
    """What a run that was cut off has still to do: rows whose key isn't among the finished ones."""
    c = changes(spark, sf_dir)
    return c.join(c.where("k % 100 = 0").select("listing_id").distinct(), "listing_id", "left_anti").select("event_id")


@query("STM-16_price_series", C + ", v AS (SELECT listing_id, ts, event_id, price, lag(price) OVER (PARTITION BY listing_id ORDER BY ts, event_id) AS before FROM change) SELECT listing_id, event_id, row_number() OVER (PARTITION BY listing_id ORDER BY ts, event_id) AS step, price, CASE WHEN before IS NULL THEN 'start' WHEN price > before THEN 'up' ELSE 'down' END AS kind FROM v WHERE before IS NULL OR price <> before")
def price_series(spark, sf_dir):
    """A listing's prices in order, repeats left out, each with its kind of change."""
    w = Window.partitionBy("listing_id").orderBy("ts", "event_id")
    v = changes(spark, sf_dir).select("listing_id", "ts", "event_id", "price", F.lag("price").over(w).alias("before")).where("before is null or price <> before")
    kind = F.when(F.col("before").isNull(), "start").when(F.col("price") > F.col("before"), "up").otherwise("down")
    return latest.ranked(v, ["listing_id"], [F.asc("ts"), F.asc("event_id")], "step").select("listing_id", "event_id", "step", "price", kind.alias("kind"))


@query("Q-21_22_dashboards", "SELECT n_name AS zone, count(*) AS rolls, count(*) FILTER (c_acctbal < 0) AS in_debt, coalesce(sum(CASE WHEN c_acctbal < 0 THEN -c_acctbal::DECIMAL(18,2) END), 0)::DOUBLE AS debt, max(c_custkey) AS last_job FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def dashboards(spark, sf_dir):
    c, b = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")), F.col("c_acctbal")
    return c.groupBy(F.col("n_name").alias("zone")).agg(F.count(F.lit(1)).alias("rolls"), A.count_if(b < 0).alias("in_debt"), F.coalesce(A.exact_sum(F.when(b < 0, -b)), F.lit(0.0)).alias("debt"), F.max("c_custkey").alias("last_job"))
