"""Scalar functions over texts made from the tables, files written and read back, and further matching and queue steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import documents, geo, numeric, text
from ..operators import aggregates as A
from ..operators import entity, filters, latest
from ..operators.storage import scratch
from ..sources import files
from ..sources.domain import CHANGE_SQL, LISTING_SQL, PHASH_SQL, POINT_SQL, changes, listings, picture_hashes, points, table
from .registry import book

QUERIES, SQL, query = book()
L, C, P = f"WITH {LISTING_SQL} ", f"WITH {CHANGE_SQL} ", f"WITH {POINT_SQL} "


_ADDRESS = "'Av. ' || c_name || ' ' || c_custkey || ' dp ' || (c_custkey % 40)"


@query("STR-08_11_addresses", f"""WITH a AS (SELECT c_custkey, {_ADDRESS} AS s FROM customer), n AS (SELECT c_custkey, s, trim(regexp_replace(regexp_replace(regexp_replace(upper(s), '[^A-Z0-9 ]', ' ', 'g'), '\\bAV\\b', 'AVENIDA', 'g'), '\\s+', ' ', 'g')) AS address FROM a)
SELECT c_custkey, address, regexp_extract(address, '^(.+?)\\s+(\\d+)', 1) AS street, regexp_extract(address, '^(.+?)\\s+(\\d+)', 2)::INT AS number, regexp_replace(upper(s), ' DP .*$', '') AS base, true AS unit FROM n""")
def addresses(spark, sf_dir):
    s = F.concat(F.lit("Av. "), F.col("c_name"), F.lit(" "), F.col("c_custkey").cast("string"), F.lit(" dp "), (F.col("c_custkey") % 40).cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.address(s).alias("address"), text.street(s).alias("street"), text.street_number(s).alias("number"), text.base_address(s).alias("base"), text.is_unit(s).alias("unit"))


@query("STR-12_24_codes", """SELECT o_orderkey, (o_custkey % 900) || '-' || (o_orderkey % 100) AS roll, lpad((o_custkey % 900)::VARCHAR, 5, '0') || '-' || lpad((o_orderkey % 100)::VARCHAR, 5, '0') AS padded,
right('56912' || lpad(o_custkey::VARCHAR, 6, '0'), 9) AS phone, 'P-' || strftime(o_orderdate, '%y%m') || '-' || lpad((row_number() OVER (PARTITION BY strftime(o_orderdate, '%y%m') ORDER BY o_orderdate, o_orderkey))::VARCHAR, 5, '0') AS ref FROM orders""")
def codes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("ym", F.date_format("o_orderdate", "yyMM"))
    o = latest.ranked(o, ["ym"], [F.asc("o_orderdate"), F.asc("o_orderkey")], "seq")
    raw = F.concat(F.lit("000"), (F.col("o_custkey") % 900).cast("string"), F.lit("-00"), (F.col("o_orderkey") % 100).cast("string"))
    number = F.concat(F.lit("+56 912 "), F.lpad(F.col("o_custkey").cast("string"), 6, "0"))
    ref = F.concat(F.lit("P-"), F.col("ym"), F.lit("-"), F.lpad(F.col("seq").cast("string"), 5, "0"))
    return o.select("o_orderkey", text.roll(raw).alias("roll"), text.roll_padded(raw).alias("padded"), text.phone(number).alias("phone"), ref.alias("ref"))


@query("STR-18_22_23_adverts", """SELECT p_partkey, p_size * CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 7 WHEN 2 THEN 30 ELSE 365 END AS days, CASE WHEN p_size % 3 = 0 THEN 'shop' WHEN p_size % 3 = 1 THEN 'portal' ELSE 'other' END AS platform, 'https://example.org/' || p_partkey AS url FROM part""")
def adverts(spark, sf_dir):
    unit = F.element_at(F.array(*map(F.lit, ("días", "semanas", "meses", "años"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    site = F.element_at(F.array(*map(F.lit, ("my.shop.cl", "Portal.cl", "x.org"))), F.col("p_size") % 3 + 1)
    url = F.concat(F.lit("example.org/"), F.col("p_partkey").cast("string"), F.lit("/?a=1#b"))
    return table(spark, sf_dir, "part").select("p_partkey", text.age_days(F.concat(F.lit("Publicado hace "), F.col("p_size").cast("string"), F.lit(" "), unit)).alias("days"), text.first_pattern(site, [("shop", "shop"), ("portal", "portal")], "other").alias("platform"), text.clean_url(url).alias("url"))


@query("NUM_DAT_numbers", """SELECT o_orderkey, round(o_totalprice)::BIGINT AS whole, round(least(o_totalprice, 250000) / 250000, 8) AS clamped, round(1 / (1 + exp(-3 * o_totalprice / 500000)), 6) AS p,
CASE WHEN o_totalprice <= 100000 THEN 1.0 WHEN o_totalprice < 200000 THEN round(1 - (o_totalprice - 100000) / 100000, 8) ELSE 0.0 END AS slope, year(o_orderdate) || '-' || CASE WHEN month(o_orderdate) <= 6 THEN 1 ELSE 2 END AS semester, o_orderdate::DATE AS day FROM orders""")
def numbers(spark, sf_dir):
    p, day = F.col("o_totalprice"), F.date_format("o_orderdate", "dd/MM/yyyy")
    local = F.replace(F.format_string("%.2f", p), F.lit("."), F.lit(","))
    return table(spark, sf_dir, "orders").select("o_orderkey", numeric.local_int(local).alias("whole"), F.round(numeric.clamp(p / 250_000), 8).alias("clamped"), F.round(numeric.sigmoid(p / 500_000, 3), 6).alias("p"), F.round(numeric.interpolate(p, [(100_000, 1.0), (200_000, 0.0)]), 8).alias("slope"), numeric.semester(F.col("o_orderdate")).alias("semester"), numeric.any_date(F.concat(F.lit("on "), day)).alias("day"))


@query("JSN-01_02_03_documents", """SELECT conv_id, count(*) AS turns, sha256('{"conv_id":' || conv_id || ',"n":' || count(*) || '}') AS hash, count(*) FILTER (role = 'user') AS asked FROM conversations GROUP BY conv_id""")
def json_documents(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.collect_list(F.struct("turn", "role"))).alias("j"), F.count(F.lit(1)).alias("n"))
    asked = F.json_array_length(documents.kept_elements(F.col("j"), "struct<turn:bigint,role:string>", lambda x: x["role"] == "user"))
    return t.select("conv_id", F.json_array_length("j").cast("long").alias("turns"), documents.content_hash(["n", "conv_id"]).alias("hash"), asked.cast("long").alias("asked"))


@query("SRC-01_positional", "SELECT c_custkey::VARCHAR AS k, c_name AS name, CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END AS segment FROM customer")
def positional(spark, sf_dir):
    path = scratch(spark, "pipe")
    c = table(spark, sf_dir, "customer")
    c.select(F.concat_ws("|", F.col("c_custkey").cast("string"), "c_name", F.when(F.col("c_custkey") % 5 > 0, F.col("c_mktsegment")).otherwise(""), F.lit(""))).write.text(path)
    return files.read_positional(spark, path, ["k", "name", "segment"])


@query("SRC-02_fixed_width", "SELECT p_partkey::INT AS k, p_brand AS brand, p_size AS size FROM part")
def fixed_width(spark, sf_dir):
    path = scratch(spark, "fixed")
    cell = lambda c, n: F.rpad(F.col(c).cast("string"), n, " ")
    table(spark, sf_dir, "part").select(F.concat(cell("p_partkey", 10), cell("p_brand", 20), cell("p_size", 5))).write.text(path)
    return files.read_fixed_width(spark, path, [files.Field("k", 0, 10, "int"), files.Field("brand", 10, 30), files.Field("size", 30, 35, "int")], 35)


@query("SRC-03_04_upload", "SELECT s_suppkey::VARCHAR AS roll, s_name AS name FROM supplier WHERE s_suppkey % 4 > 0")
def upload(spark, sf_dir):
    path = scratch(spark, "upload")
    table(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 4 > 0, F.col("s_suppkey")).alias("ROL"), F.col("s_name").alias("Nombre"), F.lit("x;y").alias("extra")).write.csv(path, header=True, sep=";")
    return files.read_upload(spark, path, {"rol": "roll", "nombre": "name"}, "roll")[0]


@query("SRC-05_json_lines", "SELECT event_id, event_type FROM events")
def json_lines(spark, sf_dir):
    path = scratch(spark, "lines")
    table(spark, sf_dir, "events").select("event_id", "event_type").write.json(path)
    return spark.read.schema("event_id long, event_type string").json(path)


@query("SRC-05_json_lines_whole", "SELECT event_id, event_type FROM events")
def json_lines_whole(spark, sf_dir):
    path = scratch(spark, "lines")
    table(spark, sf_dir, "events").select("event_id", "event_type").write.json(path)
    return spark.read.schema("event_id long, event_type string").json(path)


@query("SRC-09_page_titles", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def page_titles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("SNK-06_features", """SELECT count(*) FILTER (s_acctbal > 0) > 50 AS truncated FROM supplier""")
def features(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("k"), (-33.4 + F.col("s_nationkey") / 100).alias("lat"), F.lit(-70.6).alias("lon"))
    return files.as_features(s, "lat", "lon", 50).select("truncated")


@query("GEO-06_box", P + "SELECT vec_id FROM point WHERE lat BETWEEN -33.42 AND -33.38 AND lon BETWEEN -70.62 AND -70.58")
def box(spark, sf_dir):
    return points(spark, sf_dir).where(geo.in_box(F.col("lat"), F.col("lon"), -33.42, -70.62, -33.38, -70.58)).select("vec_id")


@query("GEO-14_breaks", P + ", s AS (SELECT label, list_sort(list(lat)) AS v FROM point GROUP BY label) SELECT label, round(v[len(v) // 4 + 1], 9) AS q1, round(v[len(v) * 2 // 4 + 1], 9) AS q2, round(v[len(v) * 3 // 4 + 1], 9) AS q3 FROM s")
def breaks(spark, sf_dir):
    """The sorted value at index floor(i * n / 4), with no interpolation: the row of that rank, so no list is gathered."""
    p = points(spark, sf_dir)
    r = latest.ranked(p, ["label"], [F.asc("lat"), F.asc("vec_id")], "k").join(p.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label")
    return r.groupBy("label").agg(*(F.round(F.max(F.when(F.col("k") == F.floor(F.col("n") * i / 4) + 1, F.col("lat"))), 9).alias(f"q{i}") for i in (1, 2, 3)))


@query("ER-12_survivors", L + "SELECT unit, id FROM (SELECT unit, id, row_number() OVER (PARTITION BY unit ORDER BY bedrooms DESC, first_seen, id) AS k FROM listing) WHERE k = 1")
def survivors(spark, sf_dir):
    order = F.struct((-F.col("bedrooms")).alias("b"), F.col("first_seen").alias("f"), F.col("id").alias("i"))
    return listings(spark, sf_dir).groupBy("unit").agg(F.min_by("id", order).alias("id"))


@query("ER-15_linked", L + ", r AS (SELECT advertiser_id, seller_reference, arg_min(id, (NOT is_active, -epoch(last_seen), id)) AS linked FROM listing WHERE portal = 'N' GROUP BY 1, 2) SELECT l.id, linked FROM listing l JOIN r USING (advertiser_id, seller_reference) WHERE portal = 'R'")
def linked(spark, sf_dir):
    """Adverts of one portal with the active, then newest, advert of the other with their broker and reference."""
    l, keys = listings(spark, sf_dir), ["advertiser_id", "seller_reference"]
    order = F.struct((~F.col("is_active")).alias("a"), (-F.unix_timestamp("last_seen")).alias("s"), F.col("id").alias("i"))
    best = l.where("portal = 'N'").groupBy(*keys).agg(F.min_by("id", order).alias("linked"))
    return l.where("portal = 'R'").join(best, keys).select("id", "linked")


@query("ER-17_reconciled", L + "SELECT unit, bool_or(is_active) AS is_active, count(*) AS listing_count, count(DISTINCT advertiser_id) AS broker_count FROM listing GROUP BY unit HAVING bool_or(is_active) OR count(*) > 3")
def reconciled(spark, sf_dir):
    """Derived state that differs from what is stored (inactive, three adverts at most)."""
    now = listings(spark, sf_dir).groupBy("unit").agg(F.bool_or("is_active").alias("is_active"), F.count(F.lit(1)).alias("listing_count"), F.countDistinct("advertiser_id").alias("broker_count"))
    return now.where(filters.any_of(~F.col("is_active").eqNullSafe(F.lit(False)), F.col("listing_count") > 3))


@query("ER-22_23_evidence", """SELECT o_orderkey, round(1 / (1 + exp(-(-1.2 + 4.5 * (o_custkey % 2) + CASE WHEN o_custkey % 2 = 1 AND o_orderkey % 7 > 3 THEN 0 ELSE 1.5 - 0.5 * (o_orderkey % 7) END))), 6) AS p FROM orders""")
def evidence(spark, sf_dir):
    odds = entity.evidence_odds({"address": 4.5 * (F.col("o_custkey") % 2), "distance": 1.5 - 0.5 * (F.col("o_orderkey") % 7)})
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(numeric.sigmoid(odds), 6).alias("p"))


@query("ER-28_repeated_media", PHASH_SQL.join(("WITH ", " ")) + "SELECT phash::VARCHAR AS h, count(*) AS refs, min(vec_id) AS first FROM picture GROUP BY phash")
def repeated_media(spark, sf_dir):
    unsigned = F.when(F.col("phash") >= 0, F.col("phash").cast("string")).otherwise((F.col("phash").cast("decimal(20,0)") + F.lit("18446744073709551616").cast("decimal(20,0)")).cast("string"))
    return picture_hashes(spark, sf_dir).groupBy(unsigned.alias("h")).agg(F.count(F.lit(1)).alias("refs"), F.min("vec_id").alias("first"))


@query("STM-08_queue", C + ", q AS (SELECT k, agency, event_id, ts, row_number() OVER (PARTITION BY k, agency ORDER BY ts DESC, event_id DESC) AS n FROM change) SELECT event_id, CASE WHEN n > 1 THEN 'cancelled' WHEN ts < TIMESTAMP '2024-01-28' THEN 'requeued' ELSE 'kept' END AS state FROM q")
def queue(spark, sf_dir):
    q = latest.ranked(changes(spark, sf_dir), ["k", "agency"], [F.desc("ts"), F.desc("event_id")], "n")
    return q.select("event_id", F.when(F.col("n") > 1, "cancelled").when(F.col("ts") < F.lit("2024-01-28").cast("timestamp"), "requeued").otherwise("kept").alias("state"))


@query("STM-12_since_mark", C + "SELECT event_id FROM change WHERE ts > (SELECT max(ts) - INTERVAL 3 DAYS FROM change)")
def since_mark(spark, sf_dir):
    c = changes(spark, sf_dir)
    mark = c.agg((F.max("ts") - F.expr("interval 3 days")).alias("m"))
    return c.join(F.broadcast(mark), F.col("ts") > F.col("m")).select("event_id")


@query("STM-17_health", C + "SELECT agency, count(*) FILTER (ts >= TIMESTAMP '2024-01-30') AS today, count(*) FILTER (ts >= TIMESTAMP '2024-01-24') AS week, CASE WHEN max(ts) < TIMESTAMP '2024-01-29' THEN 'late' ELSE 'ok' END AS cadence FROM change GROUP BY agency")
def health(spark, sf_dir):
    since = lambda d: F.col("ts") >= F.lit(d).cast("timestamp")
    return changes(spark, sf_dir).groupBy("agency").agg(A.count_if(since("2024-01-30")).alias("today"), A.count_if(since("2024-01-24")).alias("week"), F.when(F.max("ts") < F.lit("2024-01-29").cast("timestamp"), "late").otherwise("ok").alias("cadence"))
