"""Filters, joins, best rows, aggregates, windows, sorts and set operations over listings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import quantiles as Q
from ..operators import filters, joins, latest, paging
from ..sources.domain import CHANGE_SQL, LISTING_SQL, changes, listings, table
from .registry import book

QUERIES, SQL, query = book()
L = f"WITH {LISTING_SQL} "
C = f"WITH {CHANGE_SQL} "
AS_OF = "2024-02-01 00:00:00"


@query("FLT-01_optional_filters", L + """SELECT id, zone, price, square_meters FROM listing WHERE portal IN ('A', 'R') AND operation = 'F' AND price BETWEEN 10000 AND 60000
AND square_meters >= 10 AND bedrooms <= 4 AND CASE WHEN square_meters > 0 THEN price / square_meters END <= 1800 AND (advertiser ILIKE '%supp%' OR zone ILIKE '%supp%')""")
def optional_filters(spark, sf_dir):
    where = filters.listing_filter(portal=["A", "R"], operation="F", zone="all", price=(10_000, 60_000), area=(10, None), bedrooms=(None, 4), price_per_m2=(None, 1_800), text="supp")
    return listings(spark, sf_dir).where(where).select("id", "zone", "price", "square_meters")


@query("FLT-02_ranges", "SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice <= 1500")
def ranges(spark, sf_dir):
    return table(spark, sf_dir, "part").where(filters.all_of(filters.between(F.col("p_size"), 10, 20), filters.between(F.col("p_retailprice"), most=1500))).select("p_partkey", "p_size", "p_retailprice")


@query("FLT-03_membership", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus IN ('O', 'F') AND NOT o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def membership(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey")
    o = table(spark, sf_dir, "orders").where(filters.equals(F.col("o_orderstatus"), ["O", "F"]))
    return o.join(c.where("c_mktsegment = 'BUILDING'"), "o_custkey", "left_anti").join(c.where("c_acctbal > 0"), "o_custkey", "left_semi").select("o_orderkey", "o_orderpriority")


@query("FLT-04_free_text", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%e%1%' OR p_brand ILIKE '%e%1%'")
def free_text(spark, sf_dir):
    return table(spark, sf_dir, "part").where(filters.mentions([F.col("p_name"), F.col("p_brand")], "e%1")).select("p_partkey", "p_name")


_TERMS = "string_split(p_type || ' ' || p_name, ' ')"


@query("FLT-05_element_text", f"SELECT p_partkey FROM part WHERE len(list_filter({_TERMS}, lambda x: x ILIKE '%e%')) > 0 AND len(list_filter({_TERMS}, lambda x: x ILIKE '%1%')) > 0")
def element_text(spark, sf_dir):
    words = F.split(F.concat_ws(" ", "p_type", "p_name"), " ")
    return table(spark, sf_dir, "part").where(filters.element_mentions(words, ["e", "1"])).select("p_partkey")


@query("FLT-06_price_per_area", L + "SELECT id, round(price * 100)::BIGINT // square_meters::BIGINT AS cents_m2 FROM listing WHERE square_meters > 0 AND price / square_meters < 1000")
def price_per_area(spark, sf_dir):
    """Whole cents per square metre, cut off as an integer division does."""
    cents = F.expr("cast(round(price * 100) as bigint) div cast(square_meters as bigint)").alias("cents_m2")
    return listings(spark, sf_dir).where(filters.ratio(F.col("price"), F.col("square_meters")) < 1000).select("id", cents)


@query("FLT-07_null_safe", C + ", v AS (SELECT listing_id, ts, event_id, agency, lag(agency) OVER (PARTITION BY listing_id ORDER BY ts, event_id) AS before FROM change) SELECT event_id, agency, before FROM v WHERE agency IS DISTINCT FROM before")
def null_safe(spark, sf_dir):
    w = Window.partitionBy("listing_id").orderBy("ts", "event_id")
    return changes(spark, sf_dir).withColumn("before", F.lag("agency").over(w)).where(~F.col("agency").eqNullSafe(F.col("before"))).select("event_id", "agency", "before")


@query("FLT-08_patterns", r"SELECT p_partkey FROM part WHERE regexp_matches(p_name, '(?i)^\s*p\w+\s+\S*[0-9]\b') OR NOT regexp_matches(p_type, '[A-Z]')")
def patterns(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.col("p_name").rlike(r"(?i)^\s*p\w+\s+\S*[0-9]\b") | ~F.col("p_type").rlike("[A-Z]")).select("p_partkey")


@query("FLT-09_or_exists", "SELECT c_custkey FROM customer WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def or_exists(spark, sf_dir):
    rich = table(spark, sf_dir, "orders").where("o_totalprice > 300000").groupBy("o_custkey").agg(F.lit(True).alias("rich"))
    return table(spark, sf_dir, "customer").join(rich, F.col("c_custkey") == F.col("o_custkey"), "left").where(filters.any_of(F.col("c_acctbal") < 0, F.coalesce("rich", F.lit(False)))).select("c_custkey")


@query("FLT-12_named_predicate", L + "SELECT id, advertiser_id, price FROM listing WHERE is_active AND portal = 'N' AND price > 0")
def named_predicate(spark, sf_dir):
    listings(spark, sf_dir).where(filters.all_of(F.col("is_active"), filters.equals(F.col("portal"), "N"), F.col("price") > 0)).createOrReplaceTempView("active_leads")
    return spark.table("active_leads").select("id", "advertiser_id", "price")


@query("FLT-13_stale", C + f", last AS (SELECT listing_id, max(ts) AS last_run, max(k) AS hours FROM change GROUP BY listing_id) SELECT listing_id, last_run FROM last WHERE last_run IS NULL OR last_run < TIMESTAMP '{AS_OF}' - to_hours(hours)")
def stale(spark, sf_dir):
    last = changes(spark, sf_dir).groupBy("listing_id").agg(F.max("ts").alias("last_run"), F.max("k").alias("hours"))
    return last.where(filters.stale(F.col("last_run"), F.col("hours"), F.lit(AS_OF).cast("timestamp"))).select("listing_id", "last_run")


@query("FLT-14_not_queued", C + "SELECT DISTINCT listing_id FROM change c WHERE agency = 'view' AND NOT EXISTS (SELECT 1 FROM change q WHERE q.listing_id = c.listing_id AND q.k = 7 AND q.agency = 'click')")
def not_queued(spark, sf_dir):
    c = changes(spark, sf_dir)
    return c.where("agency = 'view'").join(c.where("k = 7 AND agency = 'click'"), "listing_id", "left_anti").select("listing_id").distinct()


@query("FLT-15_fresh_cache", C + f"SELECT listing_id, max(ts) AS ts FROM change WHERE agency <> 'error' AND ts > TIMESTAMP '{AS_OF}' - INTERVAL 96 HOURS GROUP BY listing_id")
def fresh_cache(spark, sf_dir):
    after = F.lit(AS_OF).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(96))
    return changes(spark, sf_dir).where((F.col("agency") != "error") & (F.col("ts") > after)).groupBy("listing_id").agg(F.max("ts").alias("ts"))


@query("PRJ-01_buckets", "SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS bucket, count(*) AS n FROM part GROUP BY 1")
def buckets(spark, sf_dir):
    bucket = F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "medium").otherwise("large")
    return table(spark, sf_dir, "part").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("PRJ-02_nested_ordered", "SELECT conv_id, list({'turn': turn, 'role': role, 'n': length(text)::INT} ORDER BY turn) AS turns FROM conversations GROUP BY conv_id")
def nested_ordered(spark, sf_dir):
    turn = F.struct("turn", "role", F.length("text").alias("n"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


@query("PRJ-03_padded_union", "SELECT c_custkey AS key, c_name AS name, NULL::INT AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, s_nationkey, NULL FROM supplier")
def padded_union(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.lit(None).cast("int").alias("nation"), F.col("c_acctbal").alias("balance"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return a.unionByName(b, allowMissingColumns=True)


@query("PRJ-04_flag", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS urgent FROM customer")
def flag(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey").distinct()
    return table(spark, sf_dir, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.col("o_custkey").isNotNull().alias("urgent"))


@query("JN-01_equi_joins", "SELECT o_orderpriority, count(*) AS n, count(c_custkey) AS known FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey GROUP BY 1")
def equi_joins(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    return table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count("c_custkey").alias("known"))


@query("JN-02_snowflake", L + "SELECT region, zone, count(*) AS n, sum(price::DECIMAL(18,2))::DOUBLE AS total FROM listing GROUP BY region, zone")
def snowflake(spark, sf_dir):
    return listings(spark, sf_dir).groupBy("region", "zone").agg(F.count(F.lit(1)).alias("n"), A.exact_sum(F.col("price")).alias("total"))


@query("JN-03_fallback_key", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON n_nationkey = coalesce(CASE WHEN s_suppkey % 3 > 0 THEN s_nationkey END, 0)")
def fallback_key(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumn("n_nationkey", F.coalesce(F.when(F.col("s_suppkey") % 3 > 0, F.col("s_nationkey")), F.lit(0)))
    return s.join(table(spark, sf_dir, "nation"), "n_nationkey").select("s_suppkey", "n_name")


@query("JN-04_any_key", "SELECT DISTINCT c_custkey, s_suppkey FROM (SELECT * FROM customer WHERE c_acctbal > 9000) JOIN supplier ON c_custkey = s_suppkey OR c_nationkey = s_nationkey")
def any_key(spark, sf_dir):
    return joins.join_any(table(spark, sf_dir, "customer").where("c_acctbal > 9000"), table(spark, sf_dir, "supplier"), [("c_custkey", "s_suppkey"), ("c_nationkey", "s_nationkey")], "c_custkey", "s_suppkey")


@query("JN-05_conditional_level", "SELECT s_suppkey, n_nationkey, r_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey AND (s_acctbal < 0 OR r_name <> 'ASIA')")
def conditional_level(spark, sf_dir):
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, (n["n_regionkey"] == r["r_regionkey"]) & ((s["s_acctbal"] < 0) | (r["r_name"] != "ASIA"))).select("s_suppkey", "n_nationkey", "r_regionkey")


@query("JN-06_name_in_text", """SELECT doc_id, (SELECT n_nationkey FROM nation WHERE contains(lower(text), lower(n_name)) ORDER BY length(n_name) DESC, n_name LIMIT 1) AS n_nationkey FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)""")
def name_in_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return joins.longest_name_in(docs, F.coalesce("text", F.lit("")), table(spark, sf_dir, "nation"), "n_name", "n_nationkey", "doc_id").select("doc_id", "n_nationkey")


@query("JN-07_lateral_first", "SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) ON true")
def lateral_first(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return joins.lateral_first(table(spark, sf_dir, "customer").select("c_custkey"), o, ["c_custkey"], F.struct("o_orderdate", "o_orderkey"), ["o_orderkey", "o_totalprice"])


@query("JN-08_lateral_sums", "SELECT o_orderkey, coalesce(q, 0)::DOUBLE AS m2, coalesce(n, 0) AS n FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON o_orderkey = l_orderkey")
def lateral_sums(spark, sf_dir):
    sums = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return table(spark, sf_dir, "orders").join(sums, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", zero("q").cast("double").alias("m2"), zero("n").alias("n"))


@query("JN-09_unnest", "SELECT p_partkey, w FROM part, unnest(string_split(p_type, ' ')) AS u(w) WHERE p_size < 5")
def unnest(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_size < 5").select("p_partkey", F.explode(F.split("p_type", " ")).alias("w"))


@query("JN-10_semi", "SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_discount > 0.09)")
def semi(spark, sf_dir):
    return table(spark, sf_dir, "part").join(table(spark, sf_dir, "lineitem").where("l_discount > 0.09"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey")


@query("JN-11_anti", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R')")
def anti(spark, sf_dir):
    return table(spark, sf_dir, "part").join(table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@query("JN-12_scalar_count", "SELECT s_suppkey, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey AND l_tax = 0) AS untaxed FROM supplier")
def scalar_count(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").where("l_tax = 0").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf_dir, "supplier").join(n, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("s_suppkey", F.coalesce("n", F.lit(0)).alias("untaxed"))


@query("JN-15_targets", "SELECT n_name AS zone, op, kind FROM nation, (VALUES ('sale'), ('rent')) AS a(op), (VALUES ('house'), ('flat')) AS b(kind)")
def targets(spark, sf_dir):
    each = lambda *v: F.explode(F.array(*map(F.lit, v)))
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("zone"), each("sale", "rent").alias("op")).select("zone", "op", each("house", "flat").alias("kind"))


@query("JN-16_update_from", "SELECT c.c_custkey, coalesce(CASE WHEN c.c_acctbal > 0 THEN c.c_acctbal END, m.b) AS c_acctbal FROM customer c LEFT JOIN (SELECT c_nationkey, max(c_acctbal) AS b FROM customer WHERE c_acctbal > 0 GROUP BY 1) m USING (c_nationkey)")
def update_from(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("c_acctbal"))
    return joins.update_from(c, c.groupBy("c_nationkey").agg(F.max("c_acctbal").alias("c_acctbal")), ["c_nationkey"], ["c_acctbal"]).select("c_custkey", "c_acctbal")


@query("JN-17_delete_ranked", "SELECT o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
def delete_ranked(spark, sf_dir):
    return latest.top_of_each(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")]).select("o_orderkey")


@query("JN-18_normal_key", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON regexp_replace(c_name, '^\\D*0*', '') = regexp_replace(s_name, '^\\D*0*', '')")
def normal_key(spark, sf_dir):
    key = lambda c: F.regexp_replace(c, r"^\D*0*", "").alias("k")
    return table(spark, sf_dir, "customer").select("c_custkey", key("c_name")).join(table(spark, sf_dir, "supplier").select("s_suppkey", key("s_name")), "k").select("c_custkey", "s_suppkey")


@query("JN-19_merged_names", L + "SELECT CASE WHEN zone IN ('FRANCE', 'GERMANY', 'NATION_1', 'NATION_2') THEN zone ELSE advertiser_id::VARCHAR END AS broker, count(*) AS stock FROM listing GROUP BY 1")
def merged_names(spark, sf_dir):
    merged = F.when(F.col("zone").isin("FRANCE", "GERMANY", "NATION_1", "NATION_2"), F.col("zone"))
    return listings(spark, sf_dir).groupBy(F.coalesce(merged, F.col("advertiser_id").cast("string")).alias("broker")).agg(F.count(F.lit(1)).alias("stock"))


@query("DST-01_best_row", L + "SELECT unit, id, price FROM listing QUALIFY row_number() OVER (PARTITION BY unit ORDER BY is_active DESC, price, id) = 1")
def best_row(spark, sf_dir):
    order = F.struct((~F.col("is_active")).alias("a"), F.col("price").alias("p"), F.col("id").alias("i"))
    return listings(spark, sf_dir).groupBy("unit").agg(F.min_by(F.struct("id", "price"), order).alias("b")).select("unit", "b.*")


@query("DST-02_computed_key", L + "SELECT coalesce(CASE WHEN portal = 'R' THEN 'u' || unit END, id) AS key, max(last_seen) AS last_seen FROM listing GROUP BY 1")
def computed_key(spark, sf_dir):
    key = F.coalesce(F.when(F.col("portal") == "R", F.concat(F.lit("u"), F.col("unit").cast("string"))), F.col("id"))
    return listings(spark, sf_dir).groupBy(key.alias("key")).agg(F.max("last_seen").alias("last_seen"))


@query("DST-03_distinct", L + "SELECT DISTINCT zone, operation FROM listing")
def distinct(spark, sf_dir):
    return listings(spark, sf_dir).select("zone", "operation").distinct()


@query("DST-04_repeats", "SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY text, lang ORDER BY doc_id) = 1")
def repeats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("h"))
    return docs.groupBy("h", "lang").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("DST-05_first_by_score", L + "SELECT seller_reference, advertiser_id, id FROM listing QUALIFY row_number() OVER (PARTITION BY seller_reference, advertiser_id ORDER BY price DESC, id) = 1")
def first_by_score(spark, sf_dir):
    return latest.top_of_each(listings(spark, sf_dir), ["seller_reference", "advertiser_id"], [F.desc("price"), F.asc("id")]).select("seller_reference", "advertiser_id", "id")


@query("AGG-01_basic", L + "SELECT zone, count(*) AS n, sum(price::DECIMAL(18,2))::DOUBLE AS total, round(sum(price::DECIMAL(18,2))::DOUBLE / count(price), 2) AS mean, min(price) AS low, max(price) AS high FROM listing GROUP BY zone HAVING count(*) >= 5")
def basic(spark, sf_dir):
    p = F.col("price")
    return listings(spark, sf_dir).groupBy("zone").agg(F.count(F.lit(1)).alias("n"), A.exact_sum(p).alias("total"), A.mean(p).alias("mean"), F.min(p).alias("low"), F.max(p).alias("high")).where("n >= 5")


@query("AGG-02_filtered", L + "SELECT zone, count(*) FILTER (is_active) AS active, count(*) FILTER (NOT is_active) AS gone, count(*) FILTER (portal = 'R' AND price > 50000) AS dear, max(price) FILTER (operation = 'F') AS top FROM listing GROUP BY zone")
def filtered(spark, sf_dir):
    c = F.col
    return listings(spark, sf_dir).groupBy("zone").agg(A.count_if(c("is_active")).alias("active"), A.count_if(~c("is_active")).alias("gone"), A.count_if((c("portal") == "R") & (c("price") > 50_000)).alias("dear"), F.max(F.when(c("operation") == "F", c("price"))).alias("top"))


@query("AGG-03_distinct_counts", L + "SELECT zone, count(DISTINCT advertiser_id) AS brokers, count(DISTINCT unit) FILTER (is_active) AS units, count(DISTINCT regexp_replace(lower(seller_reference), '[^0-9]', '', 'g')) AS refs FROM listing GROUP BY zone")
def distinct_counts(spark, sf_dir):
    refs = F.regexp_replace(F.lower("seller_reference"), "[^0-9]", "")
    return listings(spark, sf_dir).groupBy("zone").agg(F.countDistinct("advertiser_id").alias("brokers"), F.countDistinct(F.when(F.col("is_active"), F.col("unit"))).alias("units"), F.countDistinct(refs).alias("refs"))


@query("AGG-04_quantiles", L + "SELECT zone, round(quantile_cont(price, 0.25), 4) AS p25, round(quantile_cont(price, 0.5) FILTER (is_active), 4) AS p50, round(quantile_cont(price, 0.75), 4) AS p75 FROM listing GROUP BY zone")
def quantiles(spark, sf_dir):
    p = F.col("price")
    found = Q.quantiles(listings(spark, sf_dir, by="l_extendedprice"), ["zone"], {"p25": (p, 0.25), "p50": (F.when(F.col("is_active"), p), 0.5), "p75": (p, 0.75)})
    return found.select("zone", *(F.round(c, 4).alias(c) for c in ("p25", "p50", "p75")))


@query("AGG-05_sets", L + "SELECT unit, list_sort(list(DISTINCT advertiser_id)) AS brokers, list_sort(coalesce(list(DISTINCT portal) FILTER (is_active), [])) AS portals FROM listing GROUP BY unit")
def sets(spark, sf_dir):
    return listings(spark, sf_dir).groupBy("unit").agg(F.array_sort(F.collect_set("advertiser_id")).alias("brokers"), F.array_sort(F.collect_set(F.when(F.col("is_active"), F.col("portal")))).alias("portals"))


@query("AGG-06_first_by", L + "SELECT unit, arg_max(advertiser, (last_seen, id)) AS latest_broker, arg_max(price, (last_seen, id)) FILTER (is_active) AS latest_price FROM listing GROUP BY unit")
def first_by(spark, sf_dir):
    on = F.when(F.col("is_active"), F.struct("last_seen", "id"))
    return listings(spark, sf_dir, by="l_partkey").groupBy("unit").agg(A.first_by(F.col("advertiser"), "last_seen", "id").alias("latest_broker"), F.max_by("price", on).alias("latest_price"))


@query("AGG-07_weighted_mean", L + "SELECT zone, round(sum(CASE WHEN is_active THEN square_meters * bedrooms END) / sum(CASE WHEN is_active THEN bedrooms END), 4) AS m2 FROM listing GROUP BY zone")
def weighted_mean(spark, sf_dir):
    return listings(spark, sf_dir).groupBy("zone").agg(F.round(A.weighted_mean(F.when(F.col("is_active"), F.col("square_meters")), F.col("bedrooms")), 4).alias("m2"))


@query("AGG-08_weighted_year", L + "SELECT unit, round(sum(square_meters * year(first_seen)) / nullif(sum(square_meters), 0)) AS year FROM listing GROUP BY unit")
def weighted_year(spark, sf_dir):
    return listings(spark, sf_dir).groupBy("unit").agg(F.round(A.weighted_mean(F.year("first_seen"), F.col("square_meters"))).alias("year"))


@query("AGG-09_objects", "SELECT o_custkey, to_json(list({'k': o_orderkey, 's': o_orderstatus} ORDER BY o_orderkey))::VARCHAR AS orders FROM orders GROUP BY o_custkey")
def objects(spark, sf_dir):
    one = F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.to_json(F.sort_array(F.collect_list(one))).alias("orders"))


@query("AGG-10_many_counts", "SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS returned, (SELECT count(DISTINCT user_id) FROM events) AS users")
def many_counts(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    counts = [t("orders").agg(F.count(F.lit(1)).alias("orders")), t("lineitem").where("l_returnflag = 'R'").agg(F.count(F.lit(1)).alias("returned")), t("events").agg(F.countDistinct("user_id").alias("users"))]
    # One row each: the union of them pivots without a product of tables.
    rows = [c.select(*(F.col(n) if n in c.columns else F.lit(None).cast("long").alias(n) for n in ("orders", "returned", "users"))) for c in counts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).agg(*(F.max(n).alias(n) for n in ("orders", "returned", "users")))


@query("AGG-11_coverage", L + "SELECT 'active' AS what, zone, round(100.0 * count(*) FILTER (is_active) / count(*), 1) AS pct FROM listing GROUP BY zone UNION ALL SELECT 'portal R', zone, round(100.0 * count(*) FILTER (portal = 'R') / count(*), 1) FROM listing GROUP BY zone")
def coverage(spark, sf_dir):
    each = listings(spark, sf_dir).groupBy("zone").agg(F.count(F.lit(1)).alias("n"), A.count_if(F.col("is_active")).alias("a"), A.count_if(F.col("portal") == "R").alias("r"))
    one = F.explode(F.array(*(F.struct(F.lit(w).alias("what"), A.percent(F.col(c), F.col("n")).alias("pct")) for w, c in (("active", "a"), ("portal R", "r"))))).alias("x")
    return each.select("zone", one).select("x.what", "zone", "x.pct")


_MODE = "SELECT unit, {c}::VARCHAR AS {c} FROM (SELECT unit, {c}, count(*) AS n, max(last_seen) AS l FROM listing WHERE {c} IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY unit ORDER BY n DESC, l DESC, {c}::VARCHAR DESC) = 1"


@query("AGG-12_recent_mode", L + f"SELECT * FROM ({_MODE.format(c='zone')}) JOIN ({_MODE.format(c='bedrooms')}) USING (unit)")
def recent_mode(spark, sf_dir):
    return A.modes(listings(spark, sf_dir, by="l_partkey"), ["unit"], ["zone", "bedrooms"], "last_seen")


@query("AGG-13_best_ranked", L + "SELECT unit, arg_min(price, (CASE portal WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, first_seen, id)) AS price FROM listing GROUP BY unit")
def best_ranked(spark, sf_dir):
    return listings(spark, sf_dir).groupBy("unit").agg(A.best_ranked(F.col("price"), F.col("portal"), ["N", "A"], F.col("first_seen"), F.col("id")).alias("price"))


@query("AGG-14_large_groups", L + "SELECT unit, count(DISTINCT advertiser_id) AS n FROM listing GROUP BY unit HAVING count(DISTINCT advertiser_id) >= 5")
def large_groups(spark, sf_dir):
    return listings(spark, sf_dir).groupBy("unit").agg(F.countDistinct("advertiser_id").alias("n")).where("n >= 5")


@query("AGG-15_hours", "SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def hours(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("AGG-17_total_beside", L + ", b AS (SELECT unit, count(*) AS n FROM listing GROUP BY unit HAVING count(*) >= 2) SELECT unit, n, count(*) OVER () AS total FROM b ORDER BY n DESC, unit LIMIT 20")
def total_beside(spark, sf_dir):
    units = listings(spark, sf_dir).groupBy("unit").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    # The total is one row of its own: a window without keys would put all units into one task.
    return units.orderBy(F.desc("n"), "unit").limit(20).join(F.broadcast(units.agg(F.count(F.lit(1)).alias("total"))))


@query("WIN-01_ranked", L + "SELECT id, row_number() OVER (PARTITION BY unit, portal ORDER BY is_active DESC, last_seen DESC, id) AS rank FROM listing")
def ranked(spark, sf_dir):
    return latest.ranked(listings(spark, sf_dir), ["unit", "portal"], [F.desc("is_active"), F.desc("last_seen"), F.asc("id")]).select("id", "rank")


@query("WIN-02_newest_job", C + "SELECT event_id FROM change QUALIFY row_number() OVER (PARTITION BY k, agency ORDER BY ts DESC, event_id DESC) = 1")
def newest_job(spark, sf_dir):
    return changes(spark, sf_dir).groupBy("k", "agency").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id")).select("event_id")


@query("WIN-05_margin", L + ", r AS (SELECT unit, price, row_number() OVER (PARTITION BY unit ORDER BY price DESC, id) AS k FROM listing) SELECT unit, round(max(price) FILTER (k = 1) - max(price) FILTER (k = 2), 2) AS margin FROM r WHERE k <= 2 GROUP BY unit")
def margin(spark, sf_dir):
    two = latest.ranked(listings(spark, sf_dir), ["unit"], [F.desc("price"), F.asc("id")], "k").where("k <= 2")
    nth = lambda k: F.max(F.when(F.col("k") == k, F.col("price")))
    return two.groupBy("unit").agg(F.round(nth(1) - nth(2), 2).alias("margin"))


@query("WIN-06_latest_five", C + "SELECT listing_id, event_id FROM change QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY ts DESC, event_id DESC) <= 5")
def latest_five(spark, sf_dir):
    return latest.top_of_each(changes(spark, sf_dir), ["listing_id"], [F.desc("ts"), F.desc("event_id")], 5).select("listing_id", "event_id")


@query("SRT-01_sort_by_name", L + "SELECT id, price FROM listing ORDER BY price DESC NULLS LAST, id LIMIT 50")
def sort_by_name(spark, sf_dir):
    return paging.page(listings(spark, sf_dir), paging.order_of("price_desc"), 1, 50).select("id", "price")


@query("SRT-02_page", L + "SELECT id, last_seen FROM listing ORDER BY last_seen DESC NULLS LAST, id LIMIT 25 OFFSET 50")
def page(spark, sf_dir):
    return paging.page(listings(spark, sf_dir), paging.order_of("no such order"), 3, 25).select("id", "last_seen")


@query("SRT-03_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_k(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


@query("SRT-04_priority", C + "SELECT event_id, CASE WHEN agency = 'purchase' THEN 0 WHEN k > 50 THEN 1 ELSE 2 END AS bucket FROM change ORDER BY bucket, ts NULLS FIRST, event_id LIMIT 100")
def priority(spark, sf_dir):
    bucket = F.when(F.col("agency") == "purchase", 0).when(F.col("k") > 50, 1).otherwise(2)
    return changes(spark, sf_dir).withColumn("bucket", bucket).orderBy("bucket", F.asc_nulls_first("ts"), "event_id").limit(100).select("event_id", "bucket")


@query("SRT-05_null_order", "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality DESC NULLS FIRST, doc_id")
def null_order(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").orderBy(F.desc_nulls_first("quality"), "doc_id").select("doc_id", "quality")


@query("SRT-06_after_key", "SELECT o_orderkey FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 30")
def after_key(spark, sf_dir):
    return paging.after(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 500, 30)


@query("SET-01_nodes", "SELECT c_nationkey AS node FROM customer UNION SELECT s_nationkey FROM supplier")
def nodes(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("node")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("SET-03_arrays", L + ", a AS (SELECT unit, list_sort(list(DISTINCT portal)) AS p, list_sort(list(DISTINCT operation)) AS o FROM listing GROUP BY unit) SELECT unit, list_sort(list_distinct(p || o)) AS both, len(list_intersect(p, ['A', 'N']))::INT AS shared FROM a")
def arrays(spark, sf_dir):
    a = listings(spark, sf_dir).groupBy("unit").agg(F.collect_set("portal").alias("p"), F.collect_set("operation").alias("o"))
    return a.select("unit", F.array_sort(F.array_union("p", "o")).alias("both"), F.size(F.array_intersect("p", F.array(F.lit("A"), F.lit("N")))).alias("shared"))


@query("ARR-01_03_04_arrays", L + ", a AS (SELECT unit, list(DISTINCT portal) AS p FROM listing GROUP BY unit) SELECT unit, list_contains(p, 'R') AS has_r, list_has_all(p, ['A', 'R']) AS has_both, list_sort(list_distinct(p || ['A', 'X'])) AS more FROM a")
def containment(spark, sf_dir):
    a, two = listings(spark, sf_dir).groupBy("unit").agg(F.collect_set("portal").alias("p")), F.array(F.lit("A"), F.lit("R"))
    return a.select("unit", F.array_contains("p", "R").alias("has_r"), (F.size(F.array_except(two, "p")) == 0).alias("has_both"), F.array_sort(F.array_union("p", F.array(F.lit("A"), F.lit("X")))).alias("more"))


@query("ARR-02_zipped", "SELECT o_orderkey, unnest([1, 2]) AS i, unnest([o_orderstatus, o_orderpriority]) AS v FROM orders")
def zipped(spark, sf_dir):
    pair = F.explode(F.arrays_zip(F.array(F.lit(1), F.lit(2)).alias("i"), F.array("o_orderstatus", "o_orderpriority").alias("v"))).alias("x")
    return table(spark, sf_dir, "orders").select("o_orderkey", pair).select("o_orderkey", "x.*")


@query("ARR-02_zipped_whole", "SELECT o_orderkey, unnest([1, 2]) AS i, unnest([o_orderstatus, o_orderpriority]) AS v FROM orders")
def zipped_whole(spark, sf_dir):
    pair = F.explode(F.arrays_zip(F.array(F.lit(1), F.lit(2)).alias("i"), F.array("o_orderstatus", "o_orderpriority").alias("v"))).alias("x")
    return table(spark, sf_dir, "orders").select("o_orderkey", pair).select("o_orderkey", "x.*")


@query("SRT-05_null_order_whole", "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality DESC NULLS FIRST, doc_id")
def null_order_whole(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").orderBy(F.desc_nulls_first("quality"), "doc_id").select("doc_id", "quality")
