"""Properties put together from their adverts, summaries that follow changes, and measures of names, numbers and times over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric, text
from ..operators import entity
from ..operators.refresh import Summary
from ..operators.storage import scratch
from ..sources.domain import LISTING_SQL, listings, table
from .registry import book

QUERIES, SQL, query = book()
L = f"WITH {LISTING_SQL}"

_MODE = "(SELECT unit, {c} FROM (SELECT unit, {c}, count(*) AS n, max(last_seen) AS l FROM r WHERE {c} IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY unit ORDER BY n DESC, l DESC, {c}::VARCHAR DESC) = 1)"


@query(
    "ER-16_whole_consolidation",
    L
    + f""", r AS (SELECT *, CASE bedrooms WHEN 1 THEN 'pin_suspect' WHEN 2 THEN 'confirmed' WHEN 3 THEN 'candidate' WHEN 4 THEN 'none' END AS trust, CASE WHEN advertiser_id % 3 > 0 THEN round(price / 38000, 4) END AS uf, CASE bedrooms WHEN 5 THEN NULL ELSE square_meters::BIGINT END AS area FROM listing),
g AS (SELECT unit, count(*) AS listing_count, greatest(1, count(DISTINCT advertiser_id)) AS advertiser_count, bool_or(is_active) AS is_active, min(first_seen) AS first_seen, max(last_seen) AS last_seen, array_to_string(list_sort(list(DISTINCT portal)), ',') AS portals FROM r GROUP BY unit),
p AS (SELECT unit, price, uf AS price_uf FROM r QUALIFY row_number() OVER (PARTITION BY unit ORDER BY is_active DESC, price, id) = 1),
w AS (SELECT unit, zone AS commune, trust AS location_confidence FROM r QUALIFY row_number() OVER (PARTITION BY unit ORDER BY CASE trust WHEN 'confirmed' THEN 0 WHEN 'candidate' THEN 1 WHEN 'none' THEN 2 WHEN 'pin_suspect' THEN 3 ELSE 4 END, id) = 1)
SELECT g.*, p.price, p.price_uf, w.commune, w.location_confidence, operation, area, bedrooms::INT AS bedrooms FROM g JOIN p USING (unit) JOIN w USING (unit) LEFT JOIN {_MODE.format(c='operation')} USING (unit) LEFT JOIN {_MODE.format(c='area')} USING (unit) LEFT JOIN {_MODE.format(c='bedrooms')} USING (unit)""",
)
def whole_consolidation(spark, sf_dir):
    """Each unit's commonest values, cheapest active price with its rate, most trusted place, and sets of its adverts."""
    l, b = listings(spark, sf_dir, by="l_partkey"), F.col("bedrooms")
    trust = F.when(b == 1, "pin_suspect").when(b == 2, "confirmed").when(b == 3, "candidate").when(b == 4, "none")
    rows = l.withColumns({"location_confidence": trust, "price_uf": F.when(F.col("advertiser_id") % 3 > 0, F.round(F.col("price") / 38000, 4)), "area": F.when(b != 5, F.col("square_meters").cast("long")), "commune": F.col("zone"), "bedrooms": b.cast("int")})
    got = entity.consolidated(rows.drop("zone", "region"), "unit")
    return got.withColumn("portals", F.array_join("portals", ","))


@query(
    "SNK-07_Q-08_refreshed_summary",
    L
    + """, now AS (SELECT zone, operation, price, unit FROM listing WHERE NOT (first_seen < TIMESTAMP '1997-01-01' AND unit % 10 = 0))
SELECT zone, operation, count(*) AS n, sum(round(price * 100)::BIGINT)::BIGINT AS cents, count(DISTINCT unit) AS units, min(unit::VARCHAR) AS least, max(unit::VARCHAR) AS greatest FROM now GROUP BY zone, operation""",
)
def refreshed_summary(spark, sf_dir):
    """A summary of the adverts before 1997, to which the later ones are merged and of which some units' are taken off, without a second look at the rest."""
    l = listings(spark, sf_dir).select("zone", "operation", "unit", F.round(F.col("price") * 100).cast("long").alias("cents"), "first_seen")
    old = F.col("first_seen") < F.lit("1997-01-01").cast("timestamp")
    s = Summary(spark, scratch(spark, "summary"), ["zone", "operation"], ["cents"], ["unit"])
    s.build(l.where(old))
    s.refresh(l.where(~old), l.where(old & (F.col("unit") % 10 == 0)))
    return s.read().select("zone", "operation", "n", F.col("sum_cents").alias("cents"), F.col("different_unit").alias("units"), F.col("least_unit").alias("least"), F.col("greatest_unit").alias("greatest"))


_SAYS = "list_distinct(list_filter(regexp_split_to_array(lower(strip_accents({x})), '[^a-z0-9]+'), lambda w: w <> ''))"


@query(
    "STR-06_07_names",
    f"""WITH n AS (SELECT o_orderkey, c_name, o_orderpriority || ' ' || CASE WHEN o_orderkey % 3 = 0 THEN upper(c_name) WHEN o_orderkey % 3 = 1 THEN split_part(c_name, '#', 1) || ' Ñ' ELSE '' END AS said FROM orders JOIN customer ON o_custkey = c_custkey),
w AS (SELECT o_orderkey, {_SAYS.format(x='c_name')} AS a, {_SAYS.format(x='said')} AS b FROM n)
SELECT o_orderkey, round(len(list_intersect(a, b))::DOUBLE / least(len(a), len(b)), 6) AS overlap, round(len(list_intersect(a, b))::DOUBLE / greatest(len(a), len(b)), 6) AS likeness FROM w""",
)
def names(spark, sf_dir):
    """How far the name that an order gives agrees with its customer's: by the shorter of the two, and by the longer."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey") % 3
    said = F.concat_ws(" ", "o_orderpriority", F.when(k == 0, F.upper("c_name")).when(k == 1, F.concat(F.substring_index("c_name", "#", 1), F.lit(" Ñ"))).otherwise(""))
    return o.select("o_orderkey", F.round(text.token_overlap(F.col("c_name"), said), 6).alias("overlap"), F.round(text.word_similarity(F.col("c_name"), said), 6).alias("likeness"))


@query(
    "STR-10_cross_checked",
    r"""WITH a AS (SELECT p_partkey AS k, 'Avda. ' || p_name || ' ' || (p_size * 10) || CASE WHEN p_partkey % 4 = 0 THEN ' dpto 5' ELSE '' END AS mine,
CASE p_partkey % 5 WHEN 0 THEN 'AVENIDA ' || upper(p_name) || ' ' || (p_size * 10) WHEN 1 THEN 'Avenida ' || p_name WHEN 2 THEN 'Av ' || split_part(p_name, ' ', 1) || ' ' || (p_size * 10) || ', Ñuñoa' WHEN 3 THEN 'Avenida ' || p_name || ' ' || (p_size * 10 + 1) ELSE p_brand || ' ' || (p_size * 10) END AS its FROM part),
u AS (SELECT k, regexp_replace(regexp_replace(upper(strip_accents(mine)), '[^A-Z0-9 ]', ' ', 'g'), '\b(AV|AVDA)\b', 'AVENIDA', 'g') AS m, regexp_replace(regexp_replace(upper(strip_accents(its)), '[^A-Z0-9 ]', ' ', 'g'), '\b(AV|AVDA)\b', 'AVENIDA', 'g') AS i FROM a),
w AS (SELECT k, nullif(regexp_extract(m, '\b(\d{1,6})\b', 1), '') AS n1, nullif(regexp_extract(i, '\b(\d{1,6})\b', 1), '') AS n2, list_distinct(list_filter(string_split(m, ' '), lambda x: length(x) > 2 AND NOT regexp_full_match(x, '\d+'))) AS s, list_distinct(list_filter(string_split(i, ' '), lambda x: length(x) > 2 AND NOT regexp_full_match(x, '\d+'))) AS t FROM u)
SELECT k AS p_partkey, coalesce(n1 = n2, true) AND len(list_intersect(s, t))::DOUBLE / least(len(s), len(t)) >= 0.6 AS agree FROM w""",
)
def cross_checked(spark, sf_dir):
    """Whether two ways to write an address may be of one place: numbers, abbreviations, accents and words differ by row."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    number = (F.col("p_size") * 10).cast("string")
    mine = F.concat(F.lit("Avda. "), "p_name", F.lit(" "), number, F.when(k % 4 == 0, " dpto 5").otherwise(""))
    its = F.when(k % 5 == 0, F.concat(F.lit("AVENIDA "), F.upper("p_name"), F.lit(" "), number)).when(k % 5 == 1, F.concat(F.lit("Avenida "), "p_name")).when(k % 5 == 2, F.concat(F.lit("Av "), F.substring_index("p_name", " ", 1), F.lit(" "), number, F.lit(", Ñuñoa")))
    its = its.when(k % 5 == 3, F.concat(F.lit("Avenida "), "p_name", F.lit(" "), (F.col("p_size") * 10 + 1).cast("string"))).otherwise(F.concat_ws(" ", "p_brand", number))
    return p.select("p_partkey", text.same_address(mine, its).alias("agree"))


@query(
    "NUM-02_07_FX-02_numbers",
    """WITH n AS (SELECT event_id, value, floor(value * 2) / 2 - 250 AS half, CASE event_id % 4 WHEN 0 THEN ' ' || round(value)::BIGINT || ' m2' WHEN 1 THEN (-(event_id % 90))::VARCHAR WHEN 2 THEN '' ELSE 'x' || event_id END AS said, CASE event_id % 5 WHEN 0 THEN ' uf ' WHEN 1 THEN 'usd' WHEN 2 THEN 'EUR' WHEN 3 THEN NULL ELSE 'CLP' END AS tag FROM events)
SELECT event_id, nullif(regexp_extract(said, '^\\s*(-?\\d+)', 1), '')::BIGINT AS number, CASE WHEN greatest(value, 100) > 0 THEN round(abs(value - 100) / greatest(value, 100), 6) END AS difference, least(value, 100) > 0 AND abs(value - 100) / least(value, 100) > 0.05 AS discrepant,
CASE WHEN upper(trim(tag)) IN ('CLP', 'UF', 'USD') THEN upper(trim(tag)) ELSE 'CLP' END AS currency, sign(half) * floor(abs(half) + 0.5) AS away, CASE WHEN abs(half) % 1 = 0.5 THEN 2 * round(half / 2) ELSE round(half) END::DOUBLE AS even, floor(half + 0.5)::DOUBLE AS up FROM n""".replace("\\\\", "\\"),
)
def numbers(spark, sf_dir):
    """Numbers that texts begin with, relative differences, currencies, and halves rounded in three ways."""
    i, v = F.col("event_id"), F.col("value")
    half = F.floor(v * 2) / 2 - 250
    said = F.when(i % 4 == 0, F.concat(F.lit(" "), F.round(v).cast("long").cast("string"), F.lit(" m2"))).when(i % 4 == 1, (-(i % 90)).cast("string")).when(i % 4 == 2, "").otherwise(F.concat(F.lit("x"), i.cast("string")))
    tag = F.when(i % 5 == 0, " uf ").when(i % 5 == 1, "usd").when(i % 5 == 2, "EUR").when(i % 5 == 4, "CLP")
    hundred = F.lit(100.0)
    return table(spark, sf_dir, "events").select("event_id", numeric.leading_int(said).alias("number"), F.round(numeric.difference(v, hundred), 6).alias("difference"), numeric.discrepant(v, hundred).alias("discrepant"), numeric.currency(tag).alias("currency"), numeric.round_away(half).alias("away"), numeric.round_even(half).alias("even"), numeric.round_up_half(half).alias("up"))


@query("DAT-04_business_hours", "SELECT event_id, hour((ts::TIMESTAMP AT TIME ZONE 'UTC') AT TIME ZONE 'America/Santiago') BETWEEN 8 AND 22 AS open FROM events")
def business_hours(spark, sf_dir):
    """Whether an event falls into the business window of its local time, summer time included."""
    return table(spark, sf_dir, "events").select("event_id", numeric.in_business_hours(F.col("ts").cast("timestamp")).alias("open"))
