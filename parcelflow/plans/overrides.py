"""JSON differences, picture hashes of grids, manual overrides, price bands and batches of the outbox."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import documents, numeric
from ..operators import changes as CH
from ..operators import entity, filters
from ..sources.domain import CHANGE_SQL, LISTING_SQL, changes, listings, table
from .registry import book

QUERIES, SQL, query = book()
L, C = f"WITH {LISTING_SQL} ", f"WITH {CHANGE_SQL} "


@query("JSN-04_05_06_differences", """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN '{"id":"' || o_orderkey || '","status":"F"}' ELSE '{"id":"' || o_orderkey || '"}' END AS patch FROM orders""")
def differences(spark, sf_dir):
    """What a new version changes, with the id always; nulls and empty arrays are left out."""
    key, s = F.col("o_orderkey").cast("string"), F.col("o_orderstatus")
    old = F.create_map(F.lit("id"), key, F.lit("note"), F.lit("[]"), F.lit("status"), s)
    new = F.create_map(F.lit("id"), key, F.lit("note"), F.lit("[]"), F.lit("status"), F.lit("F"))
    patch = documents.without_empty(F.to_json(documents.changed_fields(old, new, always=["id", "note"])))
    return table(spark, sf_dir, "orders").select("o_orderkey", patch.alias("patch"))


@query("NUM-10_11_picture_hashes", """WITH g AS (SELECT vec_id, list_transform(range(72), lambda i: floor(embedding[i % 64 + 1]::DOUBLE * 100)) AS v FROM embeddings)
SELECT vec_id, list_aggregate(list_transform(range(64), lambda i: CASE WHEN v[i // 8 * 9 + i % 8 + 1] < v[i // 8 * 9 + i % 8 + 2] THEN 1 ELSE 0 END), 'sum')::INT AS bits FROM g""")
def grid_hashes(spark, sf_dir):
    """Bits of each vector's difference hash; its distance from no bits at all is their number."""
    at = lambda i: F.floor(F.element_at("embedding", (i % 64 + 1).cast("int")).cast("double") * 100)
    hashed = table(spark, sf_dir, "embeddings").select("vec_id", numeric.difference_hash(F.transform(F.sequence(F.lit(0), F.lit(71)), at)).alias("h"))
    return hashed.select("vec_id", numeric.least_hamming(F.array("h"), F.array(F.lit(0).cast("long"))).alias("bits"))


@query("ER-18_overrides", L + ", o AS (SELECT p_partkey AS unit, p_retailprice AS price, p_size > 40 AS locked FROM part WHERE p_size > 30) SELECT id, coalesce(CASE WHEN locked THEN o.price END, l.price) AS price, coalesce(locked, false) AS locked FROM listing l LEFT JOIN o USING (unit)")
def overrides(spark, sf_dir):
    """A person's value wins where it is locked."""
    o = table(spark, sf_dir, "part").where("p_size > 30").select(F.col("p_partkey").alias("unit"), F.col("p_retailprice").alias("pinned"), (F.col("p_size") > 40).alias("locked"))
    return listings(spark, sf_dir).join(o, "unit", "left").select("id", F.coalesce(F.when(F.col("locked"), F.col("pinned")), F.col("price")).alias("price"), F.coalesce("locked", F.lit(False)).alias("locked"))


@query("ER-26_names", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS overlap FROM customer")
def names_overlap(spark, sf_dir):
    """Names agree whatever the order of their words."""
    other = F.when(F.col("c_custkey") % 2 == 0, "Soto Ana").otherwise("Ana Vera")
    return table(spark, sf_dir, "customer").select("c_custkey", entity.names_agree(F.lit("ana soto"), other).alias("overlap"))


@query("STM-02_published_currency", C + ", v AS (SELECT event_id, k % 2 AS uf, price, lag(price) OVER w AS p0, lag(k % 2) OVER w AS u0 FROM change WINDOW w AS (PARTITION BY listing_id ORDER BY ts, event_id)) SELECT event_id, coalesce(uf = u0 AND price <> p0, false) AS changed FROM v")
def published_currency(spark, sf_dir):
    """A price changed only if it did in the currency it is published in."""
    w = Window.partitionBy("listing_id").orderBy("ts", "event_id")
    rows = changes(spark, sf_dir).withColumn("uf", F.col("k") % 2)
    return rows.select("event_id", F.coalesce((F.col("uf") == F.lag("uf").over(w)) & (F.col("price") != F.lag("price").over(w)), F.lit(False)).alias("changed"))


@query("STM-03_photos", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 >= o_custkey % 4 OR o_orderkey % 5 >= 3 THEN 'new' ELSE 'old' END AS kept FROM orders")
def photos(spark, sf_dir):
    """Which of two photo lists stays; three are declared."""
    many = lambda name, n: F.transform(F.slice(F.array(*map(F.lit, range(5))), F.lit(1), n.cast("int")), lambda x: F.concat(F.lit(name), x.cast("string")))
    kept = CH.richer_photos(many("old", F.col("o_custkey") % 4), many("new", F.col("o_orderkey") % 5), F.lit(3))
    first = F.when(F.size(kept) == 0, "new").otherwise(F.substring(F.get(kept, F.lit(0)), 1, 3))
    return table(spark, sf_dir, "orders").select("o_orderkey", first.alias("kept"))


@query("STM-13_pending", C + ", last AS (SELECT listing_id, arg_max(agency, (ts, event_id)) AS agency, arg_max(k, (ts, event_id)) AS k FROM change GROUP BY listing_id) SELECT listing_id FROM last WHERE agency <> 'error' AND (k > 50 OR k % 3 = 0)")
def pending(spark, sf_dir):
    """The latest version of each listing, if it may go out and is new or changed."""
    last = changes(spark, sf_dir).groupBy("listing_id").agg(F.max_by(F.struct("agency", "k"), F.struct("ts", "event_id")).alias("v")).select("listing_id", "v.*")
    return last.where(filters.all_of(F.col("agency") != "error", filters.any_of(F.col("k") > 50, F.col("k") % 3 == 0))).select("listing_id")
