"""Property-market tables over the star schema: each as a DataFrame, and as SQL for checks in another engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Parts that rows are dealt out in for each part that their table is read in (128 MB of files at most).
PARTS_EACH = 8


def listings(spark: SparkSession, sf_dir: str, by: str | None = None) -> DataFrame:
    """One advert a row: a line of an order, offered by a supplier in a nation (the zone).

    With ``by`` (l_partkey for units, l_suppkey for advertisers) rows are
    dealt out by that column while they are still narrow, before ids and
    names are made: aggregates by it, or by it and more, shuffle nothing
    again. The number of parts follows the table, so what a task is dealt does not grow with it.
    """
    t = lambda name: table(spark, sf_dir, name)
    lines = t("lineitem")
    rows = lines.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    if by is not None:
        rows = rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), PARTS_EACH * lines.rdd.getNumPartitions()), by)
    rows = rows.join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    parts = (F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity").cast("long"), F.round(F.col("l_extendedprice") * 100).cast("long"))
    return rows.select(
        F.md5(F.concat_ws("|", *(p.cast("string") for p in parts)).cast("binary")).alias("id"),
        F.col("l_partkey").alias("unit"),
        F.col("l_suppkey").alias("advertiser_id"),
        F.col("s_name").alias("advertiser"),
        F.col("l_returnflag").alias("portal"),
        F.col("l_linestatus").alias("operation"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("square_meters"),
        F.col("l_linenumber").alias("bedrooms"),
        F.col("n_name").alias("zone"),
        F.col("r_name").alias("region"),
        F.concat(F.lit("Ref "), (F.col("l_partkey") % 20).cast("string")).alias("seller_reference"),
        (F.col("l_linestatus") == "O").alias("is_active"),
        F.col("o_orderdate").alias("first_seen"),
        F.col("l_shipdate").alias("last_seen"),
    )


LISTING_SQL = """listing AS (SELECT md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT, round(l_extendedprice * 100)::BIGINT)) AS id,
l_partkey AS unit, l_suppkey AS advertiser_id, s_name AS advertiser, l_returnflag AS portal, l_linestatus AS operation, l_extendedprice AS price,
l_quantity AS square_meters, l_linenumber AS bedrooms, n_name AS zone, r_name AS region, 'Ref ' || (l_partkey % 20) AS seller_reference,
l_linestatus = 'O' AS is_active, o_orderdate AS first_seen, l_shipdate AS last_seen
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def dealt(df: DataFrame, by: str) -> DataFrame:
    """Rows over as many tasks as shuffles have, while they are narrow: what is made of them may be far larger than the files that they come in."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), by)


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of a listing over time: the listing, when, its price and its agency."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("listing_id"), "ts", F.round("value", 0).alias("price"), F.col("event_type").alias("agency"), F.get_json_object("props", "$.k").cast("int").alias("k"))


CHANGE_SQL = "change AS (SELECT event_id, user_id AS listing_id, ts, round(value, 0) AS price, event_type AS agency, (props::JSON ->> '$.k')::INT AS k FROM events)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point on the map for each vector, in degrees."""
    v = table(spark, sf_dir, "embeddings")
    at = lambda i: F.element_at("embedding", i).cast("double")
    return v.select("vec_id", "label", (-33.4 + 0.1 * at(1)).alias("lat"), (-70.6 + 0.1 * at(2)).alias("lon"))


POINT_SQL = "point AS (SELECT vec_id, label, (-33.4)::DOUBLE + 0.1::DOUBLE * embedding[1]::DOUBLE AS lat, (-70.6)::DOUBLE + 0.1::DOUBLE * embedding[2]::DOUBLE AS lon FROM embeddings)"


def picture_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-bit picture hash of each vector: bit i (the lowest first) is the sign of its value i."""
    v = table(spark, sf_dir, "embeddings")
    bit = lambda i: F.when(F.element_at("embedding", i + 1) > 0, F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))
    h = bit(0)
    for i in range(1, 64):
        h = h.bitwiseOR(bit(i))
    return v.select("vec_id", h.alias("phash"))


PHASH_SQL = "picture AS (SELECT vec_id, list_reduce(list_transform(range(64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN 1::UBIGINT << i ELSE 0::UBIGINT END), lambda a, b: a | b) AS phash FROM embeddings)"


def adverts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An advert for each point, with all that pairs are compared by: its picture hash, those of its photos, and the part of its number as what is known of it.

    Of four adverts two show a room of the first one's, with some bits of the hash changed, one has no photos, and one doesn't say.
    """
    i, part = F.col("vec_id"), table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "vec_id")
    hashes = picture_hashes(spark, sf_dir)
    room = hashes.select((F.col("vec_id") + F.lit(0)).alias("_first"), F.col("phash").bitwiseXOR(F.lit(0x5555)).alias("_room"))
    # Merged: each side has a row an advert or more, and its file is far smaller than these are in memory.
    rows = points(spark, sf_dir).join(hashes.hint("merge"), "vec_id").join(part.hint("merge"), "vec_id", "left").join(room.hint("merge"), F.col("_first") == i - i % 4, "left")
    photos = F.when(i % 4 == 0, F.array("_room", F.bitwise_not("phash"))).when(i % 4 == 1, F.array(F.col("_room").bitwiseXOR(F.lit(7)))).when(i % 4 == 2, F.array().cast("array<bigint>"))
    return rows.select(
        i.alias("id"), "lat", "lon", "phash", F.col("p_size").cast("double").alias("area"), F.col("p_retailprice").alias("price"), (i % 4).cast("int").alias("bedrooms"), (i % 3).cast("int").alias("bathrooms"),
        F.col("p_type").alias("kind"), F.when(i % 2 == 0, "sale").otherwise("rent").alias("operation"), F.concat(F.lit("C"), F.floor(i / 500).cast("string")).alias("commune"),
        photos.alias("photos"), F.concat(F.lit("+56 9 "), F.lpad(F.floor(i / 3).cast("string"), 8, "0")).alias("phone"), F.concat_ws(" ", "p_brand", F.floor(i / 50).cast("string")).alias("agency"), F.col("p_name").alias("address"), (i % 5 > 0).alias("is_active"),
    )
