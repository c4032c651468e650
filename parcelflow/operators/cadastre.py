"""Which roll of the cadastre an advert is of: candidates, evidence, probability."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric, text
from . import spatial
from .latest import top_of_each
from .storage import stored

#: Log odds of each kind of evidence, by the difference at which they hold; in between they are interpolated. (Fixed values.)
PRIOR = -1.2
SAME_ADDRESS = 4.2
NUMBER = ((0, 3.2), (4, 2.2), (20, 1.0), (60, 0.2))
ALIKE = ((0.75, 1.2), (0.55, 0.5))
UNLIKE, UNLIKE_ODDS, NO_MATCH = 0.25, -0.6, -0.2
DISTANCE = ((0, 1.3), (50, 1.0), (150, 0.5), (300, 0), (600, -0.4), (1200, -0.8), (2500, -1.2), (5000, -1.6))
BUILT = ((0, 2.4), (0.08, 2.0), (0.2, 1.0), (0.4, 0), (0.7, -1.2), (1.5, -2.2))
BUILT_WEAK = ((0, 1.9), (0.08, 1.6), (0.2, 0.8), (0.4, 0), (0.7, -1.0), (1.5, -1.8))
LAND = ((0, 2.2), (0.1, 1.8), (0.3, 0.8), (0.7, 0), (1.5, -1.0))
LAND_WEAK = ((0, 1.3), (0.1, 1.0), (0.3, 0.4), (0.7, 0), (1.5, -0.6))
FLOORS = (1.2, 0.2, -0.8)
YEAR = ((0, 1.6), (3, 1.4), (8, 0.6), (20, 0), (50, -0.8))
CONDOMINIUM, USE_FITS, USE_EXCLUDED, PICTURES = 0.4, 0.4, -2.5, 1.5
PRICE_FITS, PRICE_ABSURD = (0.9, 4.5, 0.3), (0.4, 10.0, -0.8)
WITH_LAND = "casa|terreno|parcela"
#: Radii that are searched in turn, and how many candidates stay. (Fixed values.)
RADII, MOST_CANDIDATES = (100, 300, 1000, 2500), 12


def _positive(c: Column) -> Column:
    return F.when(c > 0, c)


def addressed(df: DataFrame, address: str, prefix: str = "") -> DataFrame:
    """``df`` with address in its usual form (null if empty), street and number, worked out once a row and not once a pair."""
    usual = df.withColumn(f"{prefix}address", F.nullif(text.address(F.col(address)), F.lit("")))
    part = lambda i: F.regexp_extract(F.col(f"{prefix}address"), r"^(.+?)\s+(\d+)", i)
    return usual.withColumns({f"{prefix}street": F.nullif(part(1), F.lit("")), f"{prefix}number": part(2).try_cast("int")})


def evidence(advert: Mapping[str, Column], roll: Mapping[str, Column]) -> dict[str, Column]:
    """Log odds of each kind of evidence; what is unknown on either side adds nothing.

    ``advert`` has address, street and number (see ``addressed``), area, built, land, floors, year, in_condominium,
    kind, operation, price (in the currency of the valuation); ``roll`` has
    address, street, number, distance, similarity, built, land, floors, year, parent,
    use_fits (true, false if excluded, else null), valuation and pictures (-1 to 1).
    A stated built or land area says more than the advert's one area.
    """
    mine, its = advert["address"], roll["address"]
    apart = F.abs(advert["number"] - roll["number"])
    by_number = F.when(advert["street"] == roll["street"], F.when(apart == 0, F.lit(SAME_ADDRESS)).otherwise(numeric.interpolate(apart.cast("double"), NUMBER)))
    alike = roll["similarity"]
    by_words = F.when(alike >= ALIKE[0][0], ALIKE[0][1]).when(alike >= ALIKE[1][0], ALIKE[1][1]).when(alike <= UNLIKE, UNLIKE_ODDS).otherwise(NO_MATCH)
    address = F.when(mine.isNull() | its.isNull(), F.lit(0.0)).when(mine == its, SAME_ADDRESS).otherwise(F.coalesce(by_number, by_words))

    def area(stated: Column, weak: Column, other: Column, strong_points, weak_points) -> Column:
        share = lambda m: F.abs(m - other) / m
        known = _positive(other).isNotNull()
        return F.when(known & _positive(stated).isNotNull(), numeric.interpolate(share(_positive(stated)), strong_points)).when(known & _positive(weak).isNotNull(), numeric.interpolate(share(_positive(weak)), weak_points))

    floors = F.abs(advert["floors"] - roll["floors"])
    ratio = _positive(advert["price"]) / _positive(roll["valuation"])
    parts = {
        "address": address,
        "distance": numeric.interpolate(roll["distance"], DISTANCE),
        "built": area(advert["built"], advert["area"], roll["built"], BUILT, BUILT_WEAK),
        "land": F.when(F.lower(advert["kind"]).rlike(WITH_LAND), area(advert["land"], F.when(advert["built"].isNull(), advert["area"]), roll["land"], LAND, LAND_WEAK)),
        "floors": F.when(floors == 0, FLOORS[0]).when(floors == 1, FLOORS[1]).when(floors > 1, FLOORS[2]),
        "year": numeric.interpolate(F.abs(advert["year"] - roll["year"]).cast("double"), YEAR),
        "condominium": F.when(advert["in_condominium"] & roll["parent"].isNotNull(), CONDOMINIUM),
        "use": F.when(roll["use_fits"], USE_FITS).when(~roll["use_fits"], USE_EXCLUDED),
        "price": F.when(advert["operation"] == "sale", F.when(ratio.between(*PRICE_FITS[:2]), PRICE_FITS[2]).when((ratio < PRICE_ABSURD[0]) | (ratio > PRICE_ABSURD[1]), PRICE_ABSURD[2])),
        "pictures": PICTURES * numeric.clamp(roll["pictures"], -1.0, 1.0),
    }
    # An address that fits exactly outweighs a pin far off.
    parts["distance"] = F.when((address >= 4) & (parts["distance"] < 0), 0.0).otherwise(parts["distance"])
    return {k: F.coalesce(v, F.lit(0.0)) for k, v in parts.items()}


def log_odds(parts: Mapping[str, Column]) -> Column:
    return sum(parts.values(), F.lit(PRIOR))


def level(p: Column) -> Column:
    return F.when(p >= 0.92, "confirmed").when(p >= 0.8, "high_candidate").when(p >= 0.65, "candidate").otherwise("rejected")


#: Columns of an advert and of a roll that candidates are found and judged by.
ADVERT = ("advert", "commune", "lat", "lon", "address", "area", "built", "land", "floors", "year", "in_condominium", "kind", "operation", "price")
ROLL = ("roll", "commune", "lat", "lon", "address", "built", "land", "floors", "year", "parent", "use_fits", "valuation", "pictures")


def candidates(adverts: DataFrame, rolls: DataFrame, most: int = MOST_CANDIDATES) -> DataFrame:
    """(advert, roll, ring, metres, p, odds, level) of the best rolls of each advert, in one commune.

    Rings are searched in turn, each by the adverts that the ones before left
    without what is looked for: a confirmed
    roll, three high candidates, or from 300 m on one over 0.75. Where the
    rings have none of 0.5 at least, rolls whose address contains the
    advert's and whose land is within half of its area come beside them.
    These meet on the street, so no advert meets all rolls of its commune;
    an address that names no street and number finds none this way.
    Joins of adverts, rolls and pairs are merged, so none of them goes through the driver.
    """
    columns = ["advert", "roll", "ring", "metres", "p", "odds", "level"]
    l, r = _side(adverts, ADVERT, "a_"), _side(rolls, ROLL, "r_")
    l, r = stored(l, "adverts"), stored(r, "rolls")

    def rate(pairs: DataFrame) -> DataFrame:
        return _rated(l.hint("merge").join(pairs, "advert").join(r.hint("merge"), ["roll", "commune"])).select(*columns)

    def enough(rated: DataFrame, m: int) -> DataFrame:
        best, three = F.max("p"), F.sum((F.col("level") == "high_candidate").cast("int")) >= 3
        done = (best >= 0.92) | three | ((best > 0.75) if m >= 300 else F.lit(False))
        return rated.groupBy("advert").agg(done.alias("done")).where("done")

    at = lambda side, key, prefix: side.select(key, "commune", F.col(f"{prefix}lat").alias("lat"), F.col(f"{prefix}lon").alias("lon"))
    ringed = spatial.growing_rings(at(l, "advert", "a_"), at(r, "roll", "r_"), RADII, "advert", "roll", rate, enough, closed=False, same=["commune"])
    chosen = ringed.groupBy("advert").agg(F.max("p").alias("best"))
    weak = l.select("advert").join(chosen.hint("merge"), "advert", "left").where(F.coalesce("best", F.lit(0.0)) < 0.5).select("advert")
    hint = F.coalesce("a_land", "a_area")
    by_name = l.join(weak.hint("merge"), "advert", "left_semi").where("a_street is not null").withColumn("_key", F.col("a_street"))
    named = by_name.join(r.withColumn("_key", F.col("r_street")).hint("merge"), ["commune", "_key"]).where(F.contains("r_plain", "a_plain") & F.coalesce(F.col("r_land").between(hint * 0.5, hint * 1.5), hint.isNull()))
    others = _rated(named.drop("_key").withColumns({"metres": F.lit(None).cast("double"), "ring": F.lit(None).cast("int")}))
    both = ringed.unionByName(others.select(*columns))
    once = both.groupBy("advert", "roll").agg(F.max_by(F.struct(*columns[2:]), F.struct("p", F.col("metres").isNotNull())).alias("b")).select("advert", "roll", "b.*")
    return top_of_each(once, ["advert"], [F.desc("p"), F.asc_nulls_last("metres"), F.asc("roll")], most)


def _side(rows: DataFrame, columns: tuple[str, ...], prefix: str) -> DataFrame:
    """One side's columns, its address as it is written (plain), its word trigrams and its usual form."""
    names = rows.select(*(F.col(c).alias(c if c in columns[:2] else f"{prefix}{c}") for c in columns))
    plain = names.withColumn(f"{prefix}plain", F.when(F.col(f"{prefix}address").isNotNull(), text.upper_plain(F.col(f"{prefix}address"))))
    return addressed(plain.withColumn(f"{prefix}runs", text.word_trigrams(F.col(f"{prefix}plain"))), f"{prefix}address", prefix)


def _rated(pairs: DataFrame) -> DataFrame:
    """``pairs`` of an advert's (a_) and a roll's (r_) columns and metres, with p, odds and level."""
    advert = {c: F.col(f"a_{c}") for c in (*ADVERT, "street", "number") if c not in ("advert", "commune")}
    roll = {c: F.col(f"r_{c}") for c in (*ROLL, "street", "number") if c not in ("roll", "commune")}
    roll["distance"] = F.col("metres")
    both = F.col("a_plain").isNotNull() & F.col("r_plain").isNotNull()
    roll["similarity"] = F.when(both, F.coalesce(text.jaccard(F.col("a_runs"), F.col("r_runs")), F.lit(0.0)))
    out = pairs.withColumn("odds", log_odds(evidence(advert, roll)))
    return out.withColumn("p", numeric.sigmoid(F.col("odds"))).withColumn("level", level(F.col("p")))
