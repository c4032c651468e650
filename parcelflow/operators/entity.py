"""Adverts of one physical property: pair signals, scores, decisions, clusters and consolidation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, numeric, text
from . import spatial
from .aggregates import modes
from .graph import connected_components
from .latest import top_of_each
from .storage import stored
from .upsert import upsert

#: What a hard signal adds; its absence takes nothing. (Fixed values.)
HARD = {"same_phone": 0.60, "same_agency": 0.35, "same_photo": 0.50}
CONFIRMED, CANDIDATE = 0.75, 0.45
MOST_IN_CLUSTER, STRONG_EDGE = 20, 0.90


def decision(score: Column, evidence: Column, confirmed: float = CONFIRMED, candidate: float = CANDIDATE) -> Column:
    """Confirmed needs evidence of identity too, else a candidate."""
    return F.when((score >= confirmed) & F.coalesce(evidence, F.lit(False)), "confirmed").when(score >= candidate, "candidate").otherwise("rejected")


#: Weights of what speaks for a property's place; agreement of the geocode counts either way. (Fixed values.)
IDENTITY = {"triangulation": 0.30, "geocode": 0.25, "clean_parcel": 0.20, "suspect": -0.25, "footprint": 0.15, "aerial": 0.10}


def identity_parts(triangulation: Column, geocode_agrees: Column, parcel: Column, suspect: Column, footprint: Column, aerial: Column) -> dict[str, Column]:
    """What each signal adds; an unknown one (null) adds nothing."""
    on = lambda c: F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0)
    doubt = F.coalesce(suspect, F.lit(False))
    sizes = {"triangulation": triangulation, "geocode": F.when(geocode_agrees, 1.0).when(~geocode_agrees, -1.0), "clean_parcel": on(parcel & ~doubt), "suspect": on(doubt), "footprint": footprint, "aerial": aerial}
    return {k: F.coalesce(IDENTITY[k] * v, F.lit(0.0)) for k, v in sizes.items()}


def location_confidence(score: Column, parcel: Column, suspect: Column) -> Column:
    doubt = F.coalesce(suspect, F.lit(False)) & (score < CONFIRMED)
    return F.when(doubt, "pin_suspect").when((score >= CONFIRMED) & F.coalesce(parcel, F.lit(False)), "confirmed").when(score >= CANDIDATE, "candidate").otherwise("none")


def best_match(candidates: DataFrame, key: str, id_col: str, p_col: str, odds_col: str) -> DataFrame:
    """(key, id, p, decision) of each key's best candidate, by its distance from the second.

    Automatic at a probability of 0.92 with a lead of 0.15, or of 2.2 in log odds; none under 0.65; else for review.
    """
    best = F.sort_array(F.collect_list(F.struct(F.col(p_col).alias("p"), F.col(odds_col).alias("o"), F.col(id_col).alias("id"))), asc=False)
    # Two rows a key are kept before the shuffle by the rank limit, so no list has more.
    two = top_of_each(candidates, [key], [F.desc(p_col), F.desc(odds_col), F.desc(id_col)], 2).groupBy(key).agg(best.alias("b"))
    one, other = F.get("b", F.lit(0)), F.get("b", F.lit(1))
    clear = other.isNull() | (one["p"] - other["p"] >= 0.15) | (one["o"] - other["o"] >= 2.2)
    verdict = F.when(one["p"] < 0.65, "none").when((one["p"] >= 0.92) & clear, "auto").otherwise("review")
    return two.select(key, one["id"].alias(id_col), one["p"].alias(p_col), verdict.alias("decision"))


def evidence_odds(parts: Mapping[str, Column], prior: float = -1.2) -> Column:
    """Sum of finished log odds; a clear address (4 or more) cancels a distance that speaks against. See ``cadastre.evidence`` for the parts."""
    distance = parts.get("distance", F.lit(0.0))
    rest = sum((F.coalesce(v, F.lit(0.0)) for k, v in parts.items() if k != "distance"), F.lit(prior))
    sure = F.coalesce(parts.get("address", F.lit(0.0)), F.lit(0.0)) >= 4
    return rest + F.when(sure & (distance < 0), 0.0).otherwise(F.coalesce(distance, F.lit(0.0)))


def clusters(edges: DataFrame, least: float = CONFIRMED, most: int = MOST_IN_CLUSTER, strong: float = STRONG_EDGE) -> DataFrame:
    """(node, cluster) over edges (a, b, score): components, and of those with over ``most`` nodes the components of strong edges.

    Nodes that keep no strong edge in a large one stand alone.
    """
    good = stored(edges.where(F.col("score") >= least).select("a", "b", "score"), "strong-pairs")
    first = connected_components(good.select("a", "b"))
    large = first.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    if large.isEmpty():
        return first.select("node", F.col("component").alias("cluster"))
    split = first.join(large, "component", "left_semi")
    kept = good.where(F.col("score") >= strong).join(split.select(F.col("node").alias("a")), "a", "left_semi")
    second = connected_components(kept.select("a", "b"))
    out = first.join(large, "component", "left_anti").select("node", F.col("component").alias("cluster"))
    return out.unionByName(split.select("node").join(second, "node", "left").select("node", F.coalesce("component", "node").alias("cluster")))


def confidence(edges: DataFrame, least: float = CONFIRMED) -> DataFrame:
    """The best score at each node."""
    ends = F.explode(F.array("a", "b")).alias("node")
    return edges.where(F.col("score") >= least).select(ends, "score").groupBy("node").agg(F.max("score").alias("confidence"))


def broker_key(advertiser: Column, reference: Column, listing_id: Column) -> Column:
    """Adverts of one broker with one reference are one property; without a reference each is its own."""
    ref = F.lower(F.trim(reference))
    return F.when(F.coalesce(ref, F.lit("")) != "", F.concat_ws("|", advertiser.cast("string"), ref)).otherwise(F.concat(F.lit("listing|"), listing_id))


def triangulation(phones: Column, agencies: Column, photos: Column) -> Column:
    """Strength of shared phones, agencies and photos, at most 1."""
    some = lambda n, x: F.when(n > 0, x).otherwise(0.0)
    return F.least(F.lit(1.0), some(phones, F.least(F.lit(1.0), 0.5 + 0.15 * phones)) + some(agencies, F.least(F.lit(0.4), 0.15 * agencies)) + some(photos, F.least(F.lit(0.6), 0.3 * photos)))


def names_agree(a: Column, b: Column) -> Column:
    return F.coalesce(text.token_overlap(a, b), F.lit(0.0))


def ranking_quality(ranks: DataFrame, rank_col: str = "rank") -> DataFrame:
    """top1, top3 and mean reciprocal rank; a null rank was not found."""
    r = F.col(rank_col)
    share = lambda when: F.round(F.avg(F.coalesce(when, F.lit(False)).cast("int")), 4)
    return ranks.agg(share(r == 1).alias("top1"), share(r <= 3).alias("top3"), F.round(F.avg(F.coalesce(1 / r, F.lit(0.0))), 4).alias("mrr"))


def explained(parts: Mapping[str, Column], most: int = 3) -> Column:
    """The signals with the largest weights either way as text: "+name(0.50) -other(0.25)"; ties keep the order given."""
    rows = F.array(*(F.struct((-F.abs(v)).alias("size"), F.lit(i).alias("i"), F.lit(k).alias("name"), v.alias("v")) for i, (k, v) in enumerate(parts.items())))
    known = F.array_sort(F.filter(rows, lambda x: x["v"].isNotNull()))
    said = lambda x: F.concat(F.when(x["v"] >= 0, "+").otherwise(""), x["name"], F.lit("("), F.format_string("%.2f", x["v"]), F.lit(")"))
    return F.array_join(F.transform(F.slice(known, 1, most), said), " ")


def fed_pairs(matches: DataFrame, scored: DataFrame) -> DataFrame:
    """``matches`` (a, b, score, status, decided_by) after ``scored`` pairs (a, b, score, status, same_property).

    Pairs are ordered and counted once, with their best score. Those of one
    property and rejected ones are left out. A person's decision stays.
    """
    lo, hi = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    good = scored.where(~F.coalesce("same_property", F.lit(False)) & (F.col("status") != "rejected") & (F.col("a") != F.col("b")))
    best = good.select(lo, hi, "score", "status").groupBy("a", "b").agg(F.max_by("status", F.struct("score", "status")).alias("status"), F.max("score").alias("score"))
    new = best.withColumn("decided_by", F.lit("auto"))
    return upsert(matches, new.select(*matches.columns), ["a", "b"], when=F.col("decided_by").eqNullSafe("auto"))


def merge_plan(nodes: DataFrame, owned: DataFrame, survivors: DataFrame) -> DataFrame:
    """(listing, property, survivor, confidence, moves) for the whole family of each cluster.

    ``nodes`` (listing, cluster, confidence) are matched listings, ``owned``
    (listing, property) all listings, ``survivors`` (cluster, survivor). A
    family is its nodes and all listings of the properties they touch, which
    belong to the cluster with the smallest name that touches them. Listings
    that are not nodes keep their own confidence: it is null here.
    """
    n = nodes.join(owned, "listing", "left")
    touched = n.where(F.col("property").isNotNull()).groupBy("property").agg(F.min("cluster").alias("cluster"))
    dragged = owned.join(nodes, "listing", "left_anti").join(touched, "property").select("listing", "cluster", F.lit(None).cast("double").alias("confidence"), "property")
    family = n.select("listing", "cluster", "confidence", "property").unionByName(dragged).join(survivors, "cluster")
    return family.select("listing", "property", "survivor", "confidence", (~F.col("property").eqNullSafe(F.col("survivor"))).alias("moves"))


#: Parts that a hot key's right side is repeated in, so that its pairs are made by as many tasks.
SALTS = 8
#: Weight of each signal of a pair and, of differences, where it is clamped; unknown signals (null) add nothing. (Fixed values.)
FOOTPRINT_ES = {"distance": (-0.15, 150.0), "area": (-0.10, 50.0), "bedrooms": (0.15, None), "bathrooms": (-0.05, 3.0), "price": (-0.08, 50.0), "text": (0.12, None), "phash": (-0.20, 16.0), "kind": (0.10, None), "operation": (0.10, None)}
FOOTPRINT_CL = {"distance": (-0.25, 150.0), "area": (-0.06, 50.0), "bedrooms": (0.15, None), "bathrooms": (-0.04, 3.0), "price": (-0.06, 50.0), "text": (0.20, None), "kind": (0.10, None), "operation": (0.10, None)}


def _sides(rows: DataFrame, *columns: str) -> list[DataFrame]:
    return [rows.select(*(F.col(c).alias(f"{c}_{s}") for c in columns), F.col("id").alias(s)) for s in ("a", "b")]


def _near(left: DataFrame, right: DataFrame, metres: float, where: Column, columns: Sequence[str], same: Sequence[str] = ()) -> DataFrame:
    """(a, b) of near rows for which ``where`` holds of their ``columns``, as they meet: others are in no shuffle."""
    sides = [df.withColumnsRenamed({"id": s, **{c: f"{c}_{s}" for c in columns}}) for df, s in ((left, "a"), (right, "b"))]
    named = lambda s: [f"{c}_{s}" for c in columns]
    return spatial.pairs_within(*sides, metres, "a", "b", same=same, where=where, of_left=named("a"), of_right=named("b")).select("a", "b")


def near_alike(rows: DataFrame, metres: float = 150, share: float = 0.08) -> DataFrame:
    """(a, b), a < b, for which one may be the target and the other, active, its candidate: near, of one operation and number of bedrooms, and of areas that differ by the target's share (rounded up) at most, if known."""
    gap = F.abs(F.col("area_a") - F.col("area_b"))
    fits = lambda t, c: F.coalesce(F.col(f"is_active_{c}"), F.lit(False)) & F.coalesce(gap <= F.ceil(F.col(f"area_{t}") * share), F.lit(True))
    # Nulls are alike: the key says which are there.
    keyed = rows.select("id", "lat", "lon", "area", "is_active", F.to_json(F.struct("operation", F.coalesce("bedrooms", F.lit(-1)).alias("bedrooms"))).alias("_kind"))
    return _near(keyed, keyed, metres, (F.col("a") < F.col("b")) & (fits("a", "b") | fits("b", "a")), ["area", "is_active"], ["_kind"])


def near_or_named(rows: DataFrame, metres: float = 350, band: float = 0.3) -> DataFrame:
    """(a, b), a < b, of one commune (or an unknown one) with one phone, agency or address, or near and of prices within ``band`` of either's.

    Each key is an equi-join of its own; rows of unknown communes meet all
    communes in a second one. A pair found by several ways stays once.
    """
    known = lambda c: F.when(c != "", c)
    k = rows.select("*", known(text.fold(F.col("commune"))).alias("_c"))
    keys = {"phone": known(F.regexp_replace("phone", r"\D", "")), "agency": known(text.fold(F.col("agency"))), "address": F.when(F.length(text.fold(F.col("address"))) > 4, text.fold(F.col("address")))}
    named = k.select("id", "_c", F.explode(F.array(*(F.struct(F.lit(n).alias("n"), v.alias("v")) for n, v in keys.items()))).alias("_k")).select("id", "_c", "_k.n", "_k.v").where("v is not null")
    left = named.select(F.col("id").alias("a"), "_c", "n", "v", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("_s"))
    right = named.select(F.col("id").alias("b"), "_c", "n", "v", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
    on, ends = ["n", "v", "_s"], lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")
    inside = left.where("_c is not null").join(right.where("_c is not null"), ["_c", *on])
    across = left.where("_c is null").drop("_c").join(right.drop("_c"), on)
    x, y = F.col("price_a"), F.col("price_b")
    priced = F.coalesce((F.least(x, y) <= 0) | (F.abs(x - y) <= band * F.greatest(x, y)), F.lit(True)) | x.isNull() | y.isNull()
    placed = k.select("id", "lat", "lon", "price", "_c")
    nowhere, somewhere = placed.where("_c is null"), placed.where("_c is not null")
    near = _near(somewhere, somewhere, metres, (F.col("a") < F.col("b")) & priced, ["price"], ["_c"])
    if not nowhere.isEmpty():
        near = near.unionByName(ends(_near(nowhere.drop("_c"), placed.drop("_c"), metres, priced, ["price"])))
    return ends(inside).unionByName(ends(across)).unionByName(near).distinct()


def pair_signals(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b) with every signal, null where one side is unknown: differences of area and price in per cent of the larger.

    ``phash`` is the least distance between any hash of the one and any of
    the other: of the cover and, if there is a column ``photos``, of each photo. Texts, numbers and hashes
    are made ready once a row and stored; pairs only compare them.
    """
    photos = F.coalesce(F.col("photos"), F.array().cast("array<bigint>")) if "photos" in rows.columns else F.array().cast("array<bigint>")
    hashes = F.array_distinct(F.array_compact(F.concat(F.array("phash"), photos)))
    ready = stored(rows.withColumns({"runs": text.compared_runs(F.col("address")), "phone": text.phone(F.col("phone")), "agency": text.agency(F.col("agency")), "hashes": F.when(F.size(hashes) > 0, hashes)}), "adverts")
    columns = ("lat", "lon", "area", "bedrooms", "bathrooms", "price", "kind", "operation", "runs", "phone", "agency", "hashes")
    a, b = _sides(ready, *columns)
    one = lambda n: (F.col(f"{n}_a"), F.col(f"{n}_b"))
    percent = lambda n: F.when(F.greatest(*one(n)) > 0, F.abs(F.col(f"{n}_a") - F.col(f"{n}_b")) / F.greatest(*one(n)) * 100)
    both = lambda n: F.when(one(n)[0].isNotNull() & one(n)[1].isNotNull(), percent(n))
    same = lambda n: F.col(f"{n}_a") == F.col(f"{n}_b")
    return pairs.join(a, "a").join(b, "b").select(
        "a", "b",
        geo.haversine(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")).alias("distance"),
        both("area").alias("area"), same("bedrooms").alias("bedrooms"), F.abs(F.col("bathrooms_a") - F.col("bathrooms_b")).alias("bathrooms"),
        both("price").alias("price"), text.jaccard(*one("runs")).alias("text"), numeric.least_hamming(*one("hashes")).alias("phash"),
        same("kind").alias("kind"), same("operation").alias("operation"), same("phone").alias("same_phone"), same("agency").alias("same_agency"),
    )


def footprint_score(weights: Mapping[str, tuple[float, float | None]]) -> Column:
    """Sum of the weighted signals of ``pair_signals``, before the sigmoid."""
    total = F.lit(0.0)
    for name, (weight, most) in weights.items():
        x = F.col(name).cast("double")
        total = total + F.coalesce(weight * (numeric.clamp(x / most) if most else x), F.lit(0.0))
    return total


def pair_verdicts(signals: DataFrame) -> DataFrame:
    """The signals with the score of either market and the decision, for which phone, picture or an address alike by half is evidence; an agency is none."""
    hard = {"same_phone": F.col("same_phone"), "same_agency": F.col("same_agency"), "same_photo": F.col("phash") <= 8}
    extra = sum((F.when(F.coalesce(c, F.lit(False)), HARD[n]).otherwise(0.0) for n, c in hard.items()), F.lit(0.0))
    proof = F.coalesce(hard["same_photo"], F.lit(False)) | F.coalesce(hard["same_phone"], F.lit(False)) | F.coalesce(F.col("text") >= 0.5, F.lit(False))
    out = signals.withColumns({"footprint": numeric.sigmoid(footprint_score(FOOTPRINT_ES), 2), "score": numeric.sigmoid(footprint_score(FOOTPRINT_CL) + extra, 2), "_proof": proof})
    return out.withColumn("decision", decision(F.col("score"), F.col("_proof"))).drop("_proof")


#: Trust in where an advert says it lies, best first; other values come last. (Fixed values.)
LOCATION_TRUST = ("confirmed", "candidate", "none", "pin_suspect")
MODES = ("operation", "kind", "area", "bedrooms", "bathrooms")
PRICED = ("price", "price_uf", "uf_rate", "uf_rate_date")
PLACED = ("commune", "locality", "lat", "lon", "location_confidence", "exact_address")


def consolidated(rows: DataFrame, key: str, id_col: str = "id") -> DataFrame:
    """One row a property from its adverts.

    The commonest operation, kind, area and rooms (of equally common ones the
    one last seen); price, rate and its day of the cheapest active advert, of
    all if none is active; commune, place and address of the advert whose
    location is trusted most; the different portals, sources and kinds of
    advertiser (sorted; of the latter private persons and professionals); different
    advertisers, one at least; first and last days. Ties go by id. Columns
    that ``rows`` lack are left out. Adverts without a key have no property.
    All but the modes is one aggregation with partial sums; modes are counted by value first.
    """
    has = lambda names: [c for c in names if c in rows.columns]
    rows = rows.where(F.col(key).isNotNull())
    active = F.coalesce(F.col("is_active"), F.lit(False))
    cheapest = F.struct((~active).alias("off"), F.col("price").isNull().alias("none"), F.col("price").alias("price"), F.col(id_col).alias("id"))
    trust = F.struct(sum((F.when(F.col("location_confidence") == c, i - len(LOCATION_TRUST)).otherwise(0) for i, c in enumerate(LOCATION_TRUST)), F.lit(0)).alias("rank"), F.col(id_col).alias("id"))
    distinct = lambda c, value: F.array_sort(F.collect_set(value)).alias(c)
    known = lambda c: F.when(F.col(c) != "", F.col(c))
    sets = {"portals": ("portal", known), "source_types": ("source_type", known), "advertiser_kinds": ("advertiser_type", lambda c: F.when(F.col(c).isin("particular", "professional"), F.col(c)))}
    dates = [f(c).alias(c) for c, f in (("first_seen", F.min), ("last_seen", F.max), ("portal_first_seen", F.min)) if c in rows.columns]
    one = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("listing_count"), F.greatest(F.lit(1), F.countDistinct("advertiser_id")).alias("advertiser_count"), F.bool_or(active).alias("is_active"), *dates,
        F.min_by(F.struct(*has(PRICED)), cheapest).alias("_priced"), F.min_by(F.struct(*has(PLACED)), trust).alias("_placed"), *(distinct(n, f(c)) for n, (c, f) in sets.items() if c in rows.columns),
    )
    common = modes(rows, [key], has(MODES), "last_seen")
    typed = common.select(key, *(F.col(c).cast(rows.schema[c].dataType).alias(c) for c in has(MODES)))
    return one.join(typed, key).select("*", "_priced.*", "_placed.*").drop("_priced", "_placed")
