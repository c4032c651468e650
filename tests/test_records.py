"""Helpers of the record queries on small literals and odd rows."""

from pyspark.sql import functions as F

from parcelflow import plans
from parcelflow.functions import geo, text
from parcelflow.operators import aggregates, entity, upsert


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def ring(*corners):
    return F.array(*(F.struct(F.lit(float(a)).alias("lat"), F.lit(float(b)).alias("lon")) for a, b in corners))


def square(at, side):
    return ring((at, at), (at, at + side), (at + side, at + side), (at + side, at))


def test_polygons_meet(spark):
    cases = [(square(0, 4), square(1, 1), True), (square(1, 1), square(0, 4), True), (square(0, 2), square(1, 2), True), (square(0, 1), square(1, 1), True), (square(0, 1), square(2, 1), False)]
    assert [one(spark, geo.rings_meet(a, b)) for a, b, _ in cases] == [c for _, _, c in cases]


def test_search_box(spark):
    ask = lambda s: tuple(one(spark, text.search_box(F.lit(s).cast("string"))))
    assert ask("210778303") == ("MLC-210778303", None, "210778303", "210778303", True)
    assert ask("5495") == (None, None, "5495", "5495", False)
    assert ask("<www.example.org/x/?a#b>") == (None, "https://www.example.org/x", None, "example.org/x", False)
    assert ask("MLC-12") == ("MLC-12", None, None, None, False)
    assert ask("  ") == ask(None) == (None, None, None, None, False)


def test_refresh_reports_a_failure(spark, tmp_path):
    bad = spark.range(1).select(F.raise_error(F.lit("broken")).cast("string").alias("x"))
    got = {r["view"]: (r["ok"], r["detail"] is None) for r in upsert.refresh({"bad": bad, "good": spark.range(3)}, str(tmp_path)).collect()}
    assert got == {"bad": (False, False), "good": (True, True)}
    assert spark.read.parquet(f"{tmp_path}/good").count() == 3


def test_change_list_and_children(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 1)], "k int, x string, y int")
    new = spark.createDataFrame([(1, "a", None), (2, None, 1), (3, "c", 2)], "k int, x string, y int")
    got = {r["k"]: r["changes"] for r in upsert.with_change_list(old, new, ["k"], ["x", "y"]).collect()}
    assert got == {2: ["x"], 3: ["x", "y"]}
    left = upsert.replace_children(old, new, spark.createDataFrame([(2,)], "k int"), "k").collect()
    assert sorted(left, key=lambda r: r["k"]) == [(1, "a", None), (2, None, 1)]


def test_price_bands(spark):
    rows = spark.createDataFrame([(p,) for p in (1.0, 1.0, 1.0, 9.0, 99.0, None)], "p double")
    got = sorted(tuple(r) for r in aggregates.price_bands(rows, "p", 16, 2, depth=2).collect())
    assert got == [(0.0, 4.0, 3), (4.0, 8.0, 0), (8.0, 16.0, 2)]
    assert [tuple(r) for r in aggregates.price_bands(rows.where("p < 0"), "p", 16, 2, depth=2).collect()] == [(0.0, 16.0, 0)]


def test_explanation_and_places(spark):
    parts = {"a": F.lit(0.1), "b": F.lit(-0.5), "c": F.lit(0.3), "d": F.lit(0.2), "e": F.lit(None).cast("double")}
    assert one(spark, entity.explained(parts)) == "b(-0.50) +c(0.30) +d(0.20)"
    assert one(spark, text.place_names(F.lit("Sector de Ñuñoa, Maipú"))) == ["nunoa, maipu", "nunoa", "maipu"]
    assert one(spark, text.place_names(F.lit(None).cast("string"))) == []
    assert one(spark, text.is_company(F.lit("Sur SpA"))) and not one(spark, text.is_company(F.lit(None).cast("string")))


def test_pairs_of_adverts_against_all_pairs(spark):
    import math
    import random

    rng, names = random.Random(3), ("id", "lat", "lon", "phash", "area", "price", "bedrooms", "bathrooms", "kind", "operation", "commune", "phone", "agency", "address", "is_active")
    pick = lambda *x: rng.choice(x)
    rows = [(i, pick(None, -33.4 + rng.random() / 100), -70.6 + rng.random() / 100, pick(None, 0, 255, -1), pick(None, 50.0, 54.0, 58.5), pick(None, 0.0, 100.0, 130.0, 143.0, 200.0), pick(None, 1, 2), pick(None, 1, 4), pick(None, "flat", "house"), pick(None, "sale", "rent"), pick(None, "Ñuñoa", "nunoa", "Maipú"), pick(None, "", f"+56 9 1234 {rng.randrange(20):04}"), pick(None, "", f"Agency {rng.randrange(20)}"), pick(None, "ab", f"Calle {rng.randrange(20)}"), rng.random() < 0.7) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, lat double, lon double, phash long, area double, price double, bedrooms int, bathrooms int, kind string, operation string, commune string, phone string, agency string, address string, is_active boolean")
    plain = lambda s: (s or "").lower().replace("ñ", "n").replace("ú", "u").strip()
    digits = lambda s: "".join(c for c in s or "" if c.isdigit())

    def metres(a, b):
        if None in (a["lat"], b["lat"]):
            return math.inf
        p, q = math.radians(a["lat"]), math.radians(b["lat"])
        return 2 * 6_371_000 * math.asin(math.sqrt(math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b["lon"] - a["lon"]) / 2) ** 2))

    def alike(t, c):
        return c["is_active"] and t["operation"] == c["operation"] and t["bedrooms"] == c["bedrooms"] and (None in (t["area"], c["area"]) or abs(t["area"] - c["area"]) <= math.ceil(t["area"] * 0.08)) and metres(t, c) <= 150

    def named(t, c):
        if plain(t["commune"]) and plain(c["commune"]) and plain(t["commune"]) != plain(c["commune"]):
            return False
        if (digits(t["phone"]) and digits(t["phone"]) == digits(c["phone"])) or (t["agency"] and plain(t["agency"]) == plain(c["agency"])) or (len(plain(t["address"])) > 4 and plain(t["address"]) == plain(c["address"])):
            return True
        return metres(t, c) <= 350 and (None in (t["price"], c["price"]) or t["price"] <= 0 or abs(t["price"] - c["price"]) / t["price"] <= 0.3)

    of = [dict(zip(names, r, strict=True)) for r in rows]
    for made, rule in ((entity.near_alike(df), alike), (entity.near_or_named(df), named)):
        wanted = sorted((x["id"], y["id"]) for x in of for y in of if x["id"] < y["id"] and (rule(x, y) or rule(y, x)))
        assert wanted and sorted(tuple(r) for r in made.collect()) == wanted
    far = [r for r in entity.near_or_named(df).collect() if metres(of[r["a"]], of[r["b"]]) > 350]
    assert far


def test_verdicts_use_every_signal(spark):
    base = {"lat": 0.0, "lon": 0.0, "phash": 0, "area": 100.0, "price": 100.0, "bedrooms": 2, "bathrooms": 1, "kind": "flat", "operation": "sale", "phone": None, "agency": "Sur", "address": None}
    other = {**base, "phash": 255, "area": 80.0, "price": 80.0, "bathrooms": 2}
    kinds = "id long, lat double, lon double, phash long, area double, price double, bedrooms int, bathrooms int, kind string, operation string, phone string, agency string, address string"
    at = lambda i, d: (i, *(d[k.split()[0]] for k in kinds.split(", ")[1:]))
    rows = spark.createDataFrame([at(1, base), at(2, other), at(3, {**other, "phash": None, "bedrooms": 3})], kinds)
    got = {r["b"]: r for r in entity.pair_verdicts(entity.pair_signals(spark.createDataFrame([(1, 2), (1, 3)], "a long, b long"), rows)).collect()}
    logit = lambda x: 1 / (1 + 2.718281828459045 ** (-2 * x))
    assert abs(got[2]["footprint"] - logit(-0.04 + 0.15 - 0.05 / 3 - 0.032 - 0.10 + 0.2)) < 1e-9
    assert abs(got[2]["score"] - logit(-0.024 + 0.15 - 0.04 / 3 - 0.024 + 0.2 + 0.35 + 0.50)) < 1e-9
    assert got[2]["decision"] == "confirmed" and got[3]["decision"] == "candidate"


def test_whole_texts_of_all_languages(spark, tmp_path):
    import re

    from parcelflow.functions.text import _ACCENTED, _PLAIN

    long = "É tré Ñandú -- " * 40 + "Ende!"
    rows = [(1, long, "es"), (2, "Größe: Ähre", "de"), (3, long, "fr"), (4, None, "en"), (5, "", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    fold = lambda s: (s or "").translate(str.maketrans(_ACCENTED, _PLAIN)).lower()
    wanted = {i: (fold(t), re.sub("[^a-z0-9]+", "-", fold(t)).strip("-")) for i, t, _ in rows}
    got = {r["doc_id"]: (r["folded"], r["slug"]) for r in plans.queries()["STR-01_03_whole_texts"](spark, str(tmp_path)).collect()}
    assert got == wanted and got[3][1].endswith("-ende")


def test_whole_tables_are_kept(spark, sf_dir):
    rows = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count()
    made = plans.queries()
    assert made["ARR-02_zipped_whole"](spark, sf_dir).count() == 2 * rows("orders")
    assert made["SRC-05_json_lines_whole"](spark, sf_dir).count() == rows("events")
    got = [(r["quality"] is not None, -(r["quality"] or 0), r["doc_id"]) for r in made["SRT-05_null_order_whole"](spark, sf_dir).collect()]
    assert got == sorted(got) and len(got) == rows("documents")
