"""Each query of the registry against its SQL twin, and helpers on small literals."""

import datetime
import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from parcelflow import plans
from parcelflow.functions import geo, numeric, text
from parcelflow.operators import cadastre, changes, entity, filters, joins, outbox, paging, quantiles, ring, spatial, storage, upsert
from parcelflow.operators.graph import connected_components
from tests.compare import assert_same, rows_of


@pytest.mark.parametrize("name", plans.queries())
def test_query(spark, sf_dir, name):
    sql = plans.oracle_sql().get(name)
    df = plans.queries()[name](spark, sf_dir)
    if sql:
        assert_same(df, sql, sf_dir)
    else:
        # Those without a twin have tests of their own; here they have to give rows.
        assert df.count() > 0


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("made", "expected"),
    [
        (lambda s: text.fold(F.lit(" Ñuñoa É ")), "nunoa e"),
        (lambda s: text.slug(F.lit("Las Condes, RM")), "las-condes-rm"),
        (lambda s: text.text_similarity(F.lit(""), F.lit("a")), None),
        (lambda s: text.text_similarity(F.lit("casa"), F.lit("Cása")), 1.0),
        (lambda s: text.token_overlap(F.lit("Juan Pérez Soto"), F.lit("perez juan")), 1.0),
        (lambda s: text.word_similarity(F.lit("a b"), F.lit("a b c d")), 0.5),
        (lambda s: text.address(F.lit("Avda. Dr. Torres 12")), "AVENIDA DOCTOR TORRES 12"),
        (lambda s: text.street_number(F.lit("Av. Italia 1234 dp 5")), 1234),
        (lambda s: text.same_address(F.lit("Av Italia 12"), F.lit("Avenida Italia 13")), False),
        (lambda s: text.same_address(F.lit("Av Italia 12"), F.lit("Avenida Itália 12, Ñuñoa")), True),
        (lambda s: text.same_address(F.lit("Av Italia"), F.lit("Avenida Italia 13")), True),
        (lambda s: text.same_address(F.lit("A 12"), F.lit("B 12")), True),
        (lambda s: text.same_address(F.lit("A"), F.lit("B 12")), False),
        (lambda s: text.same_address(F.lit(""), F.lit("")), False),
        (lambda s: text.address(F.lit("ave. Italia 12")), "AVENIDA ITALIA 12"),
        (lambda s: text.address(F.lit("Clle. Uno 3")), "CALLE UNO 3"),
        (lambda s: text.base_address(F.lit("Italia 1234 dp 501")), "ITALIA 1234"),
        (lambda s: text.base_address(F.lit("ITALIA 1234 DPTO 501")), "ITALIA 1234"),
        (lambda s: text.is_unit(F.lit("LOS PINOS 5 TORRE 2")), True),
        (lambda s: text.is_unit(F.lit("AV LA TORRE 45")), False),
        (lambda s: text.base_address(F.lit("LOS MILITARES 5150 ESTUDIO 2")), "LOS MILITARES 5150 ESTUDIO 2"),
        (lambda s: text.text_similarity(F.lit("a"), F.lit("a")), None),
        (lambda s: text.text_similarity(F.lit("casa, sur"), F.lit("CASA - SUR")), 1.0),
        (lambda s: text.is_unit(F.lit("Italia 1234")), False),
        (lambda s: text.roll(F.lit("00795-00198")), "795-198"),
        (lambda s: text.roll(F.lit("795")), None),
        (lambda s: text.roll_padded(F.lit("795-198")), "00795-00198"),
        (lambda s: text.phone(F.lit("+56 9 8765 4321")), "987654321"),
        (lambda s: text.phone(F.lit("123")), None),
        (lambda s: text.agency(F.lit("A.")), None),
        (lambda s: text.without_tags(F.lit("<p>a&amp;b <b>c</b></p><script>x</script>")), "a&b c"),
        (lambda s: text.age_days(F.lit("Publicado hace 3 semanas")), 21),
        (lambda s: text.age_days(F.lit("Publicado hoy")), 0),
        (lambda s: text.age_days(F.lit("hace tiempo")), None),
        (lambda s: text.areas(F.lit("Casa 4.022/258 Mt2"))["land"], 4022),
        (lambda s: text.clean_url(F.lit("example.org/a/?q=1#x")), "https://example.org/a"),
        (lambda s: text.first_pattern(F.lit("Inversiones X SpA"), [(r"\bspa\b|ltda", "company")], "person"), "company"),
        (lambda s: text.labelled_amount(F.lit("Total deuda CLP 1.234.567"), "total"), 1234567),
        (lambda s: numeric.local_int(F.lit("1.234,6")), 1235),
        (lambda s: numeric.local_decimal(F.lit("1.234,5")), 1234.5),
        (lambda s: numeric.leading_int(F.lit(" 12abc")), 12),
        (lambda s: numeric.leading_int(F.lit("")), None),
        (lambda s: numeric.difference(F.lit(0.0), F.lit(0.0)), None),
        (lambda s: numeric.interpolate(F.lit(75.0), [(50, 1.0), (100, 0.0)]), 0.5),
        (lambda s: numeric.interpolate(F.lit(500.0), [(50, 1.0), (100, 0.0)]), 0.0),
        (lambda s: numeric.hamming(numeric.hash_of_hex(F.lit("ffffffffffffffff")), numeric.hash_of_hex(F.lit("0" * 16))), 64),
        (lambda s: numeric.hash_of_hex(F.lit("xyz")), None),
        (lambda s: numeric.least_hamming(F.array(F.lit(1), F.lit(7)), F.array(F.lit(3))), 1),
        (lambda s: numeric.any_date(F.lit("el 03/02/2024.")).cast("string"), "2024-02-03"),
        (lambda s: numeric.any_date(F.lit("31/02/2024")), None),
        (lambda s: numeric.semester(F.lit("2024-07-01").cast("date")), "2024-2"),
        (lambda s: numeric.currency(F.lit("eur")), "CLP"),
        (lambda s: changes.backoff_seconds(F.lit(9)), 7200),
        (lambda s: changes.exhaustive(F.lit(691), F.lit(692)), True),
        (lambda s: filters.equals(F.lit(1), "all") is None and F.lit(True), True),
    ],
)
def test_scalar(spark, made, expected):
    assert one(spark, made(spark)) == expected


def test_pages_do_not_overlap(spark):
    df = spark.createDataFrame([(i, float(i % 3)) for i in range(50)], "id int, price double")
    order = paging.order_of("price_asc")
    seen = [r["id"] for n in (1, 2, 3) for r in paging.page(df, order, n, 20).collect()]
    assert sorted(seen) == list(range(50))
    assert paging.clamp_page(0, 10**6) == (1, 200)


def test_upsert_twice_changes_nothing(spark):
    t = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    s = spark.createDataFrame([(2, "b"), (3, "c")], "k int, v string")
    once = upsert.upsert(t, s, ["k"])
    assert sorted(once.collect()) == sorted(upsert.upsert(once, s, ["k"]).collect()) == [(1, "a"), (2, "b"), (3, "c")]
    locked = upsert.upsert(t, s, ["k"], when=F.col("v").isNotNull())
    assert sorted(locked.collect(), key=lambda r: r[0]) == [(1, "a"), (2, None), (3, "c")]


def test_components_and_large_clusters(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7)]
    got = dict(connected_components(spark.createDataFrame(edges, "a int, b int")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    chain = [(i, i + 1, 0.95 if i < 3 else 0.8) for i in range(1, 25)]
    got = dict(entity.clusters(spark.createDataFrame(chain, "a int, b int, score double")).collect())
    assert {k for k, v in got.items() if v == 1} == {1, 2, 3} and got[20] == 20


def test_components_of_random_edges(spark):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(60)]
    rng.shuffle(chain)
    for edges in (chain, [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)], [(7, i) for i in range(200)]):
        assert dict(connected_components(spark.createDataFrame(edges, "a int, b int")).collect()) == brute_components(edges)
    assert connected_components(spark.createDataFrame([(None, 1), (2, 2)], "a int, b int")).count() == 0


def brute_components(edges):
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i in parent}


def test_pigeonring(spark):
    """All close pairs and no other, few candidates, and the same components where keys are crowded."""
    rng = random.Random(3)
    words = {rng.getrandbits(64) for _ in range(40)}
    for v in list(words):
        words |= {v ^ sum(1 << b for b in rng.sample(range(64), k)) for k in (1, 3, 4, 5)}
    words |= {sum(1 << b for b in rng.sample(range(12), k)) for k in (1, 2, 3) for _ in range(30)}
    words = [ring.signed(v) for v in words]
    df = spark.createDataFrame([(v,) for v in words], "fp long")
    bits = {tuple(sorted(p)): ((p[0] ^ p[1]) % (1 << 64)).bit_count() for p in combinations(words, 2)}
    want = {p for p, n in bits.items() if n <= 4}
    got = [tuple(r) for r in ring.close_links(df, 4).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    met = ring.candidates(df, 4).select("start", F.col("a").bitwiseXOR(F.col("b")).alias("x"))
    passed = met.where(ring.Ring(4).first_start(F.col("x")) == F.col("start"))
    # The rest of the chain removes most of what meets, before any bits are counted.
    assert len(want) <= passed.count() < met.count() < len(bits) / 2
    for crowded in (1, 8):
        assert dict(connected_components(ring.close_links(df, 4, crowded=crowded)).collect()) == brute_components(want)
    assert {tuple(r) for r in ring.close_pairs(df, 8, links=3).collect()} == {(*p, n) for p, n in bits.items() if n <= 8}


def test_pairs_are_scored_either_way(spark):
    """Differences count against a pair, equal values for it; what is unknown does neither; a far pair of unlike adverts is rejected."""
    columns = "id int, lat double, lon double, area double, bedrooms int, bathrooms int, price double, kind string, operation string, address string, phone string, agency string, phash long"
    rows = [
        (1, 0.0, 0.0, 50.0, 2, 1, 100.0, "casa", "sale", "Avda. Ñuñoa 12", "+56 9 8765 4321", "Sur Ltda.", 7),
        (2, 0.0, 0.0001, 50.0, 2, 1, 100.0, "casa", "sale", "AVDA NUNOA, 12", "987654321", "sur ltda", 7),
        (3, 0.0, 0.09, 200.0, 5, 4, 900.0, "sitio", "rent", "Calle del Mar 3", "11111111", "Norte", -1),
        (4, None, None, None, None, None, None, None, None, None, None, None, None),
        (5, 0.0, 0.0, 50.0, 2, 1, 100.0, "casa", "sale", None, None, "SUR LTDA", None),
    ]
    df = spark.createDataFrame(rows, columns)
    pairs = spark.createDataFrame([(1, 2), (2, 1), (1, 3), (1, 4), (1, 5)], "a int, b int")
    got = {(r["a"], r["b"]): r for r in entity.pair_verdicts(entity.pair_signals(pairs, df)).collect()}
    assert got[1, 2]["score"] == got[2, 1]["score"] and got[1, 2]["decision"] == "confirmed" and got[1, 2]["text"] == 1.0 and got[1, 2]["same_phone"] and got[1, 2]["same_agency"]
    # All at their worst: -0.25 - 0.06 - 0.04 - 0.06, and a little for the trigrams that the addresses share.
    assert got[1, 3]["decision"] == "rejected" and 0.3 < got[1, 3]["score"] < 0.36
    assert got[1, 4]["score"] == 0.5 and got[1, 4]["decision"] == "candidate" and got[1, 4]["distance"] is None
    # One agency without a phone, a picture or an address in common is no proof.
    assert got[1, 5]["score"] >= entity.CONFIRMED - 0.1 and got[1, 5]["decision"] == "candidate"
    assert one(spark, entity.decision(F.lit(0.9), F.lit(None).cast("boolean"))) == "candidate"


def test_outbox_steps(spark):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    none = spark.createDataFrame([], "listing_id long, dirty_at timestamp, attempts int, next_try_at timestamp, last_error string")
    box = outbox.marked(none, spark.createDataFrame([(1, at(0)), (1, at(5)), (2, at(9)), (3, at(0))], "listing_id long, at timestamp"), "listing_id")
    assert sorted(r["listing_id"] for r in outbox.claimed(box, F.lit(at(10))).collect()) == [1, 3]
    assert [r["listing_id"] for r in outbox.claimed(box, F.lit(at(10)), most=1).collect()] == [3]
    told = spark.createDataFrame([(1, at(4), None), (2, at(9), "down"), (3, at(1), None)], "listing_id long, sent_at timestamp, error string")
    left = {r["listing_id"]: r for r in outbox.settled(box, told, "listing_id", F.lit(at(20))).collect()}
    # 1 became dirty after it was sent and stays; 2 failed and waits for half a minute; 3 is done.
    assert set(left) == {1, 2} and left[1]["attempts"] == 0 and left[2]["attempts"] == 1
    assert left[2]["next_try_at"] == at(50) and left[2]["last_error"] == "down"


def test_candidates_of_the_cadastre(spark):
    """Against every roll of the commune, rated by the same evidence and chosen by rings in plain Python."""
    from parcelflow.plans import matching

    l, r = matching._adverts_and_rolls(spark, "/root/testdata/sf0.001")
    got = {}
    for x in cadastre.candidates(l, r).collect():
        got.setdefault(x["advert"], []).append((round(x["p"], 9), x["roll"], x["metres"]))
    l, r = l.where("advert % 5 = 0"), r
    pairs = cadastre._side(l, cadastre.ADVERT, "a_").join(cadastre._side(r, cadastre.ROLL, "r_"), "commune")
    metres = geo.haversine(F.col("a_lat"), F.col("a_lon"), F.col("r_lat"), F.col("r_lon"))
    ringed, named = {}, {}
    for x in cadastre._rated(pairs.withColumn("metres", metres).where("metres < 2500")).collect():
        ringed.setdefault(x["advert"], []).append((x["p"], x["roll"], x["metres"], x["level"]))
    hint = F.coalesce("a_land", "a_area")
    fits = F.contains("r_plain", "a_plain") & F.coalesce(F.col("r_land").between(hint * 0.5, hint * 1.5), hint.isNull())
    for x in cadastre._rated(pairs.where(fits).withColumn("metres", F.lit(None).cast("double"))).collect():
        named.setdefault(x["advert"], []).append((x["p"], x["roll"], None, x["level"]))
    for (a,) in l.select("advert").collect():
        mine = ringed.get(a, [])
        chosen = mine
        for m in cadastre.RADII:
            some = [x for x in mine if x[2] < m]
            if some and (max(some)[0] >= 0.92 or sum(x[3] == "high_candidate" for x in some) >= 3 or m >= 300 and max(some)[0] > 0.75):
                chosen = some
                break
        if max((x[0] for x in mine), default=0) < 0.5:
            chosen = chosen + named.get(a, [])
        best = {}
        for p, roll, d, _ in sorted(chosen, key=lambda x: (x[0], x[2] is not None)):
            best[roll] = (p, roll, d)
        want = sorted(best.values(), key=lambda x: (-x[0], x[2] is None, x[2] or 0, x[1]))[: cadastre.MOST_CANDIDATES]
        assert sorted((round(p, 9), i) for p, i, _ in want) == sorted(x[:2] for x in got.get(a, [])), a


def test_candidates_without_the_driver(spark, monkeypatch):
    """Tables small enough to be broadcast are merged all the same, and adverts meet the rolls of their commune alone."""
    from parcelflow.plans import matching

    made, met, within = [], [], spatial.pairs_within
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()

    def noted(df, name):
        made.append(plan(df))
        return storage.stored(df, name)

    def counted(*sides, **how):
        met.append(within(*sides, **how))
        return met[-1]

    monkeypatch.setattr(cadastre, "stored", noted)
    monkeypatch.setattr(spatial, "stored", noted)
    monkeypatch.setattr(spatial, "pairs_within", counted)
    monkeypatch.setattr(cadastre, "RADII", (300, 2500))
    l, r = matching._adverts_and_rolls(spark, "/root/testdata/sf0.001")
    l, r = l.withColumn("commune", F.col("advert") % 3), r.withColumn("commune", F.col("roll") % 3)
    made.append(plan(cadastre.candidates(l, r)))
    assert [p.count("Broadcast") for p in made] == [0] * len(made) and sum(p.count("SortMergeJoin") for p in made) > 10
    assert len(met) == 2 and all(p.count() > 0 and p.where("advert % 3 <> roll % 3").isEmpty() for p in met)


def test_points_at_a_distance(spark):
    assert abs(one(spark, geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) - 111_194.9) < 1
    square = F.array(*(F.struct(F.lit(float(a)).alias("lat"), F.lit(float(b)).alias("lon")) for a, b in ((0, 0), (0, 2), (2, 2), (2, 0))))
    assert one(spark, geo.in_ring(F.lit(1.0), F.lit(1.0), square)) and not one(spark, geo.in_ring(F.lit(3.0), F.lit(1.0), square))
    assert one(spark, geo.centroid(square)).asDict() == {"lat": 1.0, "lon": 1.0}
    assert "equal_coordinates" in one(spark, geo.pin_doubts(F.lit(33.12345), F.lit(-33.12345), F.lit(0.0), F.lit(0.0)))
    assert geo.grid(0, 0, 0.01, 0.01, 500, spark).count() == 9


def test_join_any_and_names(spark):
    a = spark.createDataFrame([(1, "p", None), (2, "q", "z")], "i int, x string, y string")
    b = spark.createDataFrame([(9, "p", "z")], "j int, u string, v string")
    assert sorted(joins.join_any(a, b, [("x", "u"), ("y", "v")], "i", "j").collect()) == [(1, 9), (2, 9)]
    names = spark.createDataFrame([("centro", 1), ("centro norte", 2)], "n string, z int")
    got = joins.longest_name_in(a.select("i", F.lit("Casa en Centro Norte").alias("t")), F.col("t"), names, "n", "z", "i").collect()
    assert [r["z"] for r in got] == [2, 2]


def test_names_in_texts_against_all_pairs(spark):
    rng = random.Random(2)
    make = lambda n: "".join(rng.choice("abÑ ") for _ in range(n))
    names = sorted({make(rng.randint(1, 6)) for _ in range(200)})
    texts = [(i, make(rng.randint(0, 30))) for i in range(300)] + [(300, None)]
    got = dict(joins.longest_name_in(spark.createDataFrame(texts, "i int, t string"), F.col("t"), spark.createDataFrame(list(zip(names, range(len(names)), strict=True)), "n string, z int"), "n", "z", "i").select("i", "z").collect())
    for i, t in texts:
        hits = sorted((-len(n), n.lower()) for n in names if n.lower() in (t or "").lower() and t is not None)
        assert (names[got[i]].lower() if got[i] is not None else None) == (hits[0][1] if hits else None)


def test_quantiles_against_the_built_in(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab") if rng.random() < 0.9 else None, rng.choice((rng.random() * 1e6, -rng.random(), float(rng.randint(0, 3)), None))) for _ in range(3000)] + [("c", None), ("d", 5.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    qs = (0.0, 0.25, 0.5, 0.9, 1.0)
    want = df.groupBy("k").agg(*(F.percentile("v", F.lit(q)).alias(f"q{i}") for i, q in enumerate(qs)))
    for parts in (1024, 3):
        got = quantiles.quantiles(df, ["k"], {f"q{i}": (F.col("v"), q) for i, q in enumerate(qs)}, parts=parts)
        assert rows_of(want.columns, want.collect()) == rows_of(got.columns, got.select(*want.columns).collect())
    total = quantiles.quantiles(df, [], {"m": (F.col("v"), 0.5), "n": (F.when(F.col("k") == "c", F.col("v")), 0.5)}).first()
    assert abs(total["m"] - df.agg(F.percentile("v", F.lit(0.5))).first()[0]) < 1e-6 and total["n"] is None


def test_as_of_over_long_gaps(spark):
    rng = random.Random(7)
    day = lambda: datetime.datetime(2020, 1, 1) + datetime.timedelta(days=rng.randint(0, 900), hours=rng.randint(0, 1))
    rates = [(k, t, float(i)) for i, (k, t) in enumerate({(rng.choice("ab"), day()) for _ in range(12)})]
    rows = [(i, rng.choice("abc"), day()) for i in range(300)] + [(300, "a", None)]
    got = joins.as_of(spark.createDataFrame(rows, "i int, k string, t timestamp"), spark.createDataFrame(rates, "k string, d timestamp, v double"), "t", "d", ["v"], ["k"]).collect()
    want = {i: max(((d, v) for c, d, v in rates if c == k and t and d <= t), default=(None, None))[1] for i, k, t in rows}
    assert {r["i"]: r["v"] for r in got} == want and len(got) == len(rows)


def test_near_points_anywhere(spark):
    """All pairs and no other, at the poles and across the date line too."""
    rng = random.Random(1)
    near = [(rng.choice((0.0, 60.0, 84.9, -89.99, 89.999, -33.4)), rng.choice((0.0, 179.999, -180.0, -179.998, 180.0))) for _ in range(40)]
    pts = [(i, max(-90.0, min(90.0, a + rng.gauss(0, 0.004))), b + rng.gauss(0, 0.02) * (20 if abs(a) > 84 else 1)) for i, (a, b) in enumerate(near * 3)]
    pts = [(i, a, (b + 180) % 360 - 180) for i, a, b in pts] + [(999, None, 1.0)]
    df = spark.createDataFrame(pts, "i int, lat double, lon double")

    def metres(p, q):
        f, g, l = math.radians(p[1]), math.radians(q[1]), math.radians(q[2] - p[2])
        return 2 * geo.EARTH_M * math.asin(math.sqrt(min(1, math.sin((g - f) / 2) ** 2 + math.cos(f) * math.cos(g) * math.sin(l / 2) ** 2)))

    want = {(p[0], q[0]) for p in pts[:-1] for q in pts[:-1] if metres(p, q) <= 800}
    got = [(r["i"], r["j"]) for r in spatial.pairs_within(df, df.withColumnRenamed("i", "j"), 800, "i", "j").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300


def test_parcels_of_many_sizes(spark):
    rng = random.Random(3)
    boxes = [(i, rng.uniform(-1, 1), rng.uniform(-1, 1), 10 ** rng.uniform(-3, 1), 10 ** rng.uniform(-3, 1)) for i in range(80)]
    ring = lambda s, w, h, v: [(s, w), (s, w + v), (s + h, w + v), (s + h, w)]
    parcels = spark.createDataFrame([(i, ring(*b)) for i, *b in boxes], "p int, ring array<struct<lat: double, lon: double>>")
    pts = [(i, rng.uniform(-1.5, 3), rng.uniform(-1.5, 3)) for i in range(400)]
    got = sorted(tuple(r) for r in spatial.in_parcels(spark.createDataFrame(pts, "i int, lat double, lon double"), parcels, "i", "p").collect())
    assert got == sorted((i, p) for i, a, o in pts for p, s, w, h, v in boxes if s < a < s + h and w < o < w + v)
    assert spatial.in_parcels(spark.createDataFrame(pts, "i int, lat double, lon double"), parcels.limit(0), "i", "p").count() == 0


def test_dense_cells_are_split(spark):
    """A hundred thousand points in one cell: no meeting place has more than the bound, and the rows stay the same."""
    n = 100_000
    pts = spark.range(n).selectExpr("id as i", "0.2 + 0.0001 * pmod(xxhash64(id), 90) as lat", "0.2 + 0.0001 * pmod(xxhash64(id, 1), 90) as lon")
    ring = lambda s, w, h: F.array(*(F.struct((s + a * h).alias("lat"), (w + b * h).alias("lon")) for a, b in ((0, 0), (0, 1), (1, 1), (1, 0))))
    parcels = spark.range(40).select(F.col("id").alias("p"), ring(0.2 + 0.00022 * F.col("id") + 0.00005, 0.2 + 0.0002 * (F.col("id") % 7) + 0.00005, F.lit(0.0011)).alias("ring"))
    got = spatial.in_parcels(pts, parcels, "i", "p")
    one_way = spatial.in_parcels(pts, parcels, "i", "p", most=10**9)
    assert got.count() == one_way.count() > n // 2 and got.exceptAll(one_way).isEmpty()
    cells = pts.select("i", F.lit(1).alias("k"), ((F.col("lat") - 0.2) / 0.01).alias("fu"), ((F.col("lon") - 0.2) / 0.01).alias("fv"))
    whole = spark.range(3).select("id", F.lit(1).alias("k"), F.lit(0.0).alias("lu"), F.lit(1.0).alias("hu"), F.lit(0.0).alias("lv"), F.lit(1.0).alias("hv"))
    placed, covers = spatial.refined(cells, whole, ["k"], 1000)
    sizes = placed.groupBy("k", "leaf", "part").count()
    assert sizes.agg(F.max("count")).first()[0] <= 1000 and placed.count() == n
    assert placed.join(covers, ["k", "leaf", "part"]).groupBy("id").count().where(f"count = {n}").count() == 3
    # All in one place: no quarter parts them, chance does.
    same, all_of = spatial.refined(cells.withColumns({"fu": F.lit(0.3), "fv": F.lit(0.7)}), whole, ["k"], 5000, 3)
    sizes = same.groupBy("k", "leaf", "part").count()
    assert sizes.agg(F.max("count")).first()[0] < 6000 and same.join(all_of, ["k", "leaf", "part"]).count() == 3 * n


def test_dense_neighbours_anywhere(spark):
    """Splitting cells changes no pair, at poles and the date line too."""
    rng = random.Random(4)
    pts = [(i, max(-90.0, min(90.0, a + rng.gauss(0, 0.003))), (o + rng.gauss(0, 0.01) * (30 if abs(a) > 84 else 1) + 180) % 360 - 180) for i, (a, o) in enumerate([(rng.choice((0.0, 89.999, -89.99, 60.0)), rng.choice((179.999, 0.0))) for _ in range(300)])]
    df = spark.createDataFrame(pts, "i int, lat double, lon double")
    pairs = lambda most: sorted((r["i"], r["j"]) for r in spatial.pairs_within(df, df.withColumnRenamed("i", "j"), 900, "i", "j", most).collect())
    assert pairs(3) == pairs(10**9) and len(pairs(3)) > 3000


def test_rings_make_fewer_pairs(spark, monkeypatch):
    """Dense places are settled by the small rings: the wide ones are made for few points."""
    rng = random.Random(2)
    pts = [(i, -33.4 + rng.gauss(0, 0.003), -70.6 + rng.gauss(0, 0.003)) for i in range(400)] + [(1000 + i, -33.4 + 0.002 * i, -70.59) for i in range(12)]
    df = spark.createDataFrame(pts, "i int, lat double, lon double")
    other, steps = df.withColumnRenamed("i", "j"), (100, 300, 1000, 2500)
    enough = lambda found, _: found.groupBy("i").count().where("count >= 3")
    found = spatial.growing_rings(df, other, steps, "i", "j", lambda d: d.where("i <> j"), enough).collect()
    every = spatial.pairs_within(df, other, 2500, "i", "j").where("i <> j").collect()
    assert len(found) < 0.25 * len(every)
    of, had = {}, {}
    for rows, to in ((every, of), (found, had)):
        for r in rows:
            to.setdefault(r["i"], []).append(r["metres"])
    for i, _, _ in pts:
        mine = of.get(i, [])
        ring = next((m for m in steps if sum(d <= m for d in mine) >= 3), steps[-1])
        assert sorted(d for d in mine if d <= ring) == sorted(had.get(i, []))


def test_shapes_with_holes_and_parts(spark):
    """A block with a courtyard, an islet in the courtyard, and a second part."""
    square = lambda s, w, h: [(s, w), (s, w + h), (s + h, w + h), (s + h, w)]
    rings = [square(0.0, 0.0, 4.0), square(1.0, 1.0, 2.0), square(1.75, 1.75, 0.5), square(10.0, 0.0, 1.0)]
    parcels = spark.createDataFrame([(1, rings), (2, [square(0.0, 0.0, 20.0)])], "p int, rings array<array<struct<lat: double, lon: double>>>")
    pts = [(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 2.0, 2.0), (4, 10.5, 0.5), (5, 5.0, 5.0), (6, 30.0, 0.0)]
    got = spatial.in_parcels(spark.createDataFrame(pts, "i int, lat double, lon double"), parcels, "i", "p", size=0.5)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1), (1, 2), (2, 2), (3, 1), (3, 2), (4, 1), (4, 2), (5, 2)]


def test_simplified_rings(spark):
    ring = lambda *ps: F.array(*(F.struct(F.lit(float(a)).alias("lat"), F.lit(float(b)).alias("lon")) for a, b in ps))
    kept = one(spark, geo.simplified(ring((0, 0), (0, 0.5), (0, 1), (0.5, 1.000001), (1, 1), (1, 0)), 5))
    assert [(p["lat"], p["lon"]) for p in kept] == [(0, 0), (0, 1), (1, 1), (1, 0)]
    assert len(one(spark, geo.simplified(ring((0, 0), (0, 1), (0, 2), (0, 3)), 5))) == 3


def test_copies_of_sets_meet_as_classes(spark):
    from parcelflow.operators import joins

    names = [("a b c d", 4), ("a b c e", 3), ("x y", 2), ("a b c d e", 1), ("", 2)]
    rows, k = [], 0
    for g in ("p", "q", None):
        for name, n in names:
            for _ in range(n):
                k += 1
                rows.append((k * 7 % 1009, g, name.split()))
    df = spark.createDataFrame(rows, "k long, g string, t array<string>")
    sim = lambda a, b: len({*a} & {*b}) / len({*a} | {*b})
    both = {(a, b): sim(s, t) for a, g, s in rows for b, h, t in rows if a != b and g and g == h and s and t and sim(s, t) >= 0.6}
    assert {tuple(r) for r in joins.similar_sets(df, "k", "t", 0.6, ["g"]).collect()} == {(a, b, s) for (a, b), s in both.items() if a < b}
    want = {(a, b, s) for (a, b), s in both.items() if sum((-t, d) < (-s, b) for (c, d), t in both.items() if c == a) < 3}
    assert {tuple(r) for r in joins.most_similar(df, "k", "t", 0.6, 3, ["g"]).collect()} == want
    # Twelve thousand copies: each finds its five without meeting all others, and pairs come from parts of the class.
    many = spark.range(12_000).select("id", F.array(F.lit("a"), F.lit("b")).alias("t"))
    got = joins.most_similar(many, "id", "t", 0.9, 5)
    assert got.count() == 60_000 and got.agg(F.max("found")).first()[0] == 5
    assert joins.similar_sets(many.where("id < 4500"), "id", "t", 0.9).agg(F.count(F.lit(1)), F.countDistinct("a", "b")).first()[:] == (4500 * 4499 // 2,) * 2


def test_edges_made_ready_say_what_rings_say(spark):
    import random

    from parcelflow.functions import geo

    rng = random.Random(3)
    near = lambda: round(rng.uniform(0, 4)) / 2
    ring = lambda: [(near(), near()) for _ in range(rng.randint(1, 7))]
    rows = [(near(), near(), [ring() for _ in range(rng.randint(0, 3))]) for _ in range(3000)]
    df = spark.createDataFrame(rows, "lat double, lon double, rings array<array<struct<lat: double, lon: double>>>")
    lat, lon = F.col("lat"), F.col("lon")
    got = df.select(geo.in_rings(lat, lon, F.col("rings")).alias("a"), geo.within_edges(lat, lon, geo.edges_of(F.col("rings"))).alias("b"))
    assert got.where("not a <=> b").count() == 0 and got.where("a").count() > 300


def test_pairs_of_any_key_once(spark):
    """Each pair once, though ids come again and several keys agree; a hot key is dealt out; nulls meet nothing."""
    rng = random.Random(9)
    side = lambda n: [(rng.randrange(n), rng.choice([None, 1, 2, 3]), rng.choice([None, 1, 1, 1, 2])) for _ in range(2 * n)]
    a, b = side(60), side(2500)
    l, r = spark.createDataFrame(a, "x int, p int, q int"), spark.createDataFrame(b, "y int, s int, t int")
    found = joins.join_any(l, r, [("p", "s"), ("q", "t")], "x", "y")
    got = sorted(map(tuple, found.collect()))
    assert got == sorted({(x, y) for x, p, q in a for y, s, t in b if (p is not None and p == s) or (q is not None and q == t)})
    assert found.withColumn("task", F.spark_partition_id()).groupBy("task").count().count() > 4


def test_few_names_are_asked_of_texts_without_a_shuffle(spark):
    """Few names and many take two ways to one answer; the short one makes no runs of the texts."""
    texts = spark.createDataFrame([(1, "In PERU and Perugia"), (2, ""), (3, None), (4, "ab"), (5, "Iran, iraq"), (6, "a b")], "i int, t string")
    names = spark.createDataFrame([("Peru", 1), ("perugia", 2), ("AB", 3), ("Iraq", 5), ("iran", 4), ("", 6), ("b", 8), ("B", 7)], "name string, id int")
    ways = [joins.longest_name_in(texts, F.col("t"), names, "name", "id", "i", few=n) for n in (0, 200)]
    got = [sorted((r["i"], r["id"]) for r in w.collect()) for w in ways]
    assert got[0] == got[1] == [(1, 2), (2, None), (3, None), (4, 3), (5, 4), (6, 7)]
    assert "Generate" not in ways[1]._jdf.queryExecution().optimizedPlan().toString()


def test_what_pairs_of_adverts_ask_is_asked_where_they_meet(spark):
    """Near rows of other kinds or communes are in no pair, unknown ones meet all; the shuffle has no pair that is left out."""
    rng = random.Random(4)
    rows = [(i, rng.choice(["x", "x", "y", None]), -33.4 + rng.random() * 0.004, -70.6, rng.choice(["sale", None]), rng.choice([1, None]), rng.choice([50.0, 60.0, None]), rng.choice([10.0, 20.0, None]), rng.random() < 0.8) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, commune string, lat double, lon double, operation string, bedrooms int, area double, price double, is_active boolean").withColumns({c: F.lit(None).cast("string") for c in ("phone", "agency", "address")})
    metres = lambda x, y: math.radians(abs(x[2] - y[2])) * 6_371_000
    pairs = [(x, y) for x, y in combinations(rows, 2)]
    fits = lambda t, c: c[8] and (t[6] is None or c[6] is None or abs(t[6] - c[6]) <= math.ceil(t[6] * 0.08))
    alike = sorted((x[0], y[0]) for x, y in pairs if metres(x, y) <= 150 and x[4] == y[4] and x[5] == y[5] and (fits(x, y) or fits(y, x)))
    priced = lambda x, y: x[7] is None or y[7] is None or abs(x[7] - y[7]) <= 0.3 * max(x[7], y[7])
    named = sorted((x[0], y[0]) for x, y in pairs if metres(x, y) <= 350 and priced(x, y) and (x[1] is None or y[1] is None or x[1] == y[1]))
    made = entity.near_alike(df)
    assert sorted(map(tuple, made.collect())) == alike and alike
    assert sorted(map(tuple, entity.near_or_named(df).collect())) == named and named
    # One join brings the pairs and all that they are asked; none comes after it.
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_medians_of_near_points_shuffle_no_pairs(spark):
    """Medians of crowded and lone points are those of all pairs, copies of values and nulls too, and no pair is shuffled or kept."""
    rng = random.Random(12)
    rows = [(i, -33.4 + rng.gauss(0, 0.004), -70.6 + rng.gauss(0, 0.004), rng.choice((None, 1.0, 2.0, rng.uniform(-5, 900)))) for i in range(400)]
    rows += [(400, 10.0, 10.0, 3.0), (401, None, 1.0, 2.0), (402, 60.0, 179.9999, 4.0), (403, 60.0, -179.9999, None)]
    metres = lambda a, b: 2 * 6371000.0 * math.asin(min(1.0, math.sqrt(math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2)))
    want = {}
    for a in rows:
        near = sorted(b[3] for b in rows if a[0] != b[0] and b[3] is not None and None not in (a[1], b[1]) and metres(a, b) <= 500)
        if near:
            want[a[0]] = (len(near), (near[(len(near) - 1) // 2] + near[len(near) // 2]) / 2)
    p = spark.createDataFrame(rows, "id int, lat double, lon double, price double")
    for most, bands in ((2000, 256), (20, 4)):
        df = spatial.medians_within(p, p, 500, "id", "id", "price", most=most, bands=bands)
        got = {r["id"]: (r["n"], r["median"]) for r in df.collect()}
        assert got.keys() == want.keys()
        assert all(got[k][0] == n and math.isclose(got[k][1], m, abs_tol=1e-9) for k, (n, m) in want.items())
        plan = df._jdf.queryExecution().executedPlan().toString()
        # Nothing is dealt out anew after points have met.
        assert "Exchange" not in plan[plan.index("HashAggregate") : plan.index("SortMergeJoin")]


@pytest.mark.parametrize(("name", "never"), [
    ("AGG-06_first_by", "Exchange hashpartitioning(unit#"), ("AGG-12_recent_mode", "Exchange hashpartitioning(unit#"), ("ER-16_whole_consolidation", "Exchange hashpartitioning(unit#"), ("ER-14_16_consolidated", "Exchange hashpartitioning(property#"),
    ("STM-05_delisted", "LeftAnti"), ("Q-05_cell_comparables", "NestedLoop"),
])
def test_adverts_are_dealt_out_while_narrow(spark, sf_dir, name, never):
    """Groups of a unit or a broker are made where its rows were dealt to; what a sweep saw is not joined; the newest moment cuts lines before joins."""
    assert never not in plans.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_quantiles_of_prices_are_counted_in_parts_that_follow_the_table(spark, sf_dir, monkeypatch):
    seen = []
    monkeypatch.setattr(quantiles, "quantiles", lambda df, *_: seen.append(df) or df.selectExpr("zone", "price as p25", "price as p50", "price as p75"))
    plans.queries()["AGG-04_quantiles"](spark, sf_dir)
    assert "hashpartitioning(l_extendedprice#" in seen[0]._jdf.queryExecution().executedPlan().toString()
