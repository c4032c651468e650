"""Stored pictures against the walk that takes them one by one."""

import random

import pytest
from pyspark.sql import functions as F

from parcelflow.operators import media, ring


def walk(rows, most, only_new):
    stored, out = {}, []
    for i, sha, phash in rows:
        if sha is None:
            out.append((i, None, None, None))
            continue
        if sha in stored:
            out.append((i, stored[sha][1], "exact", None))
            continue
        near = [(bin((phash ^ p) & (2**64 - 1)).count("1"), at, asset) for at, (p, asset, own) in enumerate(stored.values()) if phash is not None and p is not None and (own or not only_new)]
        near = [x for x in near if x[0] <= most]
        bits, _, asset = min(near) if near else (None, None, sha)
        stored[sha] = (phash, asset, not near)
        out.append((i, asset, "near" if near else None, bits))
    return sorted(out)


def pictures(seed, n):
    rng = random.Random(seed)
    word = lambda: rng.getrandbits(64) - 2**63
    seeds = [word() for _ in range(12)]
    flip = lambda w, k: ((w ^ sum(1 << b for b in rng.sample(range(64), k))) + 2**63) % 2**64 - 2**63
    made = []
    for i in range(n):
        if made and rng.random() < 0.3:
            _, sha, p = rng.choice(made)
        else:
            sha = f"s{rng.randrange(10**6)}" if rng.random() < 0.97 else None
            # A third has one and the same hash; others lie around seeds or around earlier ones.
            p = seeds[0] if rng.random() < 0.3 else None if rng.random() < 0.05 else flip(rng.choice(seeds + [x[2] for x in made if x[2] is not None]), rng.choice((0, 1, 2, 3, 5, 8, 9)))
        made.append((i, sha, p))
    return made


@pytest.mark.parametrize("only_new", [False, True])
def test_media_as_if_one_by_one(spark, only_new):
    rows = pictures(only_new, 400)
    df = spark.createDataFrame(rows, "i long, sha string, phash long").repartition(5)
    got = media.place(df, "sha", "phash", F.col("i"), only_new=only_new)
    assert got.columns == ["i", "sha", "phash", "asset", "reused", "bits"]
    want = walk(rows, 8, only_new)
    assert sorted((r["i"], r["asset"], r["reused"], r["bits"]) for r in got.collect()) == want
    assert {w[2] for w in want} == {None, "exact", "near"}


def test_media_of_nothing(spark):
    none = spark.createDataFrame([], "i long, sha string, phash long")
    assert media.place(none, "sha", "phash", F.col("i")).count() == media.place(none, "sha", "phash", F.col("i"), only_new=True).count() == 0


def test_long_chains_of_parents(spark):
    df = spark.range(1, 2000).selectExpr("id as node", "id - 1 as parent")
    assert media.roots(df).where("root <> 0").count() == 0


def test_longer_keys_for_more_words():
    assert ring.links_for(1000, 8) <= 3 < ring.links_for(10**8, 8)
    assert ring.links_for(1000, 2) <= ring.links_for(10**9, 2)


def test_only_what_asks_lists_keys(spark):
    rng = random.Random(3)
    words = list({rng.getrandbits(63) for _ in range(300)})
    words += [w ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(1, 10))) for w in words[:200]]
    asking = words[::7]
    side = lambda some: spark.createDataFrame([(w,) for w in some], "fp long")
    for most in (1, 2, 4, 8):
        got = sorted((r["a"], r["b"], r["bits"]) for r in ring.close_to(side(asking), side(words), most).collect())
        assert got == sorted((a, b, bin(a ^ b).count("1")) for a in asking for b in words if 0 < bin(a ^ b).count("1") <= most)


def test_keys_get_longer_where_hashes_are_alike(spark):
    rng = random.Random(5)
    side = lambda some: spark.createDataFrame([(w,) for w in some], "fp long")
    spread, alike = [rng.getrandbits(63) for _ in range(2000)], [sum(1 << 4 * i for i in range(15) if rng.random() < 0.5) for _ in range(2000)]
    of = lambda words: ring.links_between(side(words[:500]), side(words), ring.Ring(8))
    assert of(alike) > of(spread)
