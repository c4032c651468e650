"""Pairs of 64-bit hashes within a Hamming distance, by pigeonring filtering.

A word's bits are a ring of segments. If two words differ in at most ``most``
bits then, from some segment on, every chain of the next l segments differs in
at most ``l * most / segments`` of them: the whole budget is shared out in
proportion, and a ring that exceeded it from every start would exceed it in
all. So the first segment of such a chain is equal, the second differs in one
or two bits, and so on. Words meet in a join on the start and its first
segments, for which one side lists all values within the chain's budget; what
meets has to pass the rest of the chain before its bits are counted.
"""

from __future__ import annotations

import json
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored

BITS = 64
#: A key with more words gets one segment more; with that too, its words meet at common neighbours.
CROWDED = 256


def signed(x: int) -> int:
    x %= 1 << BITS
    return x - (1 << BITS) if x >> (BITS - 1) else x


class Ring:
    """Segments and budgets for words that differ in at most ``most`` bits; the budget is below one a segment."""

    def __init__(self, most: int, segments: int | None = None):
        self.most, self.segments = most, segments or most + 1
        if self.most >= self.segments:
            raise ValueError("more segments than bits that differ are needed")
        cuts = [i * BITS // self.segments for i in range(self.segments + 1)]
        self.bits = [range(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.masks = [sum(1 << b for b in bits) for bits in self.bits]

    def budget(self, n: int) -> int:
        return n * self.most // self.segments

    def key_mask(self, start: int, links: int) -> int:
        return signed(sum(self.masks[(start + k) % self.segments] for k in range(links)))

    def flips(self, start: int, links: int) -> list[int]:
        """All differences in the first ``links`` segments from ``start`` that every chain's budget allows."""
        found = [(0, 0)]
        for n in range(1, links + 1):
            bits = self.bits[(start + n - 1) % self.segments]
            more = []
            for flip, used in found:
                for k in range(self.budget(n) - used + 1):
                    more += [(flip | sum(1 << b for b in some), used + k) for some in combinations(bits, k)]
            found = more
        return [signed(f) for f, _ in found]

    def first_start(self, x: Column, longest: int | None = None) -> Column:
        """The first start from which the differing bits ``x`` keep within the budgets of chains of up to ``longest`` segments; null if none."""
        d = [F.bit_count(x.bitwiseAND(F.lit(signed(m)))) for m in self.masks]

        def fits(i: int) -> Column:
            sums = [reduce(lambda a, b: a + b, (d[(i + k) % self.segments] for k in range(n))) for n in range(1, (longest or self.segments - 1) + 1)]
            return reduce(lambda a, b: a & b, (s <= self.budget(n) for n, s in enumerate(sums, 1)))

        return F.coalesce(*(F.when(fits(i), F.lit(i)) for i in range(self.segments)))


def _keys(words: DataFrame, ring: Ring, links: int, listed: bool) -> DataFrame:
    """(start, key, fp): each word under its own keys, or under all that a close word may have."""
    # One literal that is folded once: hundreds of literal columns would take seconds to plan.
    ways = [{"start": i, "flip": f, "mask": ring.key_mask(i, links)} for i in range(ring.segments) for f in (ring.flips(i, links) if listed else [0])]
    each = words.select("fp", F.explode(F.from_json(F.lit(json.dumps(ways)), "array<struct<start:int,flip:bigint,mask:bigint>>")).alias("w"))
    return each.select(F.col("w.start").alias("start"), F.col("fp").bitwiseXOR(F.col("w.flip")).bitwiseAND(F.col("w.mask")).alias("key"), "fp")


def _met(words: DataFrame, ring: Ring, links: int, crowded: int) -> tuple[DataFrame, DataFrame | None]:
    """(candidates (start, a, b) of keys that are not crowded, words of crowded keys or None)."""
    own, listed = _keys(words, ring, links, False), _keys(words, ring, links, True)
    full = stored(own.groupBy("start", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowded).select("start", "key"), "crowded")
    rest = None
    if not full.isEmpty():
        rest = stored(own.join(full, ["start", "key"], "left_semi").select("fp").union(listed.join(full, ["start", "key"], "left_semi").select("fp")).distinct(), "crowded-words")
        own = own.join(full, ["start", "key"], "left_anti")
    a, b = listed.withColumnRenamed("fp", "a"), own.withColumnRenamed("fp", "b")
    return a.join(b, ["start", "key"]).where("a < b"), rest


def candidates(words: DataFrame, most: int, segments: int | None = None, links: int = 2) -> DataFrame:
    """(start, a, b), a < b, of words that agree in the first ``links`` segments from a start, as far as the budget asks."""
    return _met(words, Ring(most, segments), links, 1 << 62)[0]


def close_links(words: DataFrame, most: int, segments: int | None = None, links: int = 2, crowded: int = CROWDED) -> DataFrame:
    """Links (a, b), a < b, between words of the column ``fp`` (each once) that differ in at most ``most`` bits.

    The links have the same components as all such pairs, and are all of
    them where no key is crowded. Keys that more than ``crowded`` words
    share are left, and the words around them meet again under keys of one
    segment more. Those around keys that are crowded even then lie as close
    together as no list of pairs should have them: they meet at common
    neighbours (``through_neighbours``). None is left out.
    """
    ring = Ring(most, segments)
    near = lambda met: met.where((ring.first_start(F.col("a").bitwiseXOR(F.col("b"))) == F.col("start")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most)).select("a", "b")
    met, rest = _met(words, ring, links, crowded)
    out = near(met)
    if rest is not None:
        met, dense = _met(rest, ring, links + 1, crowded)
        out = out.unionByName(near(met))
        if dense is not None:
            out = out.unionByName(through_neighbours(dense, most))
        out = out.distinct()
    return out


def links_for(n: int, most: int, segments: int | None = None) -> int:
    """How many segments the keys of ``n`` words should have: as many as make listed keys and chance meetings together the fewest."""
    ring = Ring(most, segments)

    def rows(links: int) -> float:
        # Of the first segments the flips are listed; of random words a share of two to the power of their bits meets.
        ways = [(len(ring.flips(i, links)), sum(len(ring.bits[(i + k) % ring.segments]) for k in range(links))) for i in range(ring.segments)]
        return sum(n * flips + n * n * flips / 2**bits for flips, bits in ways)

    return min(range(1, min(4, ring.segments - 1) + 1), key=rows) if ring.segments > 1 else 1


def close_pairs(words: DataFrame, most: int, segments: int | None = None, links: int | None = None) -> DataFrame:
    """(a, b, bits), a < b, of all pairs of words within ``most`` bits, where each pair is wanted; keys get longer with the number of words."""
    ring = Ring(most, segments)
    links = links or links_for(words.count(), most, segments)
    x = F.col("a").bitwiseXOR(F.col("b"))
    return candidates(words, most, segments, links).where((ring.first_start(x) == F.col("start")) & (F.bit_count(x) <= most)).select("a", "b", F.bit_count(x).alias("bits"))


def links_between(asking: DataFrame, words: DataFrame, ring: Ring) -> int:
    """How many segments the keys should have, by the words that do share them: hashes of like pictures are far from random."""
    most = min(4, ring.segments - 1)
    if most < 2:
        return 1
    ways = [{"links": n, "start": i, "mask": ring.key_mask(i, n), "flips": len(ring.flips(i, n))} for n in range(1, most + 1) for i in range(ring.segments)]
    each = F.explode(F.from_json(F.lit(json.dumps(ways)), "array<struct<links:int,start:int,mask:bigint,flips:bigint>>")).alias("w")
    both = words.select("fp", F.lit(0).alias("asks"), F.lit(1).alias("is")).union(asking.select("fp", F.lit(1), F.lit(0)))
    held = both.select(each, "fp", "asks", "is").groupBy("w.links", "w.start", "w.flips", F.col("fp").bitwiseAND(F.col("w.mask"))).agg(F.sum("asks").alias("a"), F.sum("is").alias("n"))
    rows = {r["links"]: r for r in held.groupBy("links").agg(F.sum(F.col("flips") * F.col("a")).alias("keys"), F.sum(F.col("flips") * F.col("a") * F.col("n")).cast("double").alias("met")).collect()}
    # What meets on a longer key meets on the shorter one too. Longer keys pay while there
    # are fewer of them than meetings to save; one is shuffled and sorted, as costly as several meetings.
    links, met = 1, rows[1]["met"] if rows else 0
    while links < most and rows and 5 * rows[links + 1]["keys"] < met:
        links += 1
        met = min(met, rows[links]["met"])
    return links


def close_to(asking: DataFrame, words: DataFrame, most: int, segments: int | None = None) -> DataFrame:
    """(a, b, bits) of each word a of ``asking`` and all other ``words`` b within ``most`` bits of it; only those that ask list keys."""
    ring = Ring(most, segments)
    links = links_between(asking, words, ring)
    x = F.col("a").bitwiseXOR(F.col("b"))
    # Merged: a broadcast would go by the size of what asks, not by that of the keys it lists.
    met = _keys(asking, ring, links, True).withColumnRenamed("fp", "a").hint("merge").join(_keys(words, ring, links, False).withColumnRenamed("fp", "b"), ["start", "key"])
    return met.where((F.col("a") != F.col("b")) & (F.bit_count(x) <= most) & (ring.first_start(x) == F.col("start"))).select("a", "b", F.bit_count(x).alias("bits"))


def through_neighbours(words: DataFrame, most: int) -> DataFrame:
    """Links with the components of all pairs within ``most`` bits (2 or 4), and no pair listed.

    Two words are that close if a third one, in the data or not, is within
    half of it from both. Each word visits all such neighbours (2081 for 4
    bits) and links to the smallest word that visits them.
    """
    if most not in (2, 4):
        raise ValueError("crowded words need a distance of 2 or 4")
    flips = "transform(sequence(0, 63), i -> shiftleft(1L, i))" if most == 2 else "flatten(transform(sequence(0, 63), i -> transform(sequence(i, 63), j -> shiftleft(1L, i) | shiftleft(1L, j))))"
    visits = words.select("fp", F.explode(F.expr(f"transform(concat(array(0L), {flips}), m -> fp ^ m)")).alias("at"))
    least = visits.groupBy("at").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z").select("at", "a")
    return visits.join(least, "at").where("a < fp").select("a", F.col("fp").alias("b")).distinct()
