"""Stored pictures: equal content is stored once, near content shares the place of what came before."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ring
from .storage import Rounds, stored

#: Bits that the hashes of one picture may differ in.
NEAR_BITS = 8


def _levels(most: int) -> list[int]:
    """Distances that are searched in turn; what has found something near goes no further."""
    return sorted({min(1, most), min(2, most), min(4, most), most} - {0})


def nearest_before(values: DataFrame, most: int = NEAR_BITS) -> DataFrame:
    """(phash, parent, bits) of each row of (phash, at) that has an earlier one within ``most`` bits: the nearest, of these the earliest.

    Each hash is there once. Small distances come first, where keys are long
    and few words meet; only what found nothing asks for the next distance,
    and only what asks lists the keys that a close one may have.
    """
    found, asking = [], values
    for most_bits in _levels(most):
        words = lambda df: df.select(F.col("phash").alias("fp"))
        pairs = ring.close_to(words(asking), words(values), most_bits).toDF("phash", "parent", "bits")
        side = values.select(F.col("phash").alias("parent"), F.col("at").alias("before"))
        met = pairs.join(asking, "phash").join(side, "parent").where(F.col("before") < F.col("at"))
        best = stored(met.groupBy("phash").agg(F.min(F.struct("bits", "before", "parent")).alias("best")).select("phash", "best.parent", "best.bits"), "nearest")
        found.append(best)
        asking = stored(asking.join(best, "phash", "left_anti"), "asking")
    return reduce(DataFrame.union, found)


def roots(parents: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """(node, root) of each row of a forest: every round doubles the way that a node has looked up."""
    rounds = Rounds(parents.sparkSession, "roots")
    now = rounds.put(parents.select(F.col(node).alias("node"), F.col(parent).alias("root"), F.lit(True).alias("moved")))
    while not now.where("moved").isEmpty():
        up = now.select(F.col("node").alias("root"), F.col("root").alias("above"))
        now = rounds.put(now.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
    return now.select("node", "root")


def representatives(values: DataFrame, most: int = NEAR_BITS) -> DataFrame:
    """Rows of (phash, at) that have no earlier representative within ``most`` bits, as a walk in order of arrival elects them.

    In rounds: what has no undecided earlier neighbour is elected, what is
    near an elected one is settled; with arrivals in any order the rounds
    grow with the logarithm of the rows.
    """
    pairs = ring.close_pairs(values.select(F.col("phash").alias("fp")), most)
    at = lambda c: values.select(F.col("phash").alias(c), F.col("at").alias(f"{c}_at"))
    timed = pairs.join(at("a"), "a").join(at("b"), "b")
    # (later, earlier): who waits for whom.
    first = F.col("a_at") < F.col("b_at")
    waits = stored(timed.select(F.when(first, F.col("b")).otherwise(F.col("a")).alias("later"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("earlier")), "waits")
    elected = [stored(values.select("phash").join(waits.select(F.col("later").alias("phash")), "phash", "left_anti"), "elected")]
    rounds = Rounds(values.sparkSession, "waits")
    new = elected[0]
    while True:
        settled = stored(waits.join(new.withColumnRenamed("phash", "earlier"), "earlier", "left_semi").select("later").distinct(), "settled")
        # Settled ones are out, and nobody waits for them any more.
        left = waits.join(settled, "later", "left_anti").join(new.withColumnRenamed("phash", "later"), "later", "left_anti")
        free = stored(left.join(settled.withColumnRenamed("later", "earlier"), "earlier", "left_semi").select(F.col("later").alias("phash")).distinct(), "free")
        still = rounds.put(left.join(settled.withColumnRenamed("later", "earlier"), "earlier", "left_anti"))
        # Those whose last wait went are elected; those who still wait go on.
        new = stored(free.join(still.select(F.col("later").alias("phash")), "phash", "left_anti"), "elected")
        if new.isEmpty():
            break
        elected.append(new)
        waits = still
    return values.join(reduce(DataFrame.union, elected), "phash", "left_semi")


def place(pictures: DataFrame, sha: str, phash: str, at: Column, most: int = NEAR_BITS, only_new: bool = False) -> DataFrame:
    """``pictures`` with ``asset`` (content that is stored in their place), ``reused`` (exact, near, or null for new) and ``bits``.

    As if rows came one by one in the order of ``at`` (no two alike): content
    that is there already is reused; else the place of the nearest earlier
    content by ``phash``, within ``most`` bits, which may itself have another's; else the row's
    content is stored. With ``only_new`` content compares with stored content
    alone. Of equally near ones the earliest counts. A null hash is near nothing; rows without content
    (null ``sha``) have no asset.

    Content is compared by different hashes, each once: a hash that many
    pictures share is one row. Nothing is collected.
    """
    rows = pictures.withColumn("_at", at)
    assets = stored(rows.where(F.col(sha).isNotNull()).groupBy(F.col(sha).alias("sha")).agg(F.min("_at").alias("at"), F.min_by(F.col(phash), F.col("_at")).alias("phash")), "assets")
    heads = stored(assets.where("phash is not null").groupBy("phash").agg(F.min("at").alias("at"), F.min_by("sha", "at").alias("head")), "heads")
    values = heads.select("phash", "at")
    if only_new:
        stored_ones = stored(representatives(values, most), "stored-values")
        near = _nearest_of(values, stored_ones, most)
        top = near.select(F.col("phash").alias("node"), F.col("parent").alias("root"))
    else:
        near = stored(nearest_before(values, most), "parents")
        top = roots(near, "phash", "parent")
    named = heads.join(near.select("phash", "bits"), "phash", "left").join(top.withColumnRenamed("node", "phash"), "phash", "left")
    of_root = heads.select(F.col("phash").alias("root"), F.col("head").alias("asset"))
    # Of each hash: its first content, where that lies, and how far it is from what it was found by.
    by_hash = named.join(of_root, "root", "left").select("phash", "head", F.coalesce("asset", "head").alias("asset"), "bits")
    # Other content of one hash lies at no distance from its first content, if that is what it compares with.
    bits = F.when(F.col("sha") == F.coalesce("head", "sha"), F.col("bits")).otherwise(F.coalesce(F.col("bits"), F.lit(0)) if only_new else F.lit(0))
    of_sha = assets.join(by_hash, "phash", "left").select("sha", F.col("at").alias("_first"), F.coalesce("asset", "sha").alias("asset"), bits.alias("bits"))
    first = F.col("_at") == F.col("_first")
    kind = F.when(~first, "exact").when(F.col("bits").isNotNull(), "near")
    found = rows.join(of_sha.withColumnRenamed("sha", "_sha"), F.col(sha) == F.col("_sha"), "left")
    return found.select(*(F.col(f"`{c}`") for c in pictures.columns), "asset", kind.alias("reused"), F.when(first, F.col("bits")).alias("bits"))


def _nearest_of(values: DataFrame, chosen: DataFrame, most: int) -> DataFrame:
    """(phash, parent, bits) of what is not ``chosen``: the nearest earlier chosen hash, of these the earliest."""
    pairs = ring.close_pairs(values.select(F.col("phash").alias("fp")), most)
    both = pairs.select("a", "b", "bits").union(pairs.select("b", "a", "bits")).toDF("phash", "parent", "bits")
    met = both.join(chosen.select(F.col("phash").alias("parent"), F.col("at").alias("before")), "parent").join(values, "phash").where(F.col("before") < F.col("at"))
    best = met.groupBy("phash").agg(F.min(F.struct("bits", "before", "parent")).alias("best")).select("phash", "best.parent", "best.bits")
    return stored(best.join(chosen.select("phash"), "phash", "left_anti"), "nearest")
