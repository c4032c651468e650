"""SimHash near-duplicates found by pigeonring filtering."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ring
from ..operators.graph import connected_components
from .common import fresh, salted_join, stored, table

BITS = 64
WORDS = 4
SEED = 42
MOST_BITS = 4


def _fingerprint(text: str | None) -> int:
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(WORDS)), strict=False)) if len(w) >= WORDS else [b" ".join(w)]
    of = xxhash.xxh64_intdigest
    hashes = np.fromiter((of(x, SEED) for x in shingles), dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: Column) -> Column:
    """64-bit SimHash: a bit is set if over half the shingles' XXH64 have it; 0 for a text without words."""

    @F.pandas_udf("bigint")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(_fingerprint).astype("int64")

    return of(F.coalesce(text, F.lit("")))


def close_fingerprints(prints: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """Links (a, b) between different values of the column ``fp``, which has each value once, with the components of all pairs within ``most_bits``."""
    return ring.close_links(prints, most_bits)


def _components(docs: DataFrame, id_col: str, text_col: str, most_bits: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of all rows, and (fp, named) of all values; ``named`` is the value of the component that has the smallest id."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), fingerprint(F.col(f"`{text_col}`")).alias("fp"))
    prints = stored(rows, "fingerprints")
    # A value's name orders by its smallest id, if it has any; so a component is named by its smallest id at once.
    name = lambda fp, first: F.struct(first.isNull().alias("none"), first.alias("id"), fp.alias("fp"))
    values = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")).select("fp", name(F.col("fp"), F.col("first")).alias("own")), "values")
    links = close_fingerprints(values.select("fp"), most_bits)
    side = lambda c: values.select(F.col("fp").alias(c), F.col("own").alias(f"{c}_own"))
    parts = connected_components(links.join(side("a"), "a").join(side("b"), "b"), "a_own", "b_own")
    named = values.join(parts, values["own"] == parts["node"], "left").select("fp", F.coalesce("component", "own").alias("named"))
    return prints, stored(named, "components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, fp and component_id of every row of ``docs``.

    component_id is the smallest id among the rows that links of at most
    ``most_bits`` differing bits reach. Equal texts share a fingerprint and
    meet as one value; fingerprints of very many rows are dealt out where
    rows get their component. Null and empty texts have fingerprint 0. Rows
    with a null id are linked like any other but never name a component,
    unless all its ids are null; repeated rows stay. Other columns of
    ``docs`` are left out. Very long texts are read whole, their shingles in
    slices. An empty table gives no rows.
    """
    prints, named = _components(docs, id_col, text_col, most_bits)
    return salted_join(prints, named, "fp").select("doc_id", "fp", F.col("named.id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MOST_BITS) -> DataFrame:
    """One row of ``docs`` of each component, with its own columns: one with the smallest id.

    Of several such rows with equal fingerprints one stays. Components
    without any id keep a row of their smallest fingerprint. Rows that share
    an id but are not linked are told apart by their fingerprints. Columns
    of any name stay as they are; very long texts are read whole; an empty
    table gives an empty one.
    """
    prints, named = _components(docs, id_col, text_col, most_bits)
    chosen = stored(named.select("named.*").distinct(), "kept")
    ids = chosen.where("not none").select("id", "fp")
    # Ids of several rows, or of none, say too little: their rows are chosen by the fingerprint too.
    several = prints.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and doc_id is not null").select("doc_id")
    several = stored(several.join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi"), "several")
    alone = stored(ids.join(several, F.col("id") == F.col("doc_id"), "left_anti").select("id"), "kept-ids")
    key, fp = fresh(docs, "_kept"), fresh(docs, "_fp")
    id_of = F.col(f"`{id_col}`").cast("long")
    # Ids grow with the documents: they are dealt out, not broadcast, at every size; the hash side holds ids only, and texts aren't sorted.
    kept = docs.join(alone.withColumnRenamed("id", key).hint("shuffle_hash"), id_of == F.col(key), "left_semi")
    parts = [kept]
    for rows, some in ((docs.join(several.withColumnRenamed("doc_id", key), id_of == F.col(key), "left_semi"), several), (docs.where(id_of.isNull()), chosen.where("none"))):
        if not some.isEmpty():
            printed = rows.withColumn(fp, fingerprint(F.col(f"`{text_col}`")))
            wanted = chosen.select(F.col("id").alias(key), F.col("fp").alias(f"{fp}_wanted"))
            found = printed.join(wanted, id_of.eqNullSafe(F.col(key)) & (F.col(fp) == F.col(f"{fp}_wanted")), "left_semi")
            parts.append(found.dropDuplicates([id_col, fp]).select(*(F.col(f"`{c}`") for c in docs.columns)))
    return reduce(DataFrame.unionByName, parts)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op3_simhash_near_dedup": op3_simhash_near_dedup}
SQL: dict[str, str] = {}
