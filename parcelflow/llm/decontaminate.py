"""Benchmark items inside documents, by size-partitioned MinHash containment search."""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from collections.abc import Iterable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rounds, fresh, stored, table

WORDS = 5
#: Percent of an item's shingles that a document has to contain.
PERCENT = 80
#: Characters of different items whose index is broadcast at once (some 80 MB); more items come in several blocks.
BLOCK_CHARS = 32_000_000

_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ORDER = np.uint64(0xC2B2AE3D27D4EB4F)
_FILTER_BITS = 20
_MOST_KNOWN = 400_000
_MATCH = "array<struct<tid:string,n_shingles:bigint,n_shared:bigint>>"


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits."""
    return _WORD.findall((text or "").lower())


def _hashes(words: list[str], known: dict[str, int]) -> np.ndarray:
    import xxhash

    try:
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    except KeyError:
        if len(known) > _MOST_KNOWN:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 7)
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words."""
    out = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        out = out * _BASE + h[i : len(h) - k + 1 + i]
    return out ^ (out >> np.uint64(31))


class Index:
    """MinHash sketches of texts, partitioned by the number of their shingles.

    A class holds sizes from a power of two to the next. A document that
    contains a text lacks at most the share of shingles that the largest
    size of the class allows; so one of that many and one more, here those
    with the smallest hashes, is in the document. These sketches are all that
    a document's shingles are looked up in. They are arrays of numbers, some
    12 bytes a shingle of a sketch, beside the texts themselves; the shingles
    of a text are made again where a document may contain it.
    """

    def __init__(self, texts: Iterable[str | None], percent: int = PERCENT, k: int = WORDS):
        self.percent, self.k, self.known = percent, k, {}
        self.texts, self.sizes, self.counts = [], array("b"), array("q")
        classes: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for text in texts:
            w = words_of(text)
            size = min(k, len(w))
            if size:
                n = len(set(zip(*(w[j:] for j in range(size)), strict=False)))
                classes[n.bit_length()].append((len(self.texts), np.unique(_grams(_hashes(w, self.known), size))))
                self.texts.append(text)
                self.sizes.append(size)
                self.counts.append(n)
        self.known = {}
        probes: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
        for members in classes.values():
            largest = max(self.counts[i] for i, _ in members)
            missing = largest - self._least(largest)
            for i, hashes in members:
                probes[self.sizes[i]].append((hashes[np.argsort(hashes * _ORDER)][: missing + 1], i))
        self.tables = {}
        for size, some in probes.items():
            hashes = np.concatenate([h for h, _ in some])
            owners = np.repeat(np.array([i for _, i in some], dtype=np.int32), [len(h) for h, _ in some])
            order = np.argsort(hashes, kind="stable")
            seen = np.zeros(1 << _FILTER_BITS, dtype=bool)
            seen[hashes >> np.uint64(64 - _FILTER_BITS)] = True
            self.tables[size] = (hashes[order], owners[order], seen)

    def _least(self, n: int) -> int:
        return -(-self.percent * n // 100)

    def matches(self, text: str | None) -> list[tuple[int, int, int]]:
        """(place among ``texts``, its shingles, shingles of them in ``text``) of each that ``text`` contains."""
        w = words_of(text)
        if not w or not self.tables:
            return []
        h = _hashes(w, self.known)
        found: set[int] = set()
        for size, (hashes, owners, seen) in self.tables.items():
            if len(w) < size:
                continue
            grams = _grams(h, size)
            grams = np.unique(grams[seen[grams >> np.uint64(64 - _FILTER_BITS)]])
            low, high = np.searchsorted(hashes, grams, "left"), np.searchsorted(hashes, grams, "right")
            for a, b in zip(low[low < high], high[low < high], strict=True):
                found.update(owners[a:b].tolist())
        out, exact = [], {}
        for i in sorted(found):
            size = self.sizes[i]
            if size not in exact:
                exact[size] = set(zip(*(w[j:] for j in range(size)), strict=False))
            own = words_of(self.texts[i])
            shared = len(set(zip(*(own[j:] for j in range(size)), strict=False)) & exact[size])
            if shared * 100 >= self.percent * self.counts[i]:
                out.append((i, self.counts[i], shared))
        return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int) -> tuple[DataFrame, int]:
    """(item_id, text, tid, block) of the items with a text, and the number of blocks: equal texts have one tid and one block."""
    items = benchmark.select(F.col(f"`{id_col}`").cast("bigint").alias("item_id"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    tid = F.sha2("text", 256)
    items = stored(items.select("item_id", "text", tid.alias("tid")), "items")
    chars = items.select("tid", F.length("text").alias("n")).distinct().agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n = chars // block_chars + 1
    return items.withColumn("block", F.pmod(F.xxhash64("tid"), F.lit(n))), n


def _asked(spark: SparkSession, items: DataFrame, block: int, text: Column, percent: int) -> Column:
    """Array of (tid, n_shingles, n_shared) of the block's texts that ``text`` contains."""
    rows = sorted(items.where(F.col("block") == block).select("tid", "text").distinct().collect())
    tids = np.array([r["tid"] for r in rows if words_of(r["text"])], dtype="S64")
    held = spark.sparkContext.broadcast((tids, Index((r["text"] for r in rows), percent)))

    @F.pandas_udf(_MATCH)
    def ask(texts: pd.Series) -> pd.Series:
        names, index = held.value
        return pd.Series([[{"tid": names[i].decode(), "n_shingles": n, "n_shared": s} for i, n, s in index.matches(t)] for t in texts], dtype=object)

    return ask(F.coalesce(text, F.lit("")))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared, containment of each document and benchmark item in it.

    Shingles are five words of letters and digits, lower-cased; an item of
    fewer words is one shingle and has to occur as it is. Null, empty and
    wordless texts and items contain and match nothing; repeated rows of
    either side give repeated rows. Other columns are left out; an empty
    table on either side gives no rows. Very long texts are asked whole, in time that grows with their length. Items come in blocks of about
    ``block_chars`` characters of different texts: the index of one is
    broadcast and asked with all texts, and its answer is a table before the
    next block comes, so one index is held at a time.
    """
    spark = docs.sparkSession
    items, n = _blocks(benchmark, id_col="item_id", text_col="text", block_chars=block_chars)
    parts = []
    for b in range(n):
        found = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.explode(_asked(spark, items, b, F.col(f"`{text_col}`"), percent)).alias("x")).select("doc_id", "x.*")
        parts.append(found if n == 1 else stored(found, "matches"))
    found = reduce(DataFrame.unionByName, parts)
    return found.join(items.select("tid", "item_id"), "tid").select("doc_id", "item_id", "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", percent: int = PERCENT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item, with their own columns, whatever their names.

    Null, empty and wordless texts contain nothing and stay; repeated rows
    stay or go together; very long texts are asked whole; an empty benchmark takes nothing, an empty table stays empty. Of several blocks
    of items each is asked with what those before it left, of which one
    table is kept at a time.
    """
    rounds = Rounds(docs.sparkSession, "clean")
    items, n = _blocks(benchmark, id_col="item_id", text_col="text", block_chars=block_chars)
    for b in range(n):
        col = fresh(docs, "_items")
        found = docs.withColumn(col, _asked(docs.sparkSession, items, b, F.col(f"`{text_col}`"), percent))
        docs = found.where(F.size(F.col(f"`{col}`")) == 0).drop(col)
        if b < n - 1:
            docs = rounds.put(docs)
    return docs


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op8_benchmark_decontamination": op8_benchmark_decontamination}
#: Item shingles that occur in documents, counted by equality.
OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT row_number() OVER () AS bid, item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
bs AS (SELECT DISTINCT bid, item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM b),
ds AS (SELECT DISTINCT rid, doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM d),
n AS (SELECT bid, count(*) AS n_shingles FROM bs GROUP BY bid),
s AS (SELECT rid, doc_id, bid, item_id, count(*) AS n_shared FROM ds JOIN bs USING (g) GROUP BY ALL)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment FROM s JOIN n USING (bid) WHERE n_shared * 100 >= 80 * n_shingles"""
SQL = {"op8_benchmark_decontamination": OP8_SQL}
