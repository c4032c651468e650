"""Best-fit packing of documents into fixed token sequences, after Martello-Toth reduction.

Only the number of pieces of each length matters for a packing, so it is
found over that histogram, which has at most ``capacity`` rows however many
documents there are. Documents meet their places through the rank that they
have among the pieces of their length.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table
from .tokens import encoded, vocabulary_path

CAPACITY = 2048


@dataclass
class Plan:
    """Runs of pieces of one length: the ``n`` from rank ``low`` on go to sequences from ``base`` on, ``each`` a sequence, the first of these at ``offset``."""

    capacity: int
    rows: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0
    reduced: int = 0

    def arrays(self) -> dict[str, np.ndarray]:
        got = np.asarray(sorted(self.rows), dtype=np.int64).reshape(-1, 6)
        return dict(zip(("length", "low", "n", "base", "each", "offset"), got.T, strict=True))


def _least(pieces: list[tuple[int, int]], k: int) -> float:
    """The least total of ``k`` of the pieces (length, number), by ascending length; infinite if there are fewer."""
    total, more = 0, k
    for x, n in pieces:
        use = min(more, n)
        total, more = total + use * x, more - use
        if not more:
            return total
    return math.inf


def _best_two(pieces: list[tuple[int, int]], room: int) -> int:
    """The longest total of two of the pieces that fits into ``room``; 0 if none does."""
    low, high, best = 0, len(pieces) - 1, 0
    while low <= high:
        total = pieces[low][0] + pieces[high][0]
        if total > room or low == high and pieces[low][1] < 2:
            high -= 1
        else:
            best = max(best, total)
            low += 1
    return best


class _Packer:
    def __init__(self, counts: dict[int, int], capacity: int):
        self.plan = Plan(capacity)
        self.capacity = capacity
        self.left = [0] * (capacity + 1)
        for length, n in counts.items():
            if not 1 <= length <= capacity:
                raise ValueError(f"length {length} is not in 1..{capacity}")
            self.left[length] = n
        self.taken = [0] * (capacity + 1)
        self.open: dict[int, list[tuple[int, int]]] = {}

    def put(self, length: int, n: int, base: int, each: int, offset: int) -> None:
        self.plan.rows.append((length, self.taken[length], n, base, each, offset))
        self.taken[length] += n
        self.left[length] -= n

    def new(self, n: int) -> int:
        base, self.plan.sequences = self.plan.sequences, self.plan.sequences + n
        return base

    def reduce(self) -> None:
        """Fixes sets of one to three pieces that dominate every other set with their largest piece.

        A set dominates another if the other's pieces can be dealt to its own
        so that none gets more than its length; exchanging them then never
        needs more sequences. Of the piece and the longest other that fits
        (its partner) that holds

        - for the piece alone if nothing else fits to it;
        - for the two if they fill the sequence, or if one more piece fits at
          most, or two at most and the partner is as long as any such two;
        - for the two and a third that fills the sequence, if two more
          pieces fit at most and no two that are shorter than the partner
          and longer than the third fit together, unless into the partner's place.
        """
        for length in range(self.capacity, 0, -1):
            while self.left[length] and (found := self._dominating(length)):
                uses = Counter(found)
                n = min(self.left[x] // k for x, k in uses.items())
                base, offset = self.new(n), 0
                for x, k in uses.items():
                    self.put(x, k * n, base, k, offset)
                    offset += k * x
                self.plan.reduced += len(found) * n

    def _dominating(self, length: int) -> list[int] | None:
        """A set with a piece of ``length`` that dominates all others, if one of up to three pieces is known to."""
        room = self.capacity - length
        others = [(x, n) for x in range(1, min(room, self.capacity) + 1) if (n := self.left[x] - (x == length)) > 0]
        if not others:
            return [length]
        partner = others[-1][0]
        if partner == room or _least(others, 2) > room:
            return [length, partner]
        if _least(others, 3) <= room:
            return None
        if partner >= _best_two(others, room):
            return [length, partner]
        third = room - partner
        n_third = self.left[third] - (third == length) - (third == partner) if third else 0
        between = [(x, n) for x, n in others if third < x < partner]
        # Two pieces between them would have to fit together, and not into the partner's place.
        if n_third > 0 and (not between or _best_two(between, room) <= partner):
            return [length, partner, third]
        return None

    def best_fit(self) -> None:
        """Longest pieces first, each to the open sequence with the least room that takes it."""
        capacity = self.capacity
        for length in range(capacity, 0, -1):
            room = length
            while self.left[length]:
                while room <= capacity and not self.open.get(room):
                    room += 1
                if room > capacity:
                    room, fits = capacity, capacity // length
                    base, n = self.new(-(-self.left[length] // fits)), -(-self.left[length] // fits)
                else:
                    fits = room // length
                    base, n = self.open[room].pop()
                whole = min(n, self.left[length] // fits)
                if whole:
                    self.put(length, whole * fits, base, fits, capacity - room)
                    self._more(room - fits * length, base + 0, whole)
                if whole < n and self.left[length]:
                    some = self.left[length]
                    if some < fits:
                        self.put(length, some, base + whole, some, capacity - room)
                        self._more(room - some * length, base + whole, 1)
                        whole += 1
                if whole < n:
                    self._more(room, base + whole, n - whole)
                room = length

    def _more(self, room: int, base: int, n: int) -> None:
        if room:
            self.open.setdefault(room, []).append((base, n))


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Where the pieces of each length go, from their numbers."""
    packer = _Packer(counts, capacity)
    packer.reduce()
    packer.best_fit()
    return packer.plan


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, and its rank among the pieces of its length in its shard.

    A document of more than ``capacity`` ids is cut into pieces of
    ``capacity``; what is over comes first.
    """
    vocabulary = vocabulary or vocabulary_path()
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, ranks, out = TaskContext.get().partitionId(), [0] * (capacity + 1), []
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "shard", "rank"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
        for doc, ids in encoded(batches, vocabulary):
            n = len(ids) // 4
            starts = [0, *range(n % capacity or capacity, n, capacity)]
            for piece, (a, b) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                out.append((doc, piece, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), shard, ranks[b - a]))
                ranks[b - a] += 1
            if len(out) >= 4096:
                yield batch()
                out = []
        if out:
            yield batch()

    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, shard int, rank long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """One row a piece with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row of ``docs`` is packed, repeated ones and null ids too; a null
    or empty text is its end id alone; a very long one is encoded whole and cut. Other columns of ``docs`` are left
    out. An empty table gives no rows. The histogram of lengths (at most
    ``capacity`` rows) and the plan over it are all that the driver sees or
    broadcasts; pieces meet the ranks of their shard in a shuffled join, as
    the table of these grows with the shards.
    """
    cut = stored(pieces(docs, id_col, text_col, capacity, vocabulary), "pieces")
    by_shard = stored(cut.groupBy("shard", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in by_shard.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = plan_packing(counts, capacity).arrays()
    before, total = {}, 0
    for length in sorted(counts):
        before[length], total = total, total + counts[length]
    low = np.asarray([before[x] for x in plan["length"]], dtype=np.int64) + plan["low"]
    held = docs.sparkSession.sparkContext.broadcast((plan, low, np.asarray([before.get(x, 0) for x in range(capacity + 1)], dtype=np.int64)))
    first = by_shard.withColumn("below", F.sum("n").over(Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))).select("shard", "length", F.coalesce("below", F.lit(0)).alias("below"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, lows, starts = held.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(lows, starts[length] + rank, side="right") - 1
            step = rank - p["low"][at]
            sequence = p["base"][at] + step // p["each"][at]
            offset = p["offset"][at] + step % p["each"][at] * length
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cut.join(first.hint("shuffle_hash"), ["shard", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("below")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op9_best_fit_packing": op9_best_fit_packing}
SQL: dict[str, str] = {}
