"""Hard negatives by blocked dense products: blocks of anchors are broadcast and multiplied with blocks of candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, scratch, stored, table

#: Anchors that are broadcast at once, about; with 64 components they take 32 MB.
BLOCK = 65_536
#: Anchors and candidates that are multiplied at once.
_ANCHORS, _CANDIDATES = 1024, 2048
POSITIVES, NEGATIVES = 5, 3
#: Float64 holds all whole numbers up to here.
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


def usable(vector: Column) -> Column:
    """Whether there is a vector without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad


def _matrix(column: pa.Array, factor: float, width: int | None = None) -> np.ndarray:
    """Rounded-down components, one row a vector; what a vector lacks counts as zero, as does what only candidates have beyond ``width``."""
    flat = np.floor(column.values.to_numpy(zero_copy_only=False).astype(np.float64)[column.offsets[0].as_py() : column.offsets[-1].as_py()] * factor)
    sizes = np.diff(column.offsets.to_numpy())
    wide = int(sizes.max(initial=0)) if width is None else width
    if len(flat) == len(sizes) * wide and (sizes == wide).all():
        return flat.reshape(len(sizes), wide)
    out = np.zeros((len(sizes), wide))
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row[at < wide], at[at < wide]] = flat[at < wide]
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole-number rows, without error; beyond a long they are its ends."""
    if a.shape[1] * np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) < _EXACT:
        return a @ b.T
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(a) @ whole(b).T, -_LONG - 1, _LONG)


class Best:
    """The ``k`` best entries of each of ``m`` lists, by score, then smaller id; lists of parts of the candidates merge into those of all."""

    def __init__(self, m: int, k: int):
        self.k = k
        self.rows = np.empty(0, dtype=np.int64)
        self.ids = np.empty(0, dtype=np.int64)
        self.scores = np.empty(0, dtype=np.int64)
        #: Score of the last of a full list: what is below cannot enter.
        self.floor = np.full(m, -np.inf)

    def offer(self, lists: np.ndarray, ids: np.ndarray, scores: np.ndarray, able: np.ndarray) -> None:
        """Candidates ``ids`` for each of ``lists`` (one row of scores a list), where ``able``."""
        if scores.dtype != object:
            able &= scores >= self.floor[lists][:, None]
            if able.sum() > 4 * self.k * len(lists) and scores.shape[1] > self.k:
                # Ties with the last of the best stay, as ids decide between them.
                able &= scores >= -np.partition(np.where(able, -scores, np.inf), self.k - 1, axis=1)[:, self.k - 1, None]
        r, j = np.nonzero(able)
        self.add(lists[r], ids[j], scores[r, j])

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(rows):
            return
        rows, ids = np.concatenate([self.rows, rows]), np.concatenate([self.ids, ids])
        scores = np.concatenate([self.scores, scores.astype(np.int64)])
        order = np.lexsort((ids, ~scores, rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        place = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))
        keep = place < self.k
        self.rows, self.ids, self.scores = rows[keep], ids[keep], scores[keep]
        full = place == self.k - 1
        self.floor[rows[full]] = scores[full]


def _candidates(batches: Iterator[pa.RecordBatch], factor: float, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels and matrices of at most ``_CANDIDATES`` rows, sorted by label."""
    for b in batches:
        for i in range(0, b.num_rows, _CANDIDATES):
            part = b.slice(i, _CANDIDATES)
            labels = part.column("label").to_numpy()
            order = np.argsort(labels, kind="stable")
            yield part.column("id").to_numpy()[order], labels[order], _matrix(part.column("vector"), factor, width)[order]


def _pieces(labels: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of one label in sorted labels, at most ``_ANCHORS`` rows each."""
    cuts = np.r_[0, np.flatnonzero(labels[1:] != labels[:-1]) + 1, len(labels)] if len(labels) else [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield from ((i, min(i + _ANCHORS, b)) for i in range(a, b, _ANCHORS))


def _listed(best: Best, names: list[str]) -> Iterator[pa.RecordBatch]:
    columns = [best.rows, best.ids, best.scores]
    for i in range(0, len(best.rows), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 50_000], pa.int64()) for c in columns], names)


def _positives(rows: DataFrame, held, factor: float, k: int) -> DataFrame:
    """row, id and score of each anchor's ``k`` first other rows of its label, for each task's candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, matrix = held.value
        best = Best(len(ids), k)
        for c_ids, c_labels, c in _candidates(batches, factor, matrix.shape[1]):
            for a, b in _pieces(labels):
                lo, hi = np.searchsorted(c_labels, labels[a], "left"), np.searchsorted(c_labels, labels[a], "right")
                if lo == hi:
                    continue
                s = products(matrix[a:b], c[lo:hi])
                best.offer(np.arange(a, b), c_ids[lo:hi], s, ids[a:b, None] != c_ids[None, lo:hi])
        yield from _listed(best, ["row", "id", "score"])

    return rows.mapInArrow(run, "row long, id long, score long")


def _negatives(rows: DataFrame, held, factor: float, k: int) -> DataFrame:
    """place (of an anchor and positive), id and score of the ``k`` first rows of other labels in its window, for each task's candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (_, labels, matrix), place, least, most = held.value
        best = Best(int(place.max(initial=-1)) + 1, k)
        for c_ids, c_labels, c in _candidates(batches, factor, matrix.shape[1]):
            for a, b in _pieces(labels):
                other = np.flatnonzero(c_labels != labels[a])
                if not len(other):
                    continue
                s = products(matrix[a:b], c[other])
                for p in range(place.shape[1]):
                    at = place[a:b, p]
                    some = np.flatnonzero(at >= 0)
                    if not len(some):
                        continue
                    x, at = s[some], at[some]
                    best.offer(at, c_ids[other], x, ((x >= least[at][:, None]) & (x <= most[at][:, None])).astype(bool))
        yield from _listed(best, ["place", "id", "score"])

    return rows.mapInArrow(run, "place long, id long, score long")


def _first(df: DataFrame, key: str, k: int) -> DataFrame:
    """The lists of all tasks merged: ``rank`` among the rows of a key."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.col("score").desc(), "id"))).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label: Column | str = "label",
    factor: int = 256,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = 50,
    high: int = 95,
    block: int = BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Scores are inner products of components times ``factor``, rounded down.
    A negative's score lies between ``low`` and ``high`` per cent of the positive's.
    Every anchor meets every row: anchors in blocks of about ``block``, each broadcast; rows
    as they lie in the table. A task keeps the best of each anchor, so lists are
    all that is shuffled and sorted.

    Rows without an id, a label or a vector, or with a null or non-finite
    component, take no part. Vectors of different lengths count as if filled
    up with zeros. Repeated rows are candidates and anchors each by itself; an anchor's own id is never
    its positive. Equal scores go by smaller id. Products beyond float64's
    whole numbers are worked out as integers, and held at the ends of a long
    beyond it. Other columns are left out; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    named, vector = F.col(f"`{id_col}`"), F.col(f"`{vector_col}`")
    label = F.col(f"`{label}`") if isinstance(label, str) else label
    rows = vectors.where(named.isNotNull() & label.isNotNull() & usable(vector)).select(named.cast("long").alias("id"), label.cast("long").alias("label"), vector.alias("vector"), is_anchor.alias("anchor"))
    anchors = rows.where("anchor").select("id", "label", "vector")
    rows = rows.select("id", "label", "vector")
    n_blocks = max(1, -(-anchors.count() // block))
    dealt = stored(anchors.withColumn("block", F.floor(F.rand(5) * n_blocks).cast("int")), "anchors") if n_blocks > 1 else anchors.withColumn("block", F.lit(0))
    out = scratch(spark, "negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(out)
    for i in range(n_blocks):
        got = dealt.where(F.col("block") == i).select("id", "label", "vector").toArrow()
        if not got.num_rows:
            continue
        ids, labels, matrix = got.column("id").to_numpy(), got.column("label").to_numpy(), _matrix(got.column("vector").combine_chunks(), factor)
        order = np.lexsort((ids, labels))
        ids, labels, matrix = ids[order], labels[order], matrix[order]
        held = spark.sparkContext.broadcast((ids, labels, matrix))
        path = scratch(spark, "positives")
        _first(_positives(rows, held, factor, positives), "row", positives).write.parquet(path)
        pos = spark.read.parquet(path).toPandas().sort_values(["row", "rank"], ignore_index=True)
        dropped(spark, path)
        held.unpersist()
        # Where windows are: one place for each anchor and positive, in exact whole numbers.
        place = np.full((len(ids), positives), -1, dtype=np.int64)
        place[pos["row"], pos["rank"] - 1] = np.arange(len(pos))
        least = np.array([-(-low * int(s) // 100) for s in pos["score"]], dtype=object)
        most = np.array([high * int(s) // 100 for s in pos["score"]], dtype=object)
        if all(abs(x) < _EXACT for x in (*least, *most)):
            least, most = least.astype(np.float64), most.astype(np.float64)
        held = spark.sparkContext.broadcast(((ids, labels, matrix), place, least, most))
        found = _first(_negatives(rows, held, factor, negatives), "place", negatives)
        pos["place"], pos["anchor_id"] = np.arange(len(pos)), ids[pos["row"]]
        # One row a positive of this block: its size is bounded by the block's.
        windows = F.broadcast(spark.createDataFrame(pos[["place", "anchor_id", "id", "score"]].rename(columns={"id": "positive_id", "score": "positive_score"}), "place long, anchor_id long, positive_id long, positive_score long"))
        found.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(windows, "place").select(*(x.split()[0] for x in schema.split(", "))).write.mode("append").parquet(out)
        held.unpersist()
    return spark.read.schema(schema).parquet(out)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return hard_negatives(vectors, F.col("vec_id") % 50 == 0, label=label)


QUERIES = {"op13_hard_negatives": op13_hard_negatives}
SQL = {
    "op13_hard_negatives": f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.row AS a, a.vec_id AS anchor_id, c.row AS c, c.vec_id AS id, a.label = c.label AS same, list_dot_product(a.e, c.e)::BIGINT AS score FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT a, anchor_id, c, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id) <= {POSITIVES}),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.a, p.c ORDER BY s.score DESC, s.id)::INT AS rank FROM p JOIN s ON p.a = s.a AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
}
