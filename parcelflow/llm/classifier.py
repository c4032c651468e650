"""Text quality by a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, scratch, table

#: Labelled rows of each class that a model is fitted on, at most about (by a hash of their ids).
MOST_LABELLED = 10_000
N_WORDS = 4096
RANK = 6
LEVELS = 8
STEPS = 30
RATE = 0.1
#: Parts that the labelled rows are dealt over; a step sends one gradient a part.
PARTS = 12


def _byte_classes() -> np.ndarray:
    """Of each byte of UTF-8: 1 white space, 2 capitals, 3 small letters and all beyond ASCII, 4 digits, 5 punctuation, 6 exclamation marks, 7 other signs, 0 what only goes on with a character."""
    out = np.full(256, 7)
    out[0x80:0xC0] = 0
    out[[0x20, *range(0x09, 0x0E)]] = 1
    out[0x41:0x5B] = 2
    out[[*range(0x61, 0x7B), *range(0xC0, 0x100)]] = 3
    out[0x30:0x3A] = 4
    out[[ord(c) for c in ".,;:?'\"()-"]] = 5
    out[ord("!")] = 6
    return out


_CLASSES = _byte_classes()


def structure(text: bytes, counts: Counter) -> list[float]:
    """Statistics of a text's form, from its bytes and its words' numbers; zero where a text has none of what they count."""
    codes = np.frombuffer(text, dtype=np.uint8)
    each = np.bincount(codes, minlength=256)
    _, space, capitals, small, digits, marks, loud, signs = np.bincount(_CLASSES, each, 8)
    within = np.concatenate([[False], _CLASSES[codes] != 1, [False]])
    edges = np.flatnonzero(within[1:] != within[:-1])
    lengths = edges[1::2] - edges[::2]
    n, chars = max(1, len(lengths)), max(1.0, space + capitals + small + digits + marks + loud + signs)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        math.log1p(len(lengths)),
        float(lengths.mean()) if len(lengths) else 0.0,
        (capitals + small) / chars,
        capitals / max(1.0, capitals + small),
        digits / chars,
        marks / n,
        signs / n,
        loud / n,
        float(each[ord(".")] + each[ord("?")]) / n,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        float((lengths <= 3).sum()) / n,
        len(lines) / n,
        len(set(lines)) / max(1, len(lines)),
    ]


N_STATS = len(structure(b"", Counter()))


class _Buckets(dict):
    """Bucket of each word, held for some of them."""

    def __init__(self, n_words: int, most: int):
        self.n_words, self.most = n_words, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        b = self[word] = zlib.crc32(word) % self.n_words
        return b


class Reader:
    """Sparse word features and statistics of texts."""

    def __init__(self, n_words: int = N_WORDS, most: int = 200_000):
        self.buckets = _Buckets(n_words, most)

    def read(self, text: str | None) -> tuple[np.ndarray, np.ndarray, list[float]]:
        """Buckets in ascending order, their values (logs of counts, of unit length together) and the statistics. Words are parted by ASCII white space; A-Z count as small letters."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        counts = Counter(raw.lower().split())
        found = np.fromiter(map(self.buckets.__getitem__, counts), dtype=np.int64, count=len(counts))
        total = np.bincount(found, np.fromiter(counts.values(), dtype=np.float64, count=len(counts)))
        at = np.flatnonzero(total)
        values = 1 + np.log(total[at])
        return at.astype(np.int32), values / max(1e-9, float(np.sqrt(values @ values))), structure(raw, counts)


@dataclass
class Model:
    """A bias, a weight and ``rank`` factors a feature: words' buckets, then each statistic's levels and its absence, then one that every text has."""

    n_words: int
    cuts: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    scale: float = field(init=False)

    def __post_init__(self):
        self.scale = 1 / math.sqrt(max(1, self.cuts.size))

    @staticmethod
    def blank(n_words: int, cuts: np.ndarray, rank: int, bias: float = 0.0, seed: int = 1) -> Model:
        size = n_words + cuts.shape[0] * (cuts.shape[1] + 1) + 1
        return Model(n_words, cuts, bias, np.zeros(size), np.random.default_rng(seed).normal(0, 0.1, (size, rank)))

    def levels(self, stats: np.ndarray) -> np.ndarray:
        """Which levels each row's statistics reach: one column a cut, then one that says that the statistic is missing."""
        known = ~np.isnan(stats)
        reached = (stats[:, :, None] >= self.cuts[None]) & known[:, :, None]
        return np.concatenate([reached, ~known[:, :, None]], axis=2).reshape(len(stats), -1)

    def rows(self, read: Sequence[tuple[np.ndarray, np.ndarray, Sequence[float]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, features and values of sparse rows; no row is empty."""
        levels = self.levels(np.asarray([s for _, _, s in read], dtype=np.float64).reshape(len(read), len(self.cuts)))
        starts, at, values = [0], [], []
        last = len(self.weights) - 1
        for (buckets, v, _), on in zip(read, levels, strict=True):
            more = np.flatnonzero(on) + self.n_words
            at += [buckets, more, [last]]
            values += [v, np.full(len(more), self.scale), [self.scale]]
            starts.append(starts[-1] + len(buckets) + len(more) + 1)
        return np.asarray(starts[:-1]), np.concatenate(at).astype(np.int64), np.concatenate(values).astype(np.float64)

    def sums(self, starts: np.ndarray, at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of each row, and the sums of its factors.

        All pairs of features together count half of the squared sum of
        their factors less the sum of the squares, which takes time in
        proportion to a row's features.
        """
        v = self.factors[at] * values[:, None]
        total = np.add.reduceat(v, starts, axis=0)
        pairs = 0.5 * (total**2 - np.add.reduceat(v**2, starts, axis=0)).sum(axis=1)
        return self.bias + np.add.reduceat(self.weights[at] * values, starts) + pairs, total

    def score(self, read: Sequence[tuple[np.ndarray, np.ndarray, Sequence[float]]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.sums(*self.rows(read))[0], -30, 30)))

    def gradient(self, read: Sequence, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Of the weighted log loss: of the bias, the weights and the factors in one array."""
        starts, at, values = self.rows(read)
        odds, total = self.sums(starts, at, values)
        g = weight * (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - y)
        row = np.repeat(np.arange(len(starts)), np.diff([*starts, len(at)]))
        gv = g[row] * values
        size = len(self.weights)
        out = [[g.sum()], np.bincount(at, gv, size)]
        for f in range(self.factors.shape[1]):
            out.append(np.bincount(at, gv * (total[row, f] - self.factors[at, f] * values), size))
        return np.concatenate(out)


def _rows(b: pa.RecordBatch, names: tuple[str, str, str]) -> Iterator[tuple[np.ndarray, np.ndarray, list[float]]]:
    for at, values, stats in zip(*(b.column(c) for c in names), strict=True):
        yield at.values.to_numpy(zero_copy_only=False), values.values.to_numpy(zero_copy_only=False), [math.nan if x is None else x for x in stats.as_py()]


def _with_metadata(rows: DataFrame, id_col: str, text_col: str, meta_cols: Sequence[str]) -> list[Column]:
    meta = F.array(*(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")) for c in meta_cols)) if meta_cols else F.array().cast("array<double>")
    return [F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), meta.alias("meta")]


def _measures(stats: list[float], meta: list[float | None]) -> list[float]:
    """Sizes count by their logs; a missing, negative or infinite one is not known."""
    return stats + [math.log1p(x) if x is not None and 0 <= x < math.inf else math.nan for x in meta]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", meta_cols: Sequence[str] = ("n_chars",), most_labelled: int = MOST_LABELLED, n_words: int = N_WORDS, rank: int = RANK, steps: int = STEPS) -> Model:
    """A model of labelled rows, of each class at most about ``most_labelled``.

    Ids with several labels count as 1 if any is. Rows with null ids or
    labels are left out. Copies of a text have one vote a class; both classes
    weigh the same together. Levels of the statistics lie at quantiles of
    the labelled rows. Steps follow the gradient over all of them, which
    each of ``PARTS`` tasks sums up for its rows; the driver sees the sums
    and the statistics of the bounded rows. Null and empty texts have no words.
    With one class or none, or an empty table, the model says its share alone, or one half.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).na.drop().groupBy("id").agg((F.max("y") > 0).cast("int").alias("y"))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.when(F.col("y") == 1, min(1.0, most_labelled / max(1, sizes.get(1, 0)))).otherwise(min(1.0, most_labelled / max(1, sizes.get(0, 0))))
    known = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share * 1_000_000)
    texts = docs.select(*_with_metadata(docs, id_col, text_col, meta_cols)).join(F.broadcast(known), "id")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(n_words)
        names = ["y", "at", "values", "stats"]
        for b in batches:
            out = []
            for y, text, meta in zip(b.column("y"), b.column("text"), b.column("meta"), strict=True):
                at, values, stats = reader.read(text.as_py())
                out.append((y.as_py(), at, values, _measures(stats, meta.as_py())))
            for i in range(0, len(out), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 1000], strict=True), (pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64())), strict=True)], names)

    path = scratch(spark, "labelled")
    once = texts.withColumn("key", F.xxhash64("text")).dropDuplicates(["key", "y"]).select("y", "text", "meta")
    once.repartition(PARTS).mapInArrow(read, "y int, at array<int>, values array<double>, stats array<double>").write.parquet(path)
    rows = spark.read.schema("y int, at array<int>, values array<double>, stats array<double>").parquet(path)
    seen = rows.select("y", "stats").toPandas()
    y = seen["y"].to_numpy(dtype=np.int64)
    stats = np.array([list(x) for x in seen["stats"]], dtype=np.float64).reshape(len(y), N_STATS + len(meta_cols))
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    with np.errstate(all="ignore"):
        cuts = np.array([np.unique(np.quantile(c, np.arange(1, LEVELS + 1) / (LEVELS + 1))) if len(c := s[~np.isnan(s)]) else [] for s in stats.T], dtype=object) if len(y) else [[]] * stats.shape[1]
    model = Model.blank(n_words, np.array([[*c, *[math.inf] * (LEVELS - len(c))] for c in cuts], dtype=np.float64), rank)
    if n1 and n0:
        _descend(model, rows, {1: 0.5 / n1, 0: 0.5 / n0}, steps)
    else:
        model.factors[:] = 0
        model.bias = math.log((n1 + 1) / (n0 + 1))
    dropped(spark, path)
    return model


def _descend(model: Model, rows: DataFrame, weigh: dict[int, float], steps: int, decay: float = 1e-5) -> None:
    """Adam over the whole gradient; every step is one job over the stored rows."""
    sc = rows.sparkSession.sparkContext
    size, rank = model.factors.shape
    theta = np.concatenate([[model.bias], model.weights, model.factors.T.ravel()])
    m, v = np.zeros_like(theta), np.zeros_like(theta)

    def put(t: np.ndarray) -> None:
        model.bias, model.weights, model.factors = float(t[0]), t[1 : size + 1], np.ascontiguousarray(t[size + 1 :].reshape(rank, size).T)

    for step in range(1, steps + 1):
        put(theta)
        held = sc.broadcast(model)

        def slope(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            total = np.zeros(1 + size * (rank + 1))
            for b in batches:
                for i in range(0, b.num_rows, 500):
                    part = b.slice(i, 500)
                    y = part.column("y").to_numpy()
                    total += held.value.gradient(list(_rows(part, ("at", "values", "stats"))), y, np.where(y == 1, weigh[1], weigh[0]))
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "sums"])

        got = sorted((r["part"], r["sums"]) for r in rows.mapInArrow(slope, "part int, sums binary").collect())
        held.unpersist()
        g = np.sum([np.frombuffer(s) for _, s in got], axis=0) + decay * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    put(theta)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", meta_cols: Sequence[str] = ("n_chars",)) -> DataFrame:
    """doc_id and score of every row, from its whole text and the metadata columns alone.

    Null and empty texts have the statistics of an empty one; a null in a
    metadata column says that it is missing. Ids stay as they are, null
    ones too; repeated rows stay and score alike; very long texts are read
    whole, one at a time. Other columns are left out; an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*_with_metadata(docs, id_col, text_col, meta_cols))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(held.value.n_words)
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                read = []
                for text, meta in zip(part.column("text"), part.column("meta"), strict=True):
                    at, values, stats = reader.read(text.as_py())
                    read.append((at, values, _measures(stats, meta.as_py())))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(held.value.score(read), pa.float64())], ["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['id'].dataType.simpleString()}, score double")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels no model sees: a fourth, by the id's checksum; never a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out(F.col("doc_id")))
    got = score(docs, fit(docs, labels))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {"op12_quality_classifier": op12_quality_classifier}
SQL: dict[str, str] = {}
