"""Toxicity by a noisy channel: obfuscated words are decoded under a character model, then the restored text is scored."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: Labelled rows that a model is fitted on, at most (by a hash of their ids); counts for the character model come from all texts.
MOST_LABELLED = 20_000
#: Different toxic texts that a feature has to be in, copies aside, and the least log odds that it has to show.
LEAST_SUPPORT = 5
LEAST_ODDS = 3.5
#: Different words of a text that may be told as a copy by two of them.
LONG_TEXT = 20

#: Letters that a character may stand for. (Fixed values.)
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¥": "y"}
#: Characters that may stand between the letters of one word. (Fixed values.)
GAPS = frozenset(" .-_*~'·")
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_SIZE = len(_LETTERS) + 1
_RUN = re.compile(r"(?<!\S)(?:\S\s+){2,}\S(?!\S)")
_ODD = re.compile(r"[^\W\d_][\W\d_]+[^\W_]|[\d@$!|+€£¥][^\W\d_]|[^\W\d_]\d|([^\W_])\1")
_REPEATS = re.compile(r"(.)\1+")
_EDGE = re.compile(r"^[^\w@$€£¥]+|[^\w]+$")
_MANY_SIGNS = re.compile(r"^[@$€£¥]{2,}")


def _letter_table() -> np.ndarray:
    """Class of each code point up to U+024F: 1 to 26 for letters without their accents, else 0."""
    out = np.zeros(0x250, dtype=np.int32)
    for c in range(0x250):
        base = unicodedata.normalize("NFD", chr(c).lower())[:1]
        if base in _LETTERS and base:
            out[c] = _LETTERS.index(base) + 1
    return out


_CLASSES = _letter_table()


def letter_classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.where(points < len(_CLASSES), _CLASSES[np.minimum(points, len(_CLASSES) - 1)], 0)


def trigram_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of all runs of three letter classes in all whole texts; each task sends one table of fixed size."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(_SIZE**3, dtype=np.int64)
        for b in batches:
            for text in b["text"]:
                if text:
                    c = np.concatenate(([0, 0], letter_classes(text), [0]))
                    total += np.bincount(c[:-2] * _SIZE**2 + c[1:-1] * _SIZE + c[2:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pd.DataFrame({"gram": at.astype(np.int32), "n": total[at]})

    got = docs.select(F.col(f"`{text_col}`").alias("text")).mapInPandas(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(_SIZE**3, dtype=np.int64)
    out[got["gram"].to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=np.int64)
    return out


def character_model(counts: np.ndarray) -> np.ndarray:
    """Log probability of a letter after two others, interpolated with shorter contexts."""
    n3 = counts.reshape(_SIZE, _SIZE, _SIZE).astype(float)
    n2, n1 = n3.sum(axis=0), n3.sum(axis=(0, 1))
    p1 = (n1 + 1) / (n1.sum() + _SIZE)
    p2 = (n2 + 20 * p1) / (n2.sum(axis=1, keepdims=True) + 20)
    p3 = (n3 + 20 * p2) / (n3.sum(axis=2, keepdims=True) + 20)
    return np.log(p3)


class Decoder:
    """Viterbi decoding of a word's character lattice."""

    def __init__(self, model: np.ndarray, most_words: int = 200_000):
        self.model = model
        self.table = model.ravel().tolist()
        self.most_words = most_words
        self.seen: dict[str, str] = {}
        #: Weighed features of tokens, held by the one model that scores with this decoder.
        self.told: dict[str, tuple[str, ...]] = {}

    @staticmethod
    def lattice(word: str) -> list[list[tuple[str, float]]]:
        """Strings that each run of one character may stand for, with the channel's log probability."""
        out, i = [], 0
        while i < len(word):
            j = i
            while j < len(word) and word[j] == word[i]:
                j += 1
            c, n = word[i], j - i
            base = unicodedata.normalize("NFD", c)[:1]
            options: list[tuple[str, float]] = []
            if c.isalpha():
                options.append((base, 0.0 if n == 1 else -1.5 if n == 2 else -0.3))
                if n > 1:
                    options.append((base * 2, 0.0 if n == 2 else -0.7))
            else:
                for letter in LEET.get(c, ""):
                    options.append((letter, -1.0))
                    if n > 1:
                        options.append((letter * 2, -1.6))
                options.append(("", -1.0 if c in GAPS else -25.0))
                options.append((" ", -12.0 if c in LEET else -3.0))
            out.append(options)
            i = j
        return out

    def decode(self, word: str) -> str:
        """The likeliest letters, with spaces where the word falls apart.

        The state is the last two letters. It is carried over the whole
        word, however long; the paths behind the states share their
        beginnings, so time and memory grow with the length alone.
        """
        if word in self.seen:
            return self.seen[word]
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for options in [*self.lattice(word), [(" ", 0.0)]]:
            step: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, path) in best.items():
                for letters, channel in options:
                    x, y, s = a, b, score + channel
                    for c in letters:
                        z = _LETTERS.find(c) + 1
                        s += self.table[(x * _SIZE + y) * _SIZE + z]
                        x, y = y, z
                    if (x, y) not in step or s > step[x, y][0]:
                        step[x, y] = (s, (letters, path))
            best = step
        path, parts = max(best.values(), key=lambda x: x[0])[1], []
        while path:
            parts.append(path[0])
            path = path[1]
        return self._held(word, " ".join("".join(reversed(parts)).split()))

    def _held(self, word: str, out: str) -> str:
        if len(word) <= 100:
            if len(self.seen) >= self.most_words:
                self.seen.clear()
            self.seen[word] = out
        return out

    def _sure(self, word: str) -> float:
        """Log probability of a word's letters, as they stand."""
        x, y, s = 0, 0, 0.0
        for z in [_LETTERS.find(c) + 1 for c in word] + [0]:
            s += self.table[(x * _SIZE + y) * _SIZE + z]
            x, y = y, z
        return s

    def letters(self, word: str) -> str:
        """The likeliest reading of a word of letters alone: its lattice branches where a letter is repeated, and nowhere else."""
        if word in self.seen:
            return self.seen[word]
        repeats = list(_REPEATS.finditer(word))
        if len(repeats) == 1 and len(repeats[0][0]) == 2 and word.isascii():
            # Two paths: no need to keep states.
            less = word[: repeats[0].start()] + word[repeats[0].start() + 1 :]
            return self._held(word, less if self._sure(less) - 1.5 > self._sure(word) else word)
        return self.decode(word) if repeats else word

    def runs(self, lower: str) -> set[str]:
        """Words that stand as single characters with white space of any kind between them."""
        out: set[str] = set()
        for run in (" ".join(x.split()) for x in _RUN.findall(lower)):
            # Short words may stand beside a spaced one.
            for part in {run, run[2:], run[:-2], run[2:-2]}:
                out.update(self.decode(part).split())
        return out

    def words(self, token: str) -> set[str]:
        """A token's words as they stand and, where their lattice has other paths, as its best one reads."""
        word = _EDGE.sub("", token)
        if word.isalpha():
            read = self.letters(word)
            return {word} if read == word else {word, *read.split()}
        word = _MANY_SIGNS.sub("", word)
        if not any(c.isalpha() for c in word):
            return set()
        out = {x for x in re.split(r"[\W\d_]+", word) if x}
        return out.union(self.decode(word).split()) if _ODD.search(word) else out

    def restored(self, text: str | None) -> set[str]:
        """The different words of a text, lower-cased; decoded ones have no accents' marks."""
        lower = (text or "").lower()
        return self.runs(lower).union(*map(self.words, set(lower.split())))


def plain(word: str) -> str:
    """A word without accents' marks, as decoded ones are."""
    return word if word.isascii() else "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def features(words: set[str]) -> set[str]:
    """Words of four letters or more, and the beginnings of four to six letters that inflected forms share."""
    out = set()
    for w in map(plain, words):
        if len(w) >= 4:
            out.add(w)
            out.update(w[:n] + "-" for n in (4, 5, 6) if n < len(w))
    return out


@dataclass
class Model:
    letters: np.ndarray
    weights: dict[str, float]
    bias: float

    def _weighed(self, words: set[str]) -> tuple[str, ...]:
        return tuple(f for f in features(words) if f in self.weights) if words else ()

    def score(self, decoder: Decoder, text: str | None) -> float:
        """Of a text, by definition: its strongest feature's weight and a fifth of those of the next four, over the bias, as a probability.

        More features of the same kind say little more; a sum over all would
        grow with the length of a text.
        """
        lower, told = (text or "").lower(), decoder.told
        seen = set(self._weighed(decoder.runs(lower)))
        for token in set(lower.split()):
            if (marks := told.get(token)) is None:
                marks = self._weighed(decoder.words(token))
                if len(token) <= 100:
                    if len(told) >= decoder.most_words:
                        told.clear()
                    told[token] = marks
            if marks:
                seen.update(marks)
        found = sorted((self.weights[f] for f in seen), reverse=True)
        evidence = found[0] + 0.2 * sum(found[1:5]) if found else 0.0
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + evidence))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_labelled: int = MOST_LABELLED) -> Model:
    """Character model of all texts and weights from at most about ``most_labelled`` labelled rows.

    Ids with several labels count as 1 if any is. Rows with null ids or
    labels are left out; null and empty texts have no features. Other
    columns of either table are not read, whatever their names. Without
    toxic labels, or with an empty table, the model has no weights and a low
    score for all. Ties of equal odds don't matter, as no feature is dropped
    for another. Copies have one vote a label together, so that they
    neither add nor remove evidence. A feature counts if toxic texts have it
    ten times as often as others, by number and by far more in proportion.
    """
    model = character_model(trigram_counts(docs, text_col))
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).na.drop().groupBy("id").agg(F.max("y").alias("y"))
    n = known.count()
    if n > most_labelled:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * most_labelled / n))
    held = docs.sparkSession.sparkContext.broadcast(model)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(known), "id")

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = Decoder(held.value)
        for b in batches:
            yield pd.DataFrame({"y": b["y"], "f": [sorted(features(decoder.restored(t))) for t in b["text"]]})

    made = texts.select("y", "text").mapInPandas(found, "y int, f array<string>")
    # Copies share nearly all their words, and so mostly the two with the least hashes; other texts may share one of these, hardly both. Short texts are copies if all words are the same.
    hashes = F.array_sort(F.transform(F.filter("f", lambda x: ~x.endswith("-")), lambda x: F.xxhash64(x)))
    key = F.xxhash64(F.when(F.size(hashes) < LONG_TEXT, hashes).otherwise(F.slice(hashes, 1, 2)))
    rows = stored(made.withColumn("key", key), "features")
    toxic = (F.col("y") > 0).cast("int").alias("y")
    sizes = {r["y"]: r["n"] for r in rows.select("key", toxic).distinct().groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    all1, all0 = sizes.get(1, 0), sizes.get(0, 0)
    if not all1:
        return Model(model, {}, -3.0)
    votes = rows.select("key", toxic, F.explode("f").alias("f")).distinct()
    each = votes.groupBy("f").agg(F.sum("y").alias("n1"), F.count(F.lit(1)).alias("n"))
    odds = F.log((F.col("n1") + 0.5) / (all1 + 1)) - F.log((F.col("n") - F.col("n1") + 0.5) / (all0 + 1))
    good = each.where((10 * (F.col("n") - F.col("n1")) <= F.col("n1")) & (F.col("n1") >= LEAST_SUPPORT)).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
    # All of them are held: as each is in LEAST_SUPPORT of MOST_LABELLED texts at least, their number does not grow with the documents.
    return Model(model, {r["f"]: r["odds"] for r in good.orderBy("f").collect()}, math.log((all1 + 1) / (all0 + 1)) - 1.0)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out and score of every row, from its whole text alone.

    Null and empty texts have no evidence. Ids stay as they are, of whatever
    type, null ones too; repeated rows stay and score alike; very long texts
    are decoded whole. Other columns are left out; an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(held.value.letters)
        for b in batches:
            scores = pa.array([held.value.score(decoder, t) for t in b.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), scores], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), held_out(F.col(f"`{id_col}`")).alias("held_out"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double")


def held_out(doc_id):
    """Rows whose labels no model sees: a fifth, by the id's checksum; never a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out(F.col("doc_id")))
    return score(docs, fit(docs, labels)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


QUERIES = {"op4_toxicity": op4_toxicity}
SQL: dict[str, str] = {}
