"""Importance resampling towards a target distribution: hashed word features, log-ratio gains, Gumbel top-k."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from functools import partial
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, stored, table

N_BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: all of ASCII but digits and small letters.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _CAPITALS, _SMALL), _BETWEEN), "")


def _run(found: Column, n: int, start: Column) -> Column:
    return F.concat_ws(" ", *(F.get(found, start + k) for k in range(n)))


def buckets(found: Column, longest: int = 1, n_buckets: int = N_BUCKETS) -> Column:
    """Bucket of each run of one to ``longest`` words, repeats included."""
    runs = [found]
    for n in range(2, longest + 1):
        starts = F.when(F.size(found) >= n, F.sequence(F.lit(0), F.size(found) - n)).otherwise(F.array().cast("array<int>"))
        runs.append(F.transform(starts, partial(_run, found, n)))
    return F.transform(F.concat(*runs) if len(runs) > 1 else found, lambda x: F.pmod(F.crc32(x.cast("binary")), F.lit(n_buckets)).cast("int"))


def bucket_counts(texts: DataFrame, text_col: str = "text", longest: int = 1, n_buckets: int = N_BUCKETS) -> list[int]:
    """Features of all whole texts by bucket; each task sends one total a bucket."""
    found = texts.select(F.explode(let(words(F.col(f"`{text_col}`")), lambda w: buckets(w, longest, n_buckets))).alias("bucket"))
    out = [0] * n_buckets
    for r in found.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """Of each bucket, a thousand times the log of its share in the target over its share in the corpus, rounded down; counts go up by one each."""
    n, all_s, all_t = len(corpus), sum(corpus), sum(target)
    return [math.floor(1000 * math.log((t + 1.0) * (all_s + n) / ((s + 1.0) * (all_t + n)))) for s, t in zip(corpus, target, strict=True)]


def weighed(docs: DataFrame, gain: list[int], id_col: str = "doc_id", text_col: str = "text", longest: int = 1, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row, without exploding a text.

    The score is the weight plus Gumbel noise that the id alone decides, so
    the rows of highest score are a sample without replacement by weight.
    """
    listed = F.from_json(F.lit(json.dumps(gain)), "array<bigint>")
    named = F.col(f"`{id_col}`")
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(named.cast("string"), F.lit(""))), 256), 1, 8)
    noise = F.floor(-1000.0 * F.log(-F.log((F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0)))

    def measured(found: Column) -> Column:
        total = lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda s, x: s + F.element_at(listed, x + 1))
        return let(buckets(found, longest, len(gain)), lambda b: F.struct(F.size(found).cast("long").alias("n_words"), F.size(b).cast("long").alias("n_features"), total(b).alias("weight")))

    m = F.col("m")
    return docs.select(named.alias("doc_id"), let(words(F.col(f"`{text_col}`")), measured).alias("m"), noise.alias("noise")).select("doc_id", m["n_words"].alias("n_words"), m["n_features"].alias("n_features"), m["weight"].alias("weight"), (m["weight"] + F.col("noise")).cast("long").alias("score"))


def places(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """``rows`` with their place (from 1) in an order over all of them.

    Rows are dealt out by range, sorted and numbered in each task and stored;
    what the driver sees is one count a task.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, n = TaskContext.get().partitionId(), 0
        for b in batches:
            k = b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([shard] * k, pa.int32()), pa.array(range(n + 1, n + k + 1), pa.int64())], [*b.schema.names, "_shard", name])
            n += k

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    held = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, f"{kinds}, _shard int, `{name}` long"), "places")
    counts = sorted((r["_shard"], r["n"]) for r in held.groupBy("_shard").agg(F.count(F.lit(1)).alias("n")).collect())
    if not counts:
        return held.drop("_shard")
    before = dict(zip((s for s, _ in counts), [0, *accumulate(n for _, n in counts)], strict=False))
    ahead = F.from_json(F.lit(json.dumps([before.get(i, 0) for i in range(counts[-1][0] + 1)])), "array<bigint>")
    return held.withColumn(name, F.col(name) + F.get(ahead, F.col("_shard"))).drop("_shard")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = 1, n_buckets: int = N_BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of ``docs``; ``percent`` of those with ``least_words`` words are drawn and have a rank.

    Texts are read whole, very long ones too. Null, empty and wordless texts have no features, weight 0
    and are not drawn. Equal scores rank by id, null ids first among them;
    repeated rows stay and rank one after the other; a null id has the noise
    of an empty one. Other columns of both tables are left out, whatever
    their names. An empty table gives no rows; an empty target leaves all buckets
    equal there. The driver sees one number a bucket and one a task.
    """
    gain = gains(bucket_counts(docs, text_col, longest, n_buckets), bucket_counts(target, text_col, longest, n_buckets))
    able = F.col("n_words") >= least_words
    # Stored, as dealing out by range reads its rows twice.
    scored = stored(weighed(docs, gain, id_col, text_col, longest, seed), "scores")
    rows = places(scored, [able.desc(), F.col("score").desc(), F.col("doc_id").asc()], "rank")
    drawn = percent * rows.where(able).count() // 100
    return rows.withColumn("rank", F.when(able & (F.col("rank") <= drawn), F.col("rank")))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (table(spark, sf_dir, t).select(*c) for t, c in (("documents", ("doc_id", "text")), ("benchmark", ("text",))))
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {"op11_importance_resampling": op11_importance_resampling}
SQL = {
    "op11_importance_resampling": rf"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_CAPITALS}', '{_SMALL}'), '{_BETWEEN}'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_CAPITALS}', '{_SMALL}'), '{_BETWEEN}'), lambda x: x <> '')) AS w FROM benchmark),
e AS MATERIALIZED (SELECT row, w, count(*) AS n FROM (SELECT row, unnest(w) AS w FROM d) GROUP BY ALL),
v AS MATERIALIZED (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(w) + 1), lambda i: ('0x' || substr(hex(encode(w)), 2 * i - 1, 2))::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % {N_BUCKETS} AS k FROM (SELECT w FROM e UNION SELECT w FROM b), crc),
s AS (SELECT k, sum(n)::BIGINT AS n FROM e JOIN v USING (w) GROUP BY k),
t AS (SELECT k, count(*) AS n FROM b JOIN v USING (w) GROUP BY k),
g AS (SELECT s.k, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + {N_BUCKETS})::DOUBLE / ((s.n + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + {N_BUCKETS})::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (k)),
w AS (SELECT row, sum(n * gain)::BIGINT AS weight FROM e JOIN v USING (w) JOIN g USING (k) GROUP BY row),
f AS (SELECT d.row, doc_id, len(d.w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN w USING (row)),
r AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM f WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * (SELECT count(*) FROM r) // 100 THEN rank END AS rank FROM f LEFT JOIN r USING (row)
"""
}
