"""Secret scans: fixed patterns, then sliding-window entropy over long tokens."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table

#: Kinds in the order in which spans at one place are listed.
KINDS = ("assign", "access", "hex", "entropy")
_KEYWORD = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = rf"""({_KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Runs are maximal, so asking for the least length in the pattern finds the same spans.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

#: Characters of candidate strings; a window's counts are kept in this order.
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: A candidate's class is the first whose pattern it fits; with the bits a character that its best window needs.
CLASSES = (("hex", r"^[0-9A-Fa-f]+$", 3.0), ("alnum", r"^[A-Za-z0-9]+$", 3.5), ("base64", r"^[A-Za-z0-9+/_=-]+$", 3.5))
#: Candidates that fit one of these are no secrets: without a digit or a letter, names of test values, UUIDs, paths, one character repeated.
ALLOW = (
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    r"(?i)example|sample|dummy|placeholder|changeme",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^(?:[A-Za-z]*[-_/+=])*[A-Za-z]*[-_/+=]?[0-9]{1,4}$",
    r"([A-Za-z0-9])\1\1\1\1\1",
)
_SCALE = 1_000_000
_SPAN = "array<struct<s:int,k:int,e:int>>"


def _plogp(n: int) -> int:
    return round(n * math.log2(n) * _SCALE) if n else 0


def _most(bits: float) -> int:
    """The largest sum of count * log2(count) over a window that has ``bits`` a character."""
    return math.floor(WINDOW * (math.log2(WINDOW) - bits) * _SCALE)


def _spans(text: Column, kind: str, pattern: str, good=None, group: int = 0) -> Column:
    """Spans of the leftmost non-overlapping matches whose ``group`` is ``good``, in code points.

    What lies between the matches gives their places.
    """
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    parts = F.arrays_zip(pieces.alias("gap"), found.alias("hit"), (F.regexp_extract_all(text, F.lit(pattern), group) if group else found).alias("value"))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        fits = x["hit"].isNotNull() & (good(x["value"]) if good else F.lit(True))
        one = F.array(F.struct(start.alias("s"), F.lit(KINDS.index(kind)).alias("k"), end.alias("e"))).cast(_SPAN)
        return F.struct(end.alias("at"), F.when(fits, F.concat(a["spans"], one)).otherwise(a["spans"]).alias("spans"))

    none = F.array().cast(_SPAN)
    zero = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    return F.when(text.rlike(pattern), F.aggregate(parts, zero, step, lambda a: a["spans"])).otherwise(none)


def _least_sum(token: Column) -> Column:
    """The least sum of count * log2(count), scaled to whole numbers, over the token's windows.

    One character enters and one leaves: only their two counts and terms change.
    """
    terms = F.array(*(F.lit(_plogp(n)).cast("long") for n in range(WINDOW + 2)))

    def over(codes: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            come, go = F.get(codes, i), F.when(i >= WINDOW, F.get(codes, i - WINDOW)).otherwise(F.lit(-1))
            more = F.get(a["counts"], come)
            less = F.get(a["counts"], F.greatest(go, F.lit(0))) + F.when(go == come, F.lit(1)).otherwise(F.lit(0))
            moved = F.transform(a["counts"], lambda n, j: n + F.when(j == come, F.lit(1)).otherwise(F.lit(0)) - F.when(j == go, F.lit(1)).otherwise(F.lit(0)))
            total = a["total"] + F.get(terms, more + 1) - F.get(terms, more) + F.when(go >= 0, F.get(terms, less - 1) - F.get(terms, less)).otherwise(F.lit(0).cast("long"))
            return let(total, lambda t: F.struct(moved.alias("counts"), t.alias("total"), F.when(i >= WINDOW - 1, F.least(a["least"], t)).otherwise(a["least"]).alias("least")))

        zero = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0).cast("long").alias("total"), F.lit(1 << 60).cast("long").alias("least"))
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), zero.cast("struct<counts:array<int>,total:bigint,least:bigint>"), lambda a, i: step(a, i).cast("struct<counts:array<int>,total:bigint,least:bigint>"), lambda a: a["least"])

    return let(F.transform(F.array_remove(F.split(token, ""), ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1), over)


def _looks_random(token: Column, allow: Sequence[str]) -> Column:
    out = F.lit(False)
    for _, pattern, bits in reversed(CLASSES):
        out = F.when(token.rlike(pattern), _least_sum(token) <= _most(bits)).otherwise(out)
    known = F.lit(False)
    for pattern in allow:
        known = known | token.rlike(pattern)
    return F.when(known, F.lit(False)).otherwise(out)


def base_spans(text: Column) -> Column:
    parts = (
        _spans(text, "assign", ASSIGN, lambda v: F.length(v) >= 6, 2),
        _spans(text, "access", ACCESS),
        _spans(text, "hex", HEX),
    )
    return F.sort_array(F.concat(*parts))


def secret_spans(text: Column, allow: Sequence[str] = ALLOW) -> Column:
    """Array of (s, k, e) of a text: start, index into KINDS, end; by start, then kind.

    Base spans all stay, overlapping ones of different kinds too. A long
    token that overlaps none of them is added if its best window has the
    entropy of its class and no pattern of ``allow`` fits. Null gives none.
    """
    text = F.coalesce(text, F.lit(""))
    tokens = _spans(text, "entropy", CANDIDATE, lambda v: _looks_random(v, allow))
    free = lambda base, t: F.filter(t, lambda x: ~F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    return let(base_spans(text), lambda base: F.sort_array(F.concat(base, let(tokens, lambda t: free(base, t)))))


def spans_text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans replaced; null stays null."""

    def step(a: Column, x: Column) -> Column:
        gap = F.substring(text, a["at"] + 1, F.greatest(x["s"] - a["at"], F.lit(0)))
        out = F.when(x["s"] >= a["at"], F.concat(a["out"], F.array(gap, F.lit(mask)))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), out.alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, zero, step, done))


def scan(docs: DataFrame, text_col: str = "text", spans_col: str = "secret_spans", allow: Sequence[str] = ALLOW) -> DataFrame:
    """``docs`` with the secrets of each row in ``spans_col``.

    All rows stay, repeated ones too; null and empty texts have no spans;
    very long texts are scanned whole, in time that grows with their length.
    A column of ``docs`` named ``spans_col`` is replaced, others stay
    whatever their names. An empty table stays empty.
    """
    return docs.withColumn(spans_col, secret_spans(F.col(f"`{text_col}`"), allow))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.col("secret_spans").alias("x"))
    n = lambda kind: F.size(F.filter("x", lambda s: s["k"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    base = F.filter("x", lambda s: s["k"] < KINDS.index("entropy"))
    return found.select("doc_id", *map(n, KINDS), F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("x")).alias("spans"))


def _sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    one = lambda k, kind, pattern, group, good: f"SELECT rid, {k} AS k, unnest(string_split_regex(t, {q(pattern)})) AS gap, unnest(regexp_extract_all(t, {q(pattern)}, 0)) AS hit, unnest(regexp_extract_all(t, {q(pattern)}, {group})) AS v, generate_subscripts(string_split_regex(t, {q(pattern)}), 1) AS i FROM doc"
    # RE2 has no back references: a repeated character is spelt out.
    repeat = "|".join(f"{c}{{6}}" for c in ALPHABET[:62])
    allow = " OR ".join(f"regexp_matches(v, {q(a if chr(92) + '1' not in a else repeat)})" for a in ALLOW)
    most = "CASE " + " ".join(f"WHEN regexp_matches(v, {q(p)}) THEN {_most(b)}" for _, p, b in CLASSES) + " END"
    return rf"""
WITH doc AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
parts AS ({' UNION ALL '.join(one(*x) for x in ((0, 'assign', ASSIGN, 2, ''), (1, 'access', ACCESS, 0, ''), (2, 'hex', HEX, 0, ''), (3, 'entropy', CANDIDATE, 0, '')))}),
placed AS (SELECT rid, k, hit, v, sum(length(gap) + coalesce(length(hit), 0)) OVER (PARTITION BY rid, k ORDER BY i) AS e FROM parts),
spans AS (SELECT rid, k, v, (e - length(hit))::INT AS s, e::INT AS e FROM placed WHERE hit IS NOT NULL AND (k > 0 OR length(v) >= 6)),
wide AS (SELECT x.* FROM spans x WHERE k = 3 AND NOT ({allow}) AND NOT EXISTS (SELECT 1 FROM spans b WHERE b.rid = x.rid AND b.k < 3 AND b.s < x.e AND x.s < b.e)),
tokens AS (SELECT DISTINCT v FROM wide),
windows AS (SELECT v, unnest(range(1, length(v) - {WINDOW} + 2)) AS i FROM tokens),
chars AS (SELECT v, i, substr(v, i + j, 1) AS c, count(*) AS n FROM windows, range({WINDOW}) AS r(j) GROUP BY ALL),
sums AS (SELECT v, i, sum(round(n * log2(n) * {_SCALE})) AS total FROM chars GROUP BY v, i),
good AS (SELECT v FROM sums GROUP BY v HAVING min(total) <= {most}),
kept AS (SELECT rid, k, s, e FROM spans WHERE k < 3 UNION ALL SELECT rid, k, s, e FROM wide WHERE v IN (SELECT v FROM good)),
listed AS (SELECT rid, k, s, e, (CASE k {' '.join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(KINDS))} END) || ':' || s || ':' || e AS x FROM kept),
each AS (SELECT rid, {', '.join(f'count(*) FILTER (k = {i}) AS n_{n}' for i, n in enumerate(KINDS))}, string_agg(x, ',' ORDER BY s, k) AS spans, string_agg(x, ',' ORDER BY s, k) FILTER (k < 3) AS base FROM listed GROUP BY rid)
SELECT doc_id, {', '.join(f'coalesce(n_{n}, 0)::BIGINT AS n_{n}' for n in KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM doc LEFT JOIN each USING (rid)"""


QUERIES = {"op10_secret_scans": op10_secret_scans}
SQL = {"op10_secret_scans": _sql()}
