"""Quality rules as a bitmask ledger.

Every rule is evaluated once a document. The ledger keeps the measurements
and one bit for each rule that failed; a policy is a version and a mask of
the bits that reject, so that applying another policy or measuring what one
rule does on its own (``ablation``) reads the ledger and no text.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, fresh, let, table, words

#: Name of each rule and when a document fails it, over the measurements.
#: The position in this tuple is the rule's bit, so rules are only appended.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "20 * n_symbols > word_chars"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("exclamations", "10 * n_bangs > 3 * n_words"),
    ("capitals", "2 * n_capitals > word_chars"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
)
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BITS["few_words"] | BITS["repeated_words"]
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs", "n_capitals")


@dataclass(frozen=True)
class Policy:
    """Rejects documents that fail a rule of ``reject``, or ``soft_most`` + 1 of the rules in ``soft``."""

    version: str
    reject: int
    soft: int = 0
    soft_most: int = 0

    def kept(self, bits: Column) -> Column:
        """Over the bits, which are bound once: pushed into a filter, a column named twice would be measured twice."""
        hard = lambda b: b.bitwiseAND(F.lit(self.reject).cast("long")) == 0
        return let(bits, lambda b: hard(b) & (F.bit_count(b.bitwiseAND(F.lit(self.soft).cast("long"))) <= self.soft_most))


POLICIES = {
    "v1": Policy("v1", BASE),
    "v2": Policy("v2", BASE | BITS["symbols"] | BITS["repeated_lines"] | BITS["exclamations"] | BITS["capitals"] | BITS["word_length"]),
}
PRODUCTION = POLICIES["v2"]


def _repeat_words(w: Column) -> Column:
    """Words in three-word windows that occur twice or more."""

    def covered(at: Column) -> Column:
        """Words under windows that start at the sorted places ``at``."""
        steps = F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def repeated(by_window: Column) -> Column:
        def place(x: Column, k: Column) -> Column:
            after = F.get(by_window, k + 1)["t"].eqNullSafe(x["t"])
            before = (k > 0) & F.get(by_window, F.greatest(k - 1, F.lit(0)))["t"].eqNullSafe(x["t"])
            return F.when(after | before, x["i"])

        return F.sort_array(F.filter(F.transform(by_window, place), lambda p: p.isNotNull()))

    def count(windows: Column) -> Column:
        # Sorting by the hash first is quick; the window itself keeps it exact.
        ordered = F.sort_array(F.transform(windows, lambda t, i: F.struct(F.xxhash64(t).alias("h"), t.alias("t"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(ordered, lambda s: let(repeated(s), covered)))

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) >= 3, let(windows, count)).otherwise(F.lit(0)).cast("long")


def measurements(text: Column) -> Column:
    """Struct of MEASURES of a text; a null text has no words."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))

    def of(w: Column, s: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            (F.size(s) - F.size(F.array_distinct(s))).cast("long").alias("n_dup_lines"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(s).cast("long").alias("n_lines"),
            F.length(F.regexp_replace(text, r"[^!]+", "")).cast("long").alias("n_bangs"),
            F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long").alias("n_capitals"),
        )

    return let(words(text), lambda w: let(lines, lambda s: of(w, s)))


def ledger(docs: DataFrame, text_col: str = "text", measured_col: str = "measured", bits_col: str = "failure_bits") -> DataFrame:
    """``docs`` with the measurements and the failure bits of each row.

    All columns and rows stay, repeated rows too. If ``docs`` has a column
    named as one of the two added, the added one gets a longer name; see
    ``ledger_columns``. A null or empty text has no words and fails
    ``few_words``. An empty table gives an empty ledger.
    """
    measured_col, bits_col = ledger_columns(docs, measured_col, bits_col)
    out = docs.withColumn(measured_col, measurements(F.col(f"`{text_col}`")))
    m = F.col(f"`{measured_col}`")
    bits = let(m, lambda x: sum((F.when(_failed(x, name), F.lit(bit)).otherwise(F.lit(0)) for name, bit in BITS.items()), F.lit(0)).cast("long"))
    return out.withColumn(bits_col, bits)


def ledger_columns(docs: DataFrame, measured_col: str = "measured", bits_col: str = "failure_bits") -> tuple[str, str]:
    return fresh(docs, measured_col), fresh(docs, bits_col)


def _failed(m: Column, rule: str) -> Column:
    v = {k: m[k] for k in MEASURES}
    return {
        "few_words": v["n_words"] < 50,
        "repeated_words": 100 * v["n_repeat_words"] > 50 * v["n_words"],
        "symbols": 20 * v["n_symbols"] > v["word_chars"],
        "repeated_lines": 2 * v["n_dup_lines"] > v["n_lines"],
        "exclamations": 10 * v["n_bangs"] > 3 * v["n_words"],
        "capitals": 2 * v["n_capitals"] > v["word_chars"],
        "word_length": (v["word_chars"] < 2 * v["n_words"]) | (v["word_chars"] > 15 * v["n_words"]),
    }[rule]


def ablation(entries: DataFrame, policy: Policy = PRODUCTION, rules: Iterable[str] | None = None, bits_col: str = "failure_bits") -> DataFrame:
    """What each rule of a policy does: rows that fail it, and rows that nothing else of ``reject`` rejects.

    One row a rule: rule, bit, n_failed, n_only, n_rows. Rows meet as counts
    of each mask (at most two to the number of rules).
    """
    names = list(rules or BITS)
    masks = entries.groupBy(F.col(f"`{bits_col}`").alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    one = F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.lit(BITS[k]).cast("long").alias("bit")) for k in names))).alias("r")
    hits = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    only = F.col("bits").bitwiseAND(F.lit(policy.reject).cast("long")) == F.col("r.bit")
    count = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long")
    return masks.select("bits", "n", one).groupBy(F.col("r.rule").alias("rule"), F.col("r.bit").alias("bit")).agg(count(hits).alias("n_failed"), count(only).alias("n_only"), F.sum("n").alias("n_rows"))


def keep(docs: DataFrame, policy: Policy = PRODUCTION, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``policy`` keeps, with their own columns, whatever their names.

    Null, empty and wordless texts fail ``few_words``; repeated rows are
    judged alike; an empty table stays empty.
    """
    _, bits = ledger_columns(docs)
    return ledger(docs, text_col).where(policy.kept(F.col(f"`{bits}`"))).select(*(F.col(f"`{c}`") for c in docs.columns))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = ledger(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "measured.*", "failure_bits")
    bits = F.col("failure_bits")
    base = bits.bitwiseAND(F.lit(BASE).cast("long")) != 0
    return entries.select("doc_id", *MEASURES, "failure_bits", F.lit(PRODUCTION.version).alias("policy"), base.alias("base_failed"), (~base & PRODUCTION.kept(bits)).alias("kept"))


def op1_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ablation(ledger(table(spark, sf_dir, "documents").select("text")))


_LEDGER_SQL = r"""
WITH doc AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
parts AS (SELECT rid, doc_id, t,
    list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS s FROM doc),
windows AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM parts),
often AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
covered AS (SELECT rid, count(DISTINCT i + d) AS n FROM often, (VALUES (0), (1), (2)) AS v(d) GROUP BY rid),
m AS (SELECT p.rid, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(s) - len(list_distinct(s)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    len(s)::BIGINT AS n_lines, length(regexp_replace(t, '[^!]+', '', 'g'))::BIGINT AS n_bangs,
    length(regexp_replace(t, '[^\p{Lu}]+', '', 'g'))::BIGINT AS n_capitals
    FROM parts p LEFT JOIN covered c ON c.rid = p.rid),
ledger AS (SELECT *, (""" + " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, (_, rule) in enumerate(RULES)) + ")::BIGINT AS failure_bits FROM m)\n"

OP1_SQL = _LEDGER_SQL + f"""SELECT doc_id, {', '.join(MEASURES)}, failure_bits, '{PRODUCTION.version}' AS policy,
(failure_bits & {BASE}) <> 0 AS base_failed, (failure_bits & {PRODUCTION.reject}) = 0 AS kept FROM ledger"""

ABLATION_SQL = _LEDGER_SQL + f""", rules(rule, bit) AS (VALUES {', '.join(f"('{k}', {v}::BIGINT)" for k, v in BITS.items())})
SELECT rule, bit, count(*) FILTER ((failure_bits & bit) <> 0) AS n_failed,
count(*) FILTER ((failure_bits & {PRODUCTION.reject}) = bit) AS n_only, count(*)::BIGINT AS n_rows
FROM ledger, rules GROUP BY rule, bit"""

QUERIES = {"op1_quality_rules": op1_quality_rules, "quality_ablation": op1_ablation}
SQL = {"op1_quality_rules": OP1_SQL, "quality_ablation": ABLATION_SQL}
