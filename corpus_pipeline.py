"""Training-corpus pipeline: each stage reads what the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from parcelflow.llm import decontaminate, packing, quality, secrets, simhash
from parcelflow.llm.common import Rounds, fresh, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the production policy keeps.

    Null, empty and wordless texts have too few words and go, as does every
    text of under 50 words. Very long texts are measured whole; repeated
    rows are judged alike; further columns stay, whatever their names; an
    empty table stays empty.
    """
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    Null and empty texts are one group. Of rows that repeat as a whole one
    stays; of rows that share an id only, one of each group; a group without
    any id keeps one row. Very long texts are read whole; further columns
    stay, whatever their names; an empty table stays empty.
    """
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item.

    Null, empty and wordless texts contain none and stay. Very long texts
    are searched whole; repeated rows stay or go together; further columns
    stay, whatever their names; an empty table of either kind takes nothing.
    """
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; n_chars follows the text where it is a whole number.

    Null and empty texts stay as they are. Very long texts are scanned
    whole; repeated rows are masked alike; further columns stay, whatever
    their names; an empty table stays empty.
    """
    col = fresh(docs, "_spans")
    found = secrets.scan(docs, spans_col=col)
    found = found.withColumn("text", secrets.redacted(F.col("text"), F.col(col)))
    kind = next((f.dataType for f in docs.schema if f.name == "n_chars"), None)
    if isinstance(kind, IntegralType):
        found = found.withColumn("n_chars", F.when(F.size(col) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return found.select(*(F.col(f"`{c}`") for c in docs.columns))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece of a document with its place in a sequence.

    A null or empty text is its end id alone; a very long one is cut into
    pieces; repeated rows and null ids are packed like any other; other columns are
    left out; an empty table gives no rows.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: Fingerprints and tokens are not SQL: the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; a stage's table goes once the next one's is written."""
    docs, rounds = table(spark, sf_dir, "documents"), Rounds(spark, "stage")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = rounds.put(docs)
    return docs
