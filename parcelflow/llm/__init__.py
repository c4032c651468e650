"""Operators for training-data pipelines over documents, pages and conversations."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("quality", "secrets", "quotes", "urlfilter", "tokens", "packing", "html", "simhash", "decontaminate", "toxicity", "resampling", "classifier", "negatives")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"{__name__}.{m}").SQL.items()}
