"""Predicates made from only those filters that are given."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def all_of(*terms: Column | None) -> Column:
    return reduce(lambda a, b: a & b, [t for t in terms if t is not None], F.lit(True))


def any_of(*terms: Column | None) -> Column:
    return reduce(lambda a, b: a | b, [t for t in terms if t is not None], F.lit(False))


def between(col: Column, least=None, most=None) -> Column | None:
    if least is None and most is None:
        return None
    return all_of(col >= least if least is not None else None, col <= most if most is not None else None)


def equals(col: Column, value) -> Column | None:
    """None and the word ``all`` filter nothing; a list is membership."""
    if value is None or value == "all":
        return None
    return col.isin(list(value)) if isinstance(value, (list, tuple, set)) else col == value


def mentions(columns: Sequence[Column], text: str | None) -> Column | None:
    """Whether any column contains the text, in any case; its ``%`` and ``_`` are wild cards."""
    return None if not text else any_of(*(F.coalesce(c.ilike(f"%{text}%"), F.lit(False)) for c in columns))


def element_mentions(array: Column, terms: Sequence[str]) -> Column:
    """Whether each term is in some element of the array."""
    has = lambda term: F.exists(array, lambda x: x.ilike(f"%{term}%"))
    return all_of(*map(has, terms))


def ratio(a: Column, b: Column) -> Column:
    """a / b where b is positive, else null."""
    return F.when(b > 0, a / b)


def listing_filter(*, portal=None, operation=None, zone=None, price: tuple = (None, None), area: tuple = (None, None), bedrooms: tuple = (None, None), price_per_m2: tuple = (None, None), text: str | None = None) -> Column:
    """AND of the filters that are given, over the columns of a listing."""
    return all_of(
        equals(F.col("portal"), portal),
        equals(F.col("operation"), operation),
        equals(F.col("zone"), zone),
        between(F.col("price"), *price),
        between(F.col("square_meters"), *area),
        between(F.col("bedrooms"), *bedrooms),
        between(ratio(F.col("price"), F.col("square_meters")), *price_per_m2),
        mentions([F.col("advertiser"), F.col("zone")], text),
    )


def stale(last_run: Column, hours: Column | int, as_of: Column) -> Column:
    """Never run, or last before so many hours of the row's own."""
    hours = F.lit(hours) if isinstance(hours, int) else hours
    return last_run.isNull() | (last_run < as_of - F.make_dt_interval(F.lit(0), hours))
