"""Sort orders by name, pages, and paging by key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Orders by name; each ends with the id, so that pages do not overlap.
SORTS = {
    "recent": ("last_seen", False),
    "price_asc": ("price", True),
    "price_desc": ("price", False),
    "sqm": ("square_meters", False),
}


def order_of(name: str | None, id_col: str = "id") -> list[Column]:
    """The order of that name, or the default for an unknown one; nulls last."""
    col, up = SORTS.get(name or "", SORTS["recent"])
    return [F.col(col).asc_nulls_last() if up else F.col(col).desc_nulls_last(), F.col(id_col).asc()]


@dataclass(frozen=True)
class Page:
    number: int
    size: int
    total: int

    @property
    def pages(self) -> int:
        return max(1, -(-self.total // self.size))


def clamp_page(number: int | None, size: int | None, most: int = 200) -> tuple[int, int]:
    return max(1, number or 1), min(most, max(1, size or 20))


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 20, most: int = 200) -> DataFrame:
    number, size = clamp_page(number, size, most)
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def after(df: DataFrame, key: str, last, size: int) -> DataFrame:
    """The next rows by key: the filter reaches the scan, so no earlier page is read again."""
    return (df if last is None else df.where(F.col(key) > last)).orderBy(key).limit(size)
