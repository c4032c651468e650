"""JSON values: canonical hashes, differences, and arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(columns: Sequence[str]) -> Column:
    """JSON of the columns with sorted keys; nulls stay out."""
    return F.to_json(F.struct(*sorted(columns)))


def content_hash(columns: Sequence[str]) -> Column:
    return F.sha2(canonical(columns), 256)


def changed_fields(old: Column, new: Column, always: Sequence[str] = (), skip: Sequence[str] = ()) -> Column:
    """Of two maps of text: what is new or differs, a lost key as null; ``always`` keys too, ``skip`` keys never."""
    both = F.map_zip_with(old, new, lambda k, a, b: F.struct(a.alias("a"), b.alias("b")))
    wanted = lambda k, v: (~v["a"].eqNullSafe(v["b"]) | k.isin(list(always))) & ~k.isin(list(skip))
    return F.transform_values(F.map_filter(both, wanted), lambda k, v: v["b"])


def without_empty(json_text: Column) -> Column:
    """A JSON object of text without null and empty-array members at the top."""
    members = F.from_json(json_text, "map<string,string>")
    return F.to_json(F.map_filter(members, lambda k, v: v.isNotNull() & (v != "[]")))


def kept_elements(json_array: Column, schema: str, keep) -> Column:
    """A JSON array of those elements that ``keep`` accepts, in their order."""
    return F.to_json(F.filter(F.from_json(json_array, f"array<{schema}>"), keep))
